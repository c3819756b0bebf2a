"""A corpus pipeline: each stage reads what the one before it wrote.

Every stage but the last returns the columns of `documents`. `run` writes each stage's rows as
Parquet to the shared folder of the session and reads them back for the next; a stage's rows are
deleted once the next stage has written its own.

An empty table goes through all stages and gives no pieces. Null and empty texts are kept or
rejected by their score like others; of those that stay one is kept as exact copies of each
other. Repeated rows are exact copies. Extra columns are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm import exact, mixing, neardup, packing, quality
from behaviorlens.llm.common import delete_folder, new_folder, read
from behaviorlens.llm.queries import vocabulary

#: The pipeline keeps more of the corpus than the mixing query: its targets are flatter by less.
KEEP, TEMPERATURE = 0.9, 0.9


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it learns from all labels of documents at hand."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.where(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, keep=KEEP, temperature=TEMPERATURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), keeps_space=True, end_id=0, max_tokens=1024)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("MinHash near-dedup", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Trained rules, signatures and token ids have no SQL form; the tests hold a run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before is not None:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
