"""Detectors: feature assembly, classifiers of Spark ML, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.operators.evaluation import folds
from behaviorlens.sources.store import file_system, shared_folder, written

#: Bytes of a written table that one task of a training takes, and rows, as long as there are cores for them.
PART_BYTES, PART_ROWS = 16 << 20, 65_536


def assemble(rows: DataFrame, names: tuple[str, ...] = C.FEATURES, out: str = "features") -> DataFrame:
    filled = rows.select(*[c for c in rows.columns if c not in names], *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return VectorAssembler(inputCols=list(names), outputCol=out).transform(filled)


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """With `weight`: negatives over positives for a positive row, 1 for a negative one."""
    n = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return rows.withColumn("weight", F.when(F.col(label) == 1, float(n.n / max(1, n.p))).otherwise(1.0))


def boosted_trees(train: DataFrame, seed: int = 42, rounds: int = 40, depth: int = 4):
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, weightCol="weight", labelCol="label", seed=seed).fit(weighted(train))


def perceptron(train: DataFrame, width: int, seed: int = 42, epochs: int = 50):
    """Layers width, 64, 32, 2. The network takes no weights, so positives are repeated instead."""
    n = train.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    times = F.when(F.col("label") == 1, max(1, n.n // max(1, 4 * n.p))).otherwise(1)
    rows = train.withColumn("_k", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_k")
    return MultilayerPerceptronClassifier(layers=[width, 64, 32, 2], maxIter=epochs, seed=seed, labelCol="label").fit(rows)


def scores(model, rows: DataFrame, *keys: str) -> DataFrame:
    return model.transform(rows).select(*keys, F.get(vector_to_array("probability"), F.lit(1)).alias("prob"))


def dealt(rows: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """The rows as they are now, with `fold`: users are dealt to `n` folds, those with a positive row evenly.

    They are written once, and read back in as few partitions as their size asks for, as every
    round of a training passes over all of them.
    """
    rows = written(rows)
    users = rows.groupBy("user").agg(F.max("label").alias("_p"))
    return compact(written(rows.join(folds(users, n, seed, F.col("_p")).drop("_p"), "user")))


def compact(table: DataFrame, bytes_of_part: int = PART_BYTES) -> DataFrame:
    """A written table in parts of about so many bytes, and in as many as there are cores if each has rows enough."""
    size = sum(fs.getContentSummary(place).getLength() for fs, place in (file_system(table.sparkSession, f) for f in table.inputFiles()))
    busy = min(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // PART_ROWS))
    return table.coalesce(max(1, -(-size // bytes_of_part), busy))


def out_of_fold(rows: DataFrame, fit: Callable[[DataFrame, Column], DataFrame], n: int = 5, seed: int = 42) -> DataFrame:
    """The scores of all rows, each by a model that hasn't seen its user.

    `fit` takes all rows, with their fold, and which of them are held out, fits on the others and
    returns the scores of those held out. The folds are fitted side by side.
    """
    shared_folder(rows.sparkSession)  # the trees cut their lineage there too
    rows = dealt(rows, n, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        used = sorted(r.fold for r in rows.select("fold").distinct().collect())  # at most n
        if len(used) < 2:
            raise ValueError("there are no rows to fit on")
        with ThreadPool(len(used)) as pool:
            found = pool.map(inheritable_thread_target(rows.sparkSession)(lambda k: written(fit(rows, F.col("fold") == k))), used)
    finally:
        rows.unpersist()
    return reduce(DataFrame.unionByName, found)
