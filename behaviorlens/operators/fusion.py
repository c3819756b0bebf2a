"""Detectors that bring together what is known of a user's window, as one pipeline that is stored and loaded.

The inputs are window statistics, the user's graph aggregates, what the neighbours are like, traits
and the one-hot role and department. All that is learned, vocabularies included, is in the
pipeline, so a loaded one scores rows just as the one that was stored.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.operators.models import weighted
from behaviorlens.sources.store import file_system

UNKNOWN = "(none)"


def joined(windows: DataFrame, *of_users: DataFrame) -> DataFrame:
    """The windows with what other tables have of their user, a row for each of theirs."""
    for table in of_users:
        windows = windows.join(table, "user", "left")
    return windows


def prepared(rows: DataFrame, numbers: tuple[str, ...], categories: tuple[str, ...]) -> DataFrame:
    """The other columns as they are; numbers as doubles, null where unknown, and categories without nulls."""
    rest = [c for c in rows.columns if c not in (*numbers, *categories)]
    return rows.select(*rest, *[F.col(n).cast("double").alias(n) for n in numbers], *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in categories])


def pipeline(numbers: tuple[str, ...], categories: tuple[str, ...] = ("role", "department"), classifier=None) -> Pipeline:
    """Numbers, unknown ones as their median, and one-hot categories, unseen ones as one more, into a classifier of `features`."""
    indexed, hot, filled = [f"{c}_index" for c in categories], [f"{c}_hot" for c in categories], [f"{n}_filled" for n in numbers]
    stages = [
        Imputer(strategy="median", inputCols=list(numbers), outputCols=filled),
        StringIndexer(inputCols=list(categories), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False),
        VectorAssembler(inputCols=[*filled, *hot], outputCol="features"),
        classifier or GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, weightCol="weight", labelCol="label", seed=42),
    ]
    return Pipeline(stages=stages)


def fit(rows: DataFrame, numbers: tuple[str, ...], categories: tuple[str, ...] = ("role", "department"), classifier=None) -> PipelineModel:
    """The pipeline fitted on prepared rows with `label`, positives weighted up to the negatives. A number that is unknown in all rows is an error."""
    return pipeline(numbers, categories, classifier).fit(weighted(rows))


class ModelStore:
    """Models under `root`/name, each with what is to be known of it; an absent one raises KeyError."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, name: str, model: PipelineModel, **about) -> None:
        """The model and its description; the description comes last, so a model that is being stored isn't there yet."""
        fs, place = file_system(self.spark, f"{self.root}/{name}")
        fs.delete(place, True)
        model.write().save(f"{self.root}/{name}/model")
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{self.root}/{name}/about")

    def about(self, name: str) -> dict:
        fs, place = file_system(self.spark, f"{self.root}/{name}/about/_SUCCESS")
        if not fs.exists(place):
            raise KeyError(name)
        return json.loads(self.spark.read.text(f"{self.root}/{name}/about").first()[0])

    def load(self, name: str) -> PipelineModel:
        self.about(name)
        return PipelineModel.load(f"{self.root}/{name}/model")

    def names(self) -> list[str]:
        fs, place = file_system(self.spark, f"{self.root}/*/about/_SUCCESS")
        return sorted(s.getPath().getParent().getParent().getName() for s in fs.globStatus(place) or [])
