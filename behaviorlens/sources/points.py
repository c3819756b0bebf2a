"""Stored points with indexes of their payload: what a filter doesn't ask for isn't read.

The version is a partition, so another version's files aren't opened. Inside, the rows are sorted by
the fields that ranges are asked of, so the least and largest values of a row group tell whether it
is needed; for exact matches of users, who are in no order, each row group has a Bloom filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.operators.similarity import find_similar
from behaviorlens.sources.csv_logs import exists

#: Fields of the payload with an index, and those that rows are sorted by.
INDEXED, SORTED = ("user_id", "version", "department", "scenario", "score"), ("department", "scenario", "score")
DEFAULTS = {"score": 0.0, "department": "", "scenario": 0}


class PointStore:
    """Points (version, user_id, department, scenario, score, vector, and others) below a folder."""

    def __init__(self, spark: SparkSession, root: str, dimension: int, users: int = 1_000_000, group_bytes: int = 8 << 20):
        """`dimension` is that of all vectors; `users` is how many a file has at most, for the size of its filters."""
        self.spark, self.root, self.dimension, self.users, self.group_bytes = spark, root, dimension, users, group_bytes

    def write(self, points: DataFrame, parts: int | None = None) -> None:
        """Replaces the versions that the points are of, and leaves the others as they are.

        A vector of another length than the store's is an error. The rows of a version are
        range-partitioned by the sorted fields, so a large version is written by many tasks.
        """
        checked = F.when(F.size("vector") == self.dimension, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("a vector has not the length "), F.lit(self.dimension))))
        rows = points.fillna(DEFAULTS).withColumn("vector", F.when(F.col("vector").isNotNull(), checked))
        order = ["version", *SORTED, "user_id"]
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        for name, value in (("enabled", "true"), ("expected.ndv", self.users)):
            writer = writer.option(f"parquet.bloom.filter.{name}#user_id", value)
        writer.option("parquet.block.size", self.group_bytes).partitionBy("version").parquet(self.root)

    def read(self) -> DataFrame | None:
        """All points; None before any were written."""
        return self.spark.read.parquet(self.root) if exists(self.spark, self.root) else None

    def where(self, *conditions: Column, **equal) -> DataFrame:
        """The points whose payload fields have these values; ValueError for a field without an index."""
        unknown = set(equal) - set(INDEXED)
        if unknown:
            raise ValueError(f"no index of {', '.join(sorted(unknown))}")
        rows = self.read()
        for name, value in equal.items():
            rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
        for condition in conditions:
            rows = rows.where(condition)
        return rows

    def similar(self, queries: DataFrame, k: int = 10, *conditions: Column, **equal) -> DataFrame:
        """The k points nearest to each query among those that a filter on the payload leaves. Points are named by user_id."""
        found = self.where(*conditions, **equal).select(F.col("user_id").alias("point_id"), "vector")
        return find_similar(found, queries.select(F.col("user_id").alias("point_id"), "vector"), k)
