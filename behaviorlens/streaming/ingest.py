"""Activity logs that arrive in files, read in chunks, into the feature store.

A stream takes a bounded number of files, or of bytes, at a time. Each chunk becomes a folder of
its own below the log, named by the number of the chunk, and the features of the days that it
touches are made anew from all that is stored of those days. A chunk that is tried again after a
failure has the same number and the same files, so it replaces what it had written: whatever is
stopped and started again, every row is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.operators.daily import daily_features
from behaviorlens.sources.csv_logs import Family, canonical, exists, parse_date
from behaviorlens.sources.store import FeatureStore


def read_csv_stream(spark: SparkSession, path: str, columns: list[str], kind: str, family: Family, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """One log in canonical form from the CSV files of a folder, with `columns` in their order.

    A file is a chunk at least, and is split between tasks like any other. Files of a family
    without header lines are read without; other files have to have these columns in their header.
    """
    headerless = kind in family.headerless
    reader = spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).options(header=not headerless, enforceSchema=headerless, quote='"', escape='"')
    reader = reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)
    reader = reader if max_bytes is None else reader.option("maxBytesPerTrigger", max_bytes)
    df = reader.csv(path)
    return canonical(df.withColumn("date", parse_date(F.col("date"))) if "date" in columns else df, kind, family)


class LogSink:
    """What takes the chunks of a stream: events by log, chunk and day, and features by day, of one version of a store."""

    def __init__(self, store: FeatureStore, version: str, logs_of: Callable[[DataFrame], dict[str, DataFrame]]):
        self.store, self.version, self.logs_of = store, version, logs_of

    def _events(self, kind: str) -> str:
        return f"{self.store.root}/{self.version}/events/{kind}"

    def _features(self) -> str:
        return f"{self.store.root}/{self.version}/features"

    def __call__(self, rows: DataFrame, chunk: int) -> None:
        rows.persist()
        try:
            logs = self.logs_of(rows)
            days: set = set()
            for kind, log in logs.items():
                dated = log.where(F.col("user").isNotNull() & F.col("date").isNotNull()).withColumn("event_day", F.to_date("date"))
                dated.write.mode("overwrite").partitionBy("event_day").parquet(f"{self._events(kind)}/chunk={chunk}")
                days |= {r[0] for r in dated.select("event_day").distinct().collect()}  # days of a calendar
            if days:
                touched = {k: x.where(F.col("event_day").isin(*days)) for k, x in self.logs(rows.sparkSession, logs).items()}
                daily_features(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self._features())
        finally:
            rows.unpersist()

    def logs(self, spark: SparkSession, like: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The stored events of each log; the day is a partition, so a filter on it opens no other file."""
        found = {}
        for kind, log in like.items():
            empty = log.limit(0).withColumn("event_day", F.lit(None).cast("date"))
            path = self._events(kind)
            there = exists(spark, path)
            found[kind] = spark.read.schema(empty.schema.add("chunk", "long")).option("basePath", path).parquet(path).drop("chunk") if there else empty
        return found

    def features(self, spark: SparkSession) -> DataFrame | None:
        """The features so far, None before there are any."""
        return spark.read.parquet(self._features()) if exists(spark, self._features()) else None


def ingest(rows: DataFrame, sink: LogSink, checkpoint: str) -> None:
    """Takes all files that are there and not yet taken, a chunk at a time.

    `checkpoint` names the folder in which the stream keeps what it has taken. An error ends the
    run, and the next one with the same folder goes on with the chunk that failed.
    """
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
