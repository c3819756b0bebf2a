"""A store of derived tables by version: Parquet, and a manifest of when each was made."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.sources.csv_logs import exists


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only a session on one machine that names none gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is deleted when the session ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, place = file_system(spark, folder)
    fs.deleteOnExit(place)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder and read back."""
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class FeatureStore:
    """Tables under `root`/version/name; an absent one reads as None."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, version: str, name: str) -> str:
        return f"{self.root}/{version}/{name}"

    def save(self, version: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(version, name))

    def load(self, version: str, name: str) -> DataFrame | None:
        path = self._path(version, name)
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def save_manifest(self, version: str, **values) -> None:
        row = self.spark.range(1).select(F.current_timestamp().alias("cached_at"), *[F.lit(v).alias(k) for k, v in values.items()])
        row.coalesce(1).write.mode("overwrite").json(self._path(version, "manifest"))

    def manifest(self, version: str) -> dict | None:
        path = self._path(version, "manifest")
        return self.spark.read.json(path).first().asDict() if exists(self.spark, path) else None

    def is_stale(self, version: str, folder: str) -> bool:
        """No manifest, no source file, or a source file, in a subfolder too, newer than the manifest."""
        made = self.manifest(version)
        if made is None or not exists(self.spark, folder):
            return True
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder)
        newest = files.agg(F.max("modificationTime").alias("m")).select((F.col("m") > F.lit(made["cached_at"]).cast("timestamp")).alias("newer"), F.col("m").isNull().alias("none")).first()
        return bool(newest.none or newest.newer)

    def clear(self, version: str) -> None:
        fs, place = file_system(self.spark, f"{self.root}/{version}")
        fs.delete(place, True)

