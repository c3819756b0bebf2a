"""A cache of window graphs, keyed by all that their content depends on.

Exclusions, caps and the shape of the windows make up the key, so a graph made with others is never
returned. Windows are partitions: missing ones are built and put beside those that are there. A
window is noted as built only after all its tables are written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from behaviorlens.sources.csv_logs import exists
from behaviorlens.sources.snapshots import read_json, write_json
from behaviorlens.sources.store import file_system


def content_key(exclusions: Iterable[str] = (), **values) -> str:
    """What names a cached graph: the same for the same exclusions, in any order, caps and other values."""
    return hashlib.sha256(json.dumps([sorted(set(exclusions)), values], sort_keys=True).encode()).hexdigest()[:32]


class GraphCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def built(self, key: str) -> set[str]:
        """The starts of the windows that are there."""
        fs, place = file_system(self.spark, f"{self.root}/{key}/windows/*")
        return {s.getPath().getName() for s in fs.globStatus(place) or [] if not s.getPath().getName().endswith(".tmp")}

    def tables(self, key: str, windows: Iterable[str], build: Callable[[list[str]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The node and edge tables of these windows; `build` makes those of the missing ones, each with window_start."""
        wanted = sorted(set(windows))
        missing = sorted(set(wanted) - self.built(key))
        if missing:
            made = build(missing)
            for name, table in made.items():
                rows = table.where(F.col("window_start").cast("string").isin(missing))
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start").parquet(self._path(key, name))
            schemas = {n: t.schema.json() for n, t in made.items()}
            write_json(self.spark, f"{self.root}/{key}/schemas", schemas)
            for start in missing:
                write_json(self.spark, f"{self.root}/{key}/windows/{start}", {"tables": sorted(made)})
        return {name: self._read(key, name, schema, wanted) for name, schema in read_json(self.spark, f"{self.root}/{key}/schemas", {}).items()}

    def _path(self, key: str, name: str) -> str:
        return f"{self.root}/{key}/tables/{name}"

    def _read(self, key: str, name: str, schema: str, wanted: list[str]) -> DataFrame:
        kind, path = StructType.fromJson(json.loads(schema)), self._path(key, name)
        rows = self.spark.read.schema(kind).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], kind)
        return rows.where(F.col("window_start").isin(*[F.lit(w).cast("date") for w in wanted]))
