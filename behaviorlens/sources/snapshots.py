"""A table that changes as a whole: versioned snapshots and one atomic step from one to the next.

A change writes a new snapshot beside the others and then commits it: a small file that names it is
renamed to the next number, which fails if the number is taken. So a reader sees the table before
or after a change, a change that breaks off leaves nothing that is read, and of two changes of the
same table one is made again on what the other left. The store has to rename without replacing, as
HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.operators import scoring as S
from behaviorlens.sources.store import file_system

#: Changes that lose against others in turn before the change is given up.
TRIES = 20
ALERTS = "id string, user string, date date, score double, status string, created_at timestamp, top_features array<string>"
BLOCKS = "alert_id string, user string, blocked_at timestamp"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = file_system(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, place = file_system(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _rename(spark: SparkSession, source: str, target: str, replace: bool) -> bool:
    """Whether the file now has the other name; without `replace` it hasn't if there was one of that name."""
    jvm = spark._jvm
    rename, _, place = jvm.org.apache.hadoop.fs.Options.Rename, None, jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), place, options)
        return True
    except Exception as error:  # a Java error, told apart by its class
        if "FileAlreadyExistsException" in str(error):
            return False
        raise


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON file that is there as a whole or as it was."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    _write_text(spark, draft, json.dumps(value))
    _rename(spark, draft, path, replace=True)


def read_json(spark: SparkSession, path: str, default=None):
    """The value of a JSON file; the default where there is none, or none that can be read."""
    text = _read_text(spark, path)
    try:
        return default if text is None else json.loads(text)
    except ValueError:
        return default


class SnapshotTable:
    """A table below `root`; without a commit it is empty."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def version(self) -> int:
        """The number of the last commit, 0 before any."""
        fs, place = file_system(self.spark, f"{self.root}/commits/*")
        names = [s.getPath().getName() for s in fs.globStatus(place) or []]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or as it was after a commit."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        folder = _read_text(self.spark, f"{self.root}/commits/{version:020d}")
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")

    def change(self, step: Callable[[DataFrame], DataFrame]) -> int:
        """Replaces the table by what `step` makes of it; the number of the commit."""
        for _ in range(TRIES):
            version = self.version()
            folder = f"snapshots/{uuid.uuid4().hex}"
            columns = self.spark.createDataFrame([], self.schema).columns
            step(self.read(version)).select(*columns).write.parquet(f"{self.root}/{folder}")
            if self._commit(version + 1, folder):
                return version + 1
        raise RuntimeError(f"{TRIES} changes of {self.root} were overtaken by others")

    def _commit(self, version: int, folder: str) -> bool:
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        _write_text(self.spark, draft, folder)
        fs, place = file_system(self.spark, f"{self.root}/commits")
        fs.mkdirs(place)
        return _rename(self.spark, draft, f"{self.root}/commits/{version:020d}", replace=False)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the snapshots that none of the last `keep` commits names, those of broken changes too; how many they were."""
        last = self.version()
        named = {_read_text(self.spark, f"{self.root}/commits/{v:020d}") for v in range(max(1, last - keep + 1), last + 1)}
        fs, place = file_system(self.spark, f"{self.root}/snapshots/*")
        old = [s.getPath() for s in fs.globStatus(place) or [] if f"snapshots/{s.getPath().getName()}" not in named]
        for path in old:
            fs.delete(path, True)
        return len(old)


class AlertStore:
    """The alerts of a folder and the log of blocked ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.alerts, self.blocks = SnapshotTable(spark, f"{root}/alerts", ALERTS), SnapshotTable(spark, f"{root}/blocks", BLOCKS)

    def load(self, status: str | None = None) -> DataFrame:
        """Alerts, those of a status if one is named, the highest score first."""
        return S.load_alerts(self.alerts.read(), status)

    def add(self, alerts: DataFrame) -> int:
        """Adds the alerts whose id is not yet there: the same alerts twice are there once."""
        return self.alerts.change(lambda now: now.unionByName(alerts.join(now.select("id"), "id", "left_anti").dropDuplicates(["id"]), allowMissingColumns=True))

    def update_status(self, alert_id: str, status: str) -> int:
        """An unknown id raises KeyError and changes nothing."""
        return self.alerts.change(lambda now: S.update_status(now, alert_id, status))

    def mute(self, alert_id: str) -> int:
        return self.update_status(alert_id, "muted")

    def learn(self, alert_id: str) -> int:
        return self.update_status(alert_id, "learned")

    def block(self, alert_id: str) -> int:
        """The alert is blocked and has its row in the log, which comes first, so that no alert is blocked without."""
        row = self.alerts.read().where(F.col("id") == alert_id).select(F.col("id").alias("alert_id"), "user", F.current_timestamp().alias("blocked_at"))
        if row.isEmpty():
            raise KeyError(alert_id)
        self.blocks.change(lambda now: now.unionByName(row.join(now.select("alert_id"), "alert_id", "left_anti")))
        return self.update_status(alert_id, "blocked")
