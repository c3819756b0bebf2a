"""Activity logs from CSV folders of several releases, brought into one canonical form."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens import schema as S
from behaviorlens.operators.daily import malicious_days, time_split

#: The family of each release.
FAMILIES = {"r1": "r1", "r2": "r2", "r3.1": "r3x", "r3.2": "r3x", "r4.1": "r4x", "r4.2": "r4x", "r5.1": "r5x", "r5.2": "r5x", "r6.1": "r6x", "r6.2": "r6x"}
LOGS = ("logon", "device", "email", "http", "file")
_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy", "yyyy-MM-dd")


def parse_date(text: Column) -> Column:
    """Month-first or ISO dates, padded or not; anything else is null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("timestamp_ntz") for f in _FORMATS])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def header(spark: SparkSession, path: str) -> list[str]:
    """The fields of a file's first line; FileNotFoundError without a file."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    line = spark.read.text(path).first()
    return [] if line is None else [c.strip().strip('"') for c in line[0].split(",")]


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, date: str | None = "date") -> DataFrame:
    """A CSV file as text columns with its date parsed. `columns` name those of a file without a header."""
    names = columns or header(spark, path)
    df = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in names), header=columns is None, quote='"', escape='"', multiLine=False)
    return df.withColumn(date, parse_date(F.col(date))) if date in names else df


@dataclass(frozen=True)
class Family:
    """How a family of releases differs from the canonical form."""

    name: str
    user_prefix: str = ""
    headerless: dict[str, list[str]] = field(default_factory=dict)
    absent: tuple[str, ...] = ()
    activity: dict[str, str] = field(default_factory=dict)
    copies_are_removable: bool = False


_ADAPTERS = {
    f.name: f
    for f in (
        Family("r1", user_prefix="DTAA/", headerless={"http": ["id", "date", "user", "pc", "url"]}, absent=("email", "file")),
        Family("r2", activity={"insert": "Connect", "remove": "Disconnect"}),
        Family("r3x", copies_are_removable=True),
        Family("r4x", copies_are_removable=True),
        Family("r5x"),
        Family("r6x"),
    )
}


def adapter(version: str) -> Family:
    """The family of a release, or by its own name; ValueError for any other."""
    name = FAMILIES.get(version, version)
    if name not in _ADAPTERS:
        raise ValueError(f"unknown release {version}")
    return _ADAPTERS[name]


def detect(spark: SparkSession, folder: str) -> str:
    """The family of a folder, from the headers of its http and email files; a file that isn't there tells nothing."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    fields = {n: {x.lower() for x in header(spark, f"{folder}/{n}.csv")} if exists(spark, f"{folder}/{n}.csv") else None for n in ("http", "email")}
    http, email = fields["http"], fields["email"]
    if http is not None and not {"url", "user"} & http:
        return "r1"
    if email is not None and len(email) <= 4:
        return "r2"
    if email is not None and "size" in email and "user" not in email:
        return "r3x"
    if email is not None and "user" in email and "activity" not in email:
        return "r4x"
    return "r6x" if http is not None and "activity" in http else "r5x"


def load_log(spark: SparkSession, folder: str, kind: str, family: Family) -> DataFrame:
    """One log in canonical form; a missing file is an empty log."""
    path = f"{folder}/{kind}.csv"
    if kind in family.absent or not exists(spark, path):
        return S.empty(spark, kind)
    return canonical(read_csv(spark, path, family.headerless.get(kind)), kind, family)


def canonical(df: DataFrame, kind: str, family: Family) -> DataFrame:
    """The text columns of a log of a family, with its date parsed, in canonical form; a batch or a stream."""
    if family.user_prefix and "user" in df.columns:
        df = df.withColumn("user", F.replace("user", F.lit(family.user_prefix), F.lit("")))
    if kind == "device" and family.activity:
        low = F.lower("activity")
        renamed = F.coalesce(*[F.when(low == old, new) for old, new in family.activity.items()], F.col("activity"))
        df = df.withColumn("activity", renamed)
    if kind == "file" and family.copies_are_removable:
        df = df.withColumn("to_removable_media", F.lit("True"))
    return S.finalise(df, kind)


def load_ldap(spark: SparkSession, folder: str) -> DataFrame:
    """The directory of the last month, with lower-cased columns and without the domain."""
    if not exists(spark, folder):
        return S.empty(spark, "ldap")
    files = spark.read.text(f"{folder}/*.csv").select(F.col("_metadata.file_path").alias("p")).agg(F.max("p")).first()[0]
    if files is None:
        return S.empty(spark, "ldap")
    df = read_csv(spark, files, date=None)
    df = df.toDF(*[c.lower() for c in df.columns]).drop("domain")
    return S.finalise(df, "ldap")


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A dimension file; a missing one is empty, one that lacks a column raises ValueError."""
    if not exists(spark, path):
        return S.empty(spark, table)
    df = S.require_columns(read_csv(spark, path, date=None), table)
    if table == "decoy":
        df = df.select(*[F.trim(F.replace(c, F.lit('"'), F.lit(""))).alias(c) for c in df.columns])
    return S.finalise(df, table)


def load_insiders(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(user_id, scenario, dataset, attack_start, attack_end, details) of a release, or of a family's number.

    Without a file there are none. A file with rows of which none matches raises ValueError, as
    labels that are silently all zero would be worse.
    """
    path = f"{folder}/insiders.csv"
    if not exists(spark, path):
        rows = S.empty(spark, "insiders")
    else:
        rows = S.require_columns(read_csv(spark, path, date=None), "insiders").withColumns({"start": parse_date(F.col("start")), "end": parse_date(F.col("end"))})
    wanted = version.removeprefix("r")
    own = F.regexp_extract("dataset", r"^(\d+)", 1) == wanted.removesuffix("x") if wanted.endswith("x") else F.trim("dataset") == wanted
    found = S.finalise(rows, "insiders").where(own)
    if found.isEmpty() and not rows.isEmpty():
        raise ValueError(f"no insider of {version} among the rows of {path}")
    return found.select(F.col("user").alias("user_id"), "scenario", "dataset", F.col("start").alias("attack_start"), F.col("end").alias("attack_end"), "details")


def attack_windows(insiders: DataFrame) -> DataFrame:
    """One row per user: the attack that starts last."""
    rest = [c for c in insiders.columns if c != "user_id"]
    return insiders.groupBy("user_id").agg(F.max_by(F.struct(*rest), "attack_start").alias("a")).select("user_id", "a.*")


def resolve_senders(email: DataFrame, ldap: DataFrame) -> DataFrame:
    """Email rows without a user take that of their sender's address in the directory."""
    known = ldap.select(F.lower("email").alias("_from"), F.col("user_id").alias("_user")).dropDuplicates(["_from"])
    joined = email.withColumn("_from", F.lower("from")).join(known, "_from", "left")
    return joined.withColumn("user", F.coalesce("user", "_user")).drop("_from", "_user")


@dataclass(frozen=True)
class Dataset:
    version: str
    logs: dict[str, DataFrame]
    ldap: DataFrame
    psychometric: DataFrame
    decoy: DataFrame
    insiders: DataFrame


def load(spark: SparkSession, folder: str, version: str | None = None, finish: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> Dataset:
    """All tables of a folder, lazily; the release is detected when it isn't named."""
    family = adapter(version or detect(spark, folder))
    logs = {k: finish(k, load_log(spark, folder, k, family)) for k in LOGS}
    return Dataset(
        family.name, logs, load_ldap(spark, f"{folder}/LDAP"), load_table(spark, f"{folder}/psychometric.csv", "psychometric"),
        load_table(spark, f"{folder}/decoy_file.csv", "decoy"), load_insiders(spark, f"{folder}/answers", version or family.name),
    )


def load_data(spark: SparkSession, folder: str, train_end: str, validation_end: str, version: str | None = None) -> tuple[dict[str, dict[str, DataFrame]], DataFrame]:
    """The logs of each split, and the labelled (user, day); a folder whose release can't be told is taken for r4.2."""
    try:
        version = version or detect(spark, folder)
    except (FileNotFoundError, ValueError):
        version = "r4.2"
    data = load(spark, folder, version)
    split = time_split(F.col("date"), train_end, validation_end)
    return {s: {k: x.where(split == s) for k, x in data.logs.items()} for s in ("train", "val", "test")}, malicious_days(data.insiders)


def provenance(spark: SparkSession, folder: str, bytes_of_file: int = 65536) -> DataFrame:
    """(path, length, sha256 of the first bytes) of the folder's own CSV files, by path.

    Of each file no more is read than those bytes, through the file system that Spark uses, so its
    length doesn't matter.
    """
    ddl, pattern = "path string, length bigint, sha256 string", spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.csv")
    fs, rows = pattern.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for status in fs.globStatus(pattern) or []:
        if status.isFile():
            stream = fs.open(status.getPath())
            try:
                rows.append((status.getPath().toString(), status.getLen(), hashlib.sha256(stream.readNBytes(bytes_of_file)).hexdigest()))
            finally:
                stream.close()
    return spark.createDataFrame(sorted(rows), ddl)
