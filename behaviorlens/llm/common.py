"""Helpers that several text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorlens.sources.store import file_system, new_folder

#: The characters that count as white space, `[\x20\x09-\x0D]`.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def delete_folder(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path, True)


class Scratch:
    """The written tables of one computation.

    A table cuts the lineage: it is written as Parquet to the shared folder and read back, so a
    lost executor costs a read, and the plans after it know its true size. On leaving the context
    all tables are deleted but those that the result still reads, which `keep` names.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, new_folder(spark, "scratch"), []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.tables])

    def cut(self, df: DataFrame, small: bool = False) -> DataFrame:
        """`small` says that the rows fit into one task with ease: one file, and no shuffle after it."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        (df.coalesce(1) if small else df).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table = table.coalesce(1) if small else table
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self.tables if any(t is x for x in tables)]:
            delete_folder(self.spark, path)
        self.keep(*tables)

    def keep(self, *tables: DataFrame) -> None:
        """From now on these live as long as the session."""
        self.tables = [(t, p) for t, p in self.tables if not any(t is x for x in tables)]


def cut(df: DataFrame) -> DataFrame:
    """One written table that lives as long as the session."""
    return Scratch(df.sparkSession).cut(df)


#: Shares of the rows of one key.
SHARES = 256


def one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the first of each share first and the first of those then, so that a key's rows aren't one task's.

    The rows have `share`, which does not follow from the key.
    """
    for by in ((*keys, "share"), keys):
        rows = rows.withColumn("once", F.row_number().over(Window.partitionBy(*by).orderBy("share"))).where("once = 1").drop("once")
    return rows


def share() -> Column:
    """A share for each row, by its place in the input."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).alias("share")


def has_repeats(rows: DataFrame, *keys: str) -> bool:
    return not rows.groupBy(*keys).count().where("count > 1").isEmpty()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def without_white_space(text: Column) -> Column:
    """The text without any of WHITE_SPACE: plain byte replacement, which needs no regular expression."""
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the much faster built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_pair(seed: int, *values: Column) -> list[Column]:
    """Two independent 64-bit hashes: the seed is hashed first, so each starts in another state."""
    return [F.xxhash64(F.lit(2 * seed + k), *values) for k in (0, 1)]
