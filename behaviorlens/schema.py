"""Canonical schemas of logs and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMMON = {"id": "string", "date": "timestamp_ntz", "user": "string", "pc": "string"}
#: Required columns of each table, then optional ones.
REQUIRED = {
    "logon": {**_COMMON, "activity": "string"},
    "device": {**_COMMON, "activity": "string"},
    "email": {**_COMMON, "to": "string", "cc": "string", "bcc": "string", "from": "string", "size": "double", "attachments": "string", "content": "string"},
    "http": {**_COMMON, "url": "string", "content": "string"},
    "file": {**_COMMON, "filename": "string", "content": "string"},
    "ldap": {"employee_name": "string", "user_id": "string", "email": "string", "role": "string"},
    "psychometric": {"employee_name": "string", "user_id": "string", **dict.fromkeys("OCEAN", "int")},
    "insiders": {"dataset": "string", "scenario": "int", "details": "string", "user": "string", "start": "timestamp_ntz", "end": "timestamp_ntz"},
    "decoy": {"decoy_filename": "string", "pc": "string"},
}
OPTIONAL = {
    "device": {"file_tree": "string"},
    "http": {"activity": "string"},
    "email": {"activity": "string"},
    "file": {"activity": "string", "to_removable_media": "string", "from_removable_media": "string"},
    "ldap": {c: "string" for c in ("business_unit", "functional_unit", "department", "team", "supervisor", "projects")},
}


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """The table itself; ValueError names the required columns that it lacks."""
    missing = [c for c in REQUIRED[table] if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df


def finalise(df: DataFrame, table: str) -> DataFrame:
    """Required columns first, absent ones as null, then all others."""
    need = REQUIRED[table]
    out = [F.col(f"`{c}`").cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in need.items()]
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in need])


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in REQUIRED[table].items()))
