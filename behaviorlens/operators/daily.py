"""Per-entity-per-day features of the five activity logs.

Every log is projected to (user, day) and the measures it contributes and grouped with partial
aggregates; the small rows that come out are one union with one more grouping.
Users that are null are left out. All eighteen columns are there whatever logs are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.functions import predicates as P


def measures() -> dict[str, dict[str, Column]]:
    """For each log, the features it contributes and what each row adds to them; text is counted distinct."""
    c, ts = F.col, F.col("date")
    logon = P.activity_is(c("activity"), "logon")
    return {
        "logon": {
            "logon_count": logon,
            "logoff_count": P.activity_is(c("activity"), "logoff"),
            "after_hours_logons": logon & P.after_hours(ts),
            "weekend_logons": logon & P.weekend(ts),
            "unique_pcs_used": c("pc"),
        },
        "device": {
            "usb_connect_count": P.activity_is(c("activity"), "connect"),
            "usb_disconnect_count": P.activity_is(c("activity"), "disconnect"),
            "after_hours_usb": P.after_hours(ts),
        },
        "file": {
            "file_count": c("filename").isNotNull(),
            "file_to_removable_count": P.removable(c("to_removable_media")),
            "unique_filenames": c("filename"),
        },
        "email": {
            "email_sent_count": c("id").isNotNull(),
            "email_to_external_count": P.has_external(c("to")),
            "large_attachment_count": P.large_attachment(c("size")),
            "total_email_size": F.coalesce(c("size").cast("double"), F.lit(0.0)),
        },
        "http": {
            "http_request_count": c("url").isNotNull(),
            "job_search_visits": P.any_word(c("url"), C.JOB_WORDS),
            "cloud_upload_visits": P.any_word(c("url"), C.CLOUD_WORDS),
        },
    }


DISTINCT, AMOUNTS = ("unique_pcs_used", "unique_filenames"), ("total_email_size",)


def _aggregate(name: str) -> Column:
    if name in DISTINCT:
        return F.countDistinct(name).alias(name)
    if name in AMOUNTS:
        return F.coalesce(F.sum(name), F.lit(0.0)).alias(name)
    return F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0)).alias(name)


def log_features(log: DataFrame, kind: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The features of one log by (user, day), and by other columns of it if there are any."""
    columns = measures()[kind]
    if kind == "file" and "to_removable_media" not in log.columns:
        log = log.withColumn("to_removable_media", F.lit(None).cast("string"))
    rows = log.where(F.col("user").isNotNull()).select("user", P.day(F.col("date")).alias("day"), *by, *[m.alias(n) for n, m in columns.items()])
    return rows.groupBy("user", "day", *by).agg(*[_aggregate(n) for n in columns])


def daily_features(logs: dict[str, DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """user, day and the eighteen features, for every user and day with an event in some log; with `by`, for each of its values apart.

    Each log is first aggregated on its own, so that a distinct count expands no rows of another
    log; the union is then of small rows, one per log, user and day.
    """
    parts = []
    for kind, log in logs.items():
        own = log_features(log, kind, by)
        parts.append(own.select("user", "day", *by, *[F.col(n) if n in own.columns else _nothing(n) for n in C.FEATURES]))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("user", "day", *by).agg(*[F.coalesce(F.sum(n), F.lit(0.0 if n in AMOUNTS else 0)).alias(n) for n in C.FEATURES])


def _nothing(name: str) -> Column:
    return F.lit(None).cast("double" if name in AMOUNTS else "long").alias(name)


def malicious_days(insiders: DataFrame) -> DataFrame:
    """Distinct (user, day) of all attacks, first and last day included."""
    days = F.explode(F.sequence(F.to_date("attack_start"), F.to_date("attack_end"), F.expr("interval 1 day")))
    return insiders.select(F.col("user_id").alias("user"), days.alias("day")).distinct()


def label_days(features: DataFrame, malicious: DataFrame) -> DataFrame:
    return features.join(malicious.withColumn("is_malicious", F.lit(1)), ["user", "day"], "left").withColumn("is_malicious", F.coalesce("is_malicious", F.lit(0)))


def time_split(column: Column, train_end: str, validation_end: str, inclusive_end_day: bool = False) -> Column:
    """train, val or test by time. Ends are midnights, unless the whole day is asked for."""
    ends = [F.lit(x).cast("timestamp_ntz") for x in (train_end, validation_end)]
    if inclusive_end_day:
        return F.when(F.to_date(column) <= F.to_date(ends[0]), "train").when(F.to_date(column) <= F.to_date(ends[1]), "val").otherwise("test")
    return F.when(column <= ends[0], "train").when(column <= ends[1], "val").otherwise("test")


def long_form(wide: DataFrame, keys: Iterable[str], names: Iterable[str] = C.FEATURES) -> DataFrame:
    """One row per key and feature: keys, feature, x."""
    return wide.select(*keys, *[F.col(n).cast("double") for n in names]).unpivot(list(keys), list(names), "feature", "x")
