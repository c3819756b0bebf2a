"""Alerts, their explanations, and the views that investigations read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.functions import predicates as P
from behaviorlens.operators.daily import daily_features, long_form


def demo_alerts(z: DataFrame, floor: float = 0.3, top: int = 3) -> DataFrame:
    """(user, date, score, status, top_features) from (user, day, feature, z): score is min(1, mean |z| / 3), at least `floor`.

    The features are the `top` by |z|, the first in name order among equals, with z to 3 digits.
    """
    entry = F.struct((-F.round(F.abs("z"), 9)).alias("o"), F.col("feature"), F.round("z", 3).alias("value"))
    days = z.groupBy("user", "day").agg(F.avg(F.abs("z")).alias("m"), F.slice(F.array_sort(F.collect_list(entry)), 1, top).alias("t"))
    score = F.round(F.least(F.lit(1.0), F.col("m") / 3), 4)
    names = F.transform("t", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
    return days.where(F.col("m") / 3 >= floor).select("user", F.col("day").alias("date"), score.alias("score"), F.lit("open").alias("status"), names.alias("top_features"))


def top_features(rows: DataFrame, statistics: DataFrame, n: int = 3) -> DataFrame:
    """(user, day, rank, feature, z): the n features of each row with the largest signed (x - mean) / (std + 1e-8).

    `rows` has (user, day, feature, x), `statistics` (feature, mean, std), a row per feature.
    """
    scored = rows.join(F.broadcast(statistics), "feature").withColumn("z", (F.col("x") - F.col("mean")) / (F.col("std") + 1e-8))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("z", 9)).alias("o"), "feature", "z"))), 1, n)
    return scored.groupBy("user", "day").agg(best.alias("t")).select("user", "day", F.posexplode("t").alias("p", "t")).select("user", "day", (F.col("p") + 1).alias("rank"), "t.feature", "t.z")


def feature_statistics(rows: DataFrame) -> DataFrame:
    """(feature, mean, std) with the sample deviation."""
    return rows.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def load_alerts(alerts: DataFrame, status: str | None = None) -> DataFrame:
    return (alerts if status is None else alerts.where(F.col("status") == status)).orderBy(F.desc("score"))


def update_status(alerts: DataFrame, alert_id: str, status: str) -> DataFrame:
    """The alerts with one status changed; an unknown id raises KeyError."""
    if alerts.where(F.col("id") == alert_id).isEmpty():
        raise KeyError(alert_id)
    return alerts.withColumn("status", F.when(F.col("id") == alert_id, status).otherwise(F.col("status")))


def block(alerts: DataFrame, alert_id: str, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The alerts with one blocked, and the block log with its row."""
    row = alerts.where(F.col("id") == alert_id).select(F.col("id").alias("alert_id"), "user", F.current_timestamp().alias("blocked_at"))
    return update_status(alerts, alert_id, "blocked"), log.unionByName(row)


def mute(alerts: DataFrame, alert_id: str) -> DataFrame:
    """The alerts with one muted."""
    return update_status(alerts, alert_id, "muted")


def on_day(ts: Column, day: str) -> Column:
    """Between a day's midnight and the next: a range that reaches the scan."""
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    return (ts >= start) & (ts < start + F.expr("interval 1 day"))


def day_features(logs: dict[str, DataFrame], day: str, user: str | None = None) -> DataFrame:
    """The daily features of one day, or of one user on it; no row for a user without events."""
    own = lambda log: log.where(on_day(F.col("date"), day) & (F.lit(True) if user is None else F.col("user") == user))
    return daily_features({k: own(x) for k, x in logs.items()})


def score_day(logs: dict[str, DataFrame], day: str, statistics: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 0.7, top: int = 3, model: str = "model") -> DataFrame:
    """Alerts of one day, as `score_days` makes them; only that day's events are read."""
    return score_days(day_features(logs, day), statistics, score, threshold, top, model)


def score_days(features: DataFrame, statistics: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 0.7, top: int = 3, model: str = "model") -> DataFrame:
    """Alerts of daily features: id, user, date, score, status, created_at, top_features (names).

    `statistics` has (feature, mean, std) of the training days. `score` takes (user, day, feature,
    z) and returns (user, day, prob); rows above the threshold become open alerts. The id follows
    from user, date and model, so an alert has the same one whenever it is made.
    """
    rows = long_form(features, ["user", "day"]).join(F.broadcast(statistics), "feature")  # a row per feature
    z = rows.select("user", "day", "feature", ((F.col("x") - F.col("mean")) / (F.col("std") + 1e-8)).alias("z"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("z", 9)).alias("o"), "feature"))), 1, top)
    names = z.groupBy("user", "day").agg(F.transform(best, lambda x: x["feature"]).alias("top_features"))
    found = score(z).where(F.col("prob") > threshold).join(names, ["user", "day"])
    return found.select(alert_id(F.col("user"), F.col("day"), model).alias("id"), "user", F.col("day").alias("date"), F.round("prob", 4).alias("score"), F.lit("open").alias("status"), F.current_timestamp().alias("created_at"), "top_features")


def alert_id(user: Column, day: Column, model: str) -> Column:
    """32 hexadecimal digits for a user, a day and a model."""
    return F.substring(F.sha2(F.concat_ws("|", user, day.cast("string"), F.lit(model)), 256), 1, 32)


def append_alerts(alerts: DataFrame, folder: str) -> None:
    """Adds alerts to the stored ones."""
    alerts.write.mode("append").parquet(folder)


def latest_days(logs: dict[str, DataFrame]) -> DataFrame:
    """(user, last_day): the last day with any event."""
    days = [x.where(F.col("user").isNotNull()).select("user", F.to_date("date").alias("d")) for x in logs.values()]
    return reduce(DataFrame.unionByName, days).groupBy("user").agg(F.max("d").alias("last_day"))


def by_department(people: DataFrame) -> DataFrame:
    """(department, n, mean_score, top_score) of a directory; its users are found by department through `search`."""
    return people.groupBy("department").agg(F.count("*").alias("n"), F.avg("latest_score").alias("mean_score"), F.max("latest_score").alias("top_score"))


def sorted_alerts(alerts: DataFrame, by: str = "score", descending: bool = True) -> DataFrame:
    """The alerts by score or date, either way; by id among equals."""
    if by not in ("score", "date"):
        raise ValueError(f"alerts aren't sorted by {by}")
    return alerts.orderBy(F.desc(by) if descending else F.asc(by), "id")


def attack_days(windows: DataFrame, insiders: DataFrame, days: int = 28) -> DataFrame:
    """(user, start, days_in_attack): the places, from 0, of a window's calendar days that are in the user's attack."""
    joined = windows.join(insiders.select(F.col("user_id").alias("user"), "attack_start", "attack_end"), "user", "left")
    inside = F.filter(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add("window_start", i).between(F.to_date("attack_start"), F.to_date("attack_end")))
    return joined.select("user", "start", F.coalesce(inside, F.array().cast("array<int>")).alias("days_in_attack"))


def directory(alerts: DataFrame, departments: DataFrame) -> DataFrame:
    """(user, latest_score, status, alert_count, department): each user's highest alert, with the department or Unknown."""
    best = F.max(F.struct("score", (F.datediff(F.lit("1970-01-01"), "date")).alias("o"), "status"))
    users = alerts.groupBy("user").agg(best.alias("b"), F.count("*").alias("alert_count"))
    joined = users.join(departments.select(F.col("user_id").alias("user"), "department"), "user", "left")
    return joined.select("user", F.col("b.score").alias("latest_score"), F.col("b.status").alias("status"), "alert_count", F.coalesce("department", F.lit("Unknown")).alias("department"))


def search(people: DataFrame, text: str = "", department: str | None = None, band: str | None = None) -> DataFrame:
    """Rows of the directory whose user has the text, in a department and a risk band."""
    out = people.where(F.contains(F.lower("user"), F.lit(text.lower())))
    out = out if department is None else out.where(F.col("department") == department)
    return out if band is None else out.where(P.risk_band(F.col("latest_score")) == band)


TIMELINE = ("pc", "activity", "filename", "to_removable_media", "to", "size", "url")


def timeline(logs: dict[str, DataFrame], user: Column, start: str | None = None, end: str | None = None) -> DataFrame:
    """(user, date, kind, text) of a user's events from one midnight to another, in all logs."""
    out = None
    for name, log in logs.items():
        row = {c: F.col(c) if c in log.columns else F.lit(None).cast("string") for c in TIMELINE}
        kind = "usb" if name == "device" else name
        rows = log.where(user)
        rows = rows if start is None else rows.where(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
        rows = rows if end is None else rows.where(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
        rows = rows.select("user", "id", "date", F.lit(kind).alias("kind"), F.coalesce(P.describe_event(F.lit(kind), row), F.lit(kind)).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def score_history(scores: DataFrame, days: int = 30) -> DataFrame:
    """(user, day, score): the last calendar days up to the last day of all, 0 where a user has none."""
    last = scores.agg(F.max("day").alias("hi")).select(F.explode(F.sequence(F.date_sub("hi", days - 1), F.col("hi"), F.expr("interval 1 day"))).alias("day"))
    grid = scores.select("user").distinct().join(F.broadcast(last))  # as many rows as days asked for
    return grid.join(scores, ["user", "day"], "left").select("user", "day", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))


def peak_features(z: DataFrame, n: int = 5) -> DataFrame:
    """(user, feature, z): each user's n features with the largest |z| on any day, with its sign."""
    peaks = z.groupBy("user", "feature").agg(F.max_by("z", F.struct(F.abs("z"), "z")).alias("z"))
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc(F.round(F.abs("z"), 9)), "feature"))
    return peaks.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def investigation(alerts: DataFrame) -> DataFrame:
    """(user, id, status): each user's current alert, the first open one or else the first."""
    return alerts.groupBy("user").agg(F.min_by(F.struct("id", "status"), F.struct((F.col("status") != "open").alias("s"), (-F.col("score")).alias("o"), "id")).alias("a")).select("user", "a.id", "a.status")


def standardised(rows: DataFrame, train: Column, names: tuple[str, ...] = C.FEATURES) -> DataFrame:
    """The named columns minus their training mean over the sample deviation plus 1e-8."""
    stats = rows.where(train).agg(*[f(n).alias(f"{p}_{n}") for n in names for f, p in ((F.avg, "m"), (F.stddev_samp, "s"))])
    joined = rows.join(F.broadcast(stats))  # one row
    return joined.select(*[c for c in rows.columns if c not in names], *[((F.col(n) - F.col(f"m_{n}")) / (F.col(f"s_{n}") + 1e-8)).alias(n) for n in names])


def traits(people: DataFrame, users: DataFrame, names: str = "OCEAN") -> DataFrame:
    """Personality scores minus their mean over the population deviation plus 1e-8; 0 for users without any."""
    stats = people.agg(*[f(n).alias(f"{p}_{n}") for n in names for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))])
    joined = users.join(people, users.user == people.user_id, "left").join(F.broadcast(stats))  # one row
    return joined.select("user", *[F.coalesce((F.col(n) - F.col(f"m_{n}")) / (F.col(f"s_{n}") + 1e-8), F.lit(0.0)).alias(n) for n in names])


def vocabulary(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, idx): distinct values numbered by first appearance from 1; 0 is for unknown ones. As many rows as categories."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("o"))
    return first.select(value, F.row_number().over(Window.orderBy("o", value)).alias("idx"))
