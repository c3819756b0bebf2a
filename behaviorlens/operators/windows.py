"""Sliding windows of active days: cutting, labels, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.config import WindowConfig


def window_rows(days: DataFrame, config: WindowConfig = WindowConfig(), key: str = "user", order: str = "day") -> DataFrame:
    """Each row of `days` once for each window that it is in, with `start` (first row, from 0) and `idx`.

    Windows count rows, not calendar days. A row is sent to the few windows that it is in; nothing
    is joined.
    """
    own = Window.partitionBy(key)
    rows = days.withColumns({"_rn": F.row_number().over(own.orderBy(order)) - 1, "_n": F.count("*").over(own)})
    stride, size = config.stride, config.size
    lowest = F.greatest(F.lit(0), F.ceil((F.col("_rn") - size + 1) / stride).cast("int"))
    highest = F.least(F.floor(F.col("_rn") / stride), F.floor((F.col("_n") - size) / stride)).cast("int")
    rows = rows.where((F.col("_n") >= size) & (highest >= lowest))
    out = rows.withColumn("start", F.explode(F.transform(F.sequence(lowest, highest), lambda w: w * stride)))
    return out.withColumn("idx", F.col("_rn") - F.col("start")).drop("_rn", "_n")


def label_windows(rows: DataFrame, insiders: DataFrame, config: WindowConfig = WindowConfig(), keep_excluded: bool = False) -> DataFrame:
    """(user, start, window_start, window_end, overlap, label, scenario) of the windows of `window_rows`.

    The overlap is the share of a window's rows inside the user's attack. From `positive` on the
    label is 1; without any it is 0; in between the window is left out, or has label -1.
    """
    attacks = insiders.groupBy("user_id").agg(F.max_by(F.struct("attack_start", "attack_end", "scenario"), "attack_start").alias("a"))
    joined = rows.select("user", "start", "day").join(attacks, rows.user == attacks.user_id, "left")
    inside = F.coalesce(F.col("day").between(F.to_date("a.attack_start"), F.to_date("a.attack_end")), F.lit(False))
    out = joined.groupBy("user", "start").agg(
        F.min("day").alias("window_start"), F.max("day").alias("window_end"), F.avg(inside.cast("int")).alias("overlap"), F.max("a.scenario").alias("scenario")
    )
    label = F.when(F.col("overlap") >= config.positive, 1).when(F.col("overlap") == 0, 0).otherwise(-1)
    out = out.withColumn("label", label).withColumn("scenario", F.when(F.col("label") == 1, F.col("scenario")).otherwise(0))
    return out if keep_excluded else out.where("label >= 0")


def window_statistics(rows: DataFrame) -> DataFrame:
    """Seven statistics of each feature of each window from (user, start, idx, feature, z)."""
    bursts = max_bursts(rows)
    stats = rows.groupBy("user", "start", "feature").agg(
        F.max(F.abs("z")).alias("max_dev"),
        F.avg(F.abs("z")).alias("mean_dev"),
        F.stddev_pop("z").alias("std_dev"),
        F.count_if(F.abs("z") > 2).alias("days_2s"),
        F.count_if(F.abs("z") > 3).alias("days_3s"),
        F.coalesce(F.regr_slope("z", F.col("idx").cast("double")), F.lit(0.0)).alias("trend"),
    )
    return stats.join(bursts, ["user", "start", "feature"], "left").withColumn("max_burst", F.coalesce("max_burst", F.lit(0.0)))


def max_bursts(rows: DataFrame) -> DataFrame:
    """The largest sum of |z| over a run of consecutive days with |z| > 2; windows without one are left out."""
    by = Window.partitionBy("user", "start", "feature").orderBy("idx")
    high = rows.where(F.abs("z") > 2).withColumn("island", F.col("idx") - F.row_number().over(by))
    runs = high.groupBy("user", "start", "feature", "island").agg(F.sum(F.abs("z")).alias("s"))
    return runs.groupBy("user", "start", "feature").agg(F.max("s").alias("max_burst"))


def cross_statistics(rows: DataFrame) -> DataFrame:
    """Statistics over all features of a window: anomalous days, most features on a day, mean |z|."""
    days = rows.groupBy("user", "start", "idx").agg(F.count_if(F.abs("z") > 2).alias("hits"), F.sum(F.abs("z")).alias("s"), F.count("*").alias("n"))
    return days.groupBy("user", "start").agg(F.count_if(F.col("hits") > 0).alias("anomalous_days"), F.max("hits").alias("max_features"), (F.sum("s") / F.sum("n")).alias("mean_total"))


def flattened(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(user, start, values): each window as one array, feature after feature."""
    rank = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    cells = rows.groupBy("user", "start").agg(F.array_sort(F.collect_list(F.struct(rank.alias("f"), "idx", "z"))).alias("c"))
    return cells.select("user", "start", F.transform("c", lambda x: x["z"]).alias("values"))


def with_traits(windows: DataFrame, traits: DataFrame, names: str = "OCEAN") -> DataFrame:
    """The flattened windows with their user's traits behind the values; 0 for a user without any."""
    known = traits.select("user", *[F.col(n).alias(f"_{n}") for n in names])
    own = F.array(*[F.coalesce(F.col(f"_{n}").cast("double"), F.lit(0.0)) for n in names])
    return windows.join(known, "user", "left").withColumn("values", F.concat("values", own)).drop(*[f"_{n}" for n in names])


def tail(days: DataFrame, n: int = 28, key: str = "user", order: str = "day") -> DataFrame:
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return days.withColumn("_n", last).where(F.col("_n") <= n).drop("_n")


def attention(magnitude: DataFrame, value: str = "mean_abs_z") -> DataFrame:
    """Softmax weights over the days of each user, uniform where all values are 0."""
    w = Window.partitionBy("user")
    e = F.exp(F.col(value) - F.max(value).over(w))
    return magnitude.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def calendar_windows(low: Column, high: Column, size: int = 28, stride: int = 7) -> Column:
    """Window starts from the first day, while the window's last day isn't after the end."""
    starts = F.sequence(low, high, F.expr(f"interval {stride} days"))
    return F.filter(starts, lambda s: F.date_add(s, size - 1) <= high)
