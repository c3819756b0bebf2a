"""Streams: daily features with a watermark, and the moving-average baseline as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from behaviorlens.config import BaselineConfig
from behaviorlens.operators.daily import measures

_EXACT = {"unique_pcs_used": "pc", "unique_filenames": "filename"}


def daily_counts(log: DataFrame, kind: str, watermark: str = "2 days") -> DataFrame:
    """(user, day, features) of one log's stream, a day at a time, late rows within the watermark.

    Distinct counts are approximate in a stream, as exact ones would keep every value as state.
    """
    rows = log.where(F.col("user").isNotNull()).withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", watermark)
    totals = []
    for name, column in measures()[kind].items():
        if name in _EXACT:
            totals.append(F.approx_count_distinct(column).alias(name))
        else:
            totals.append(F.coalesce(F.sum(column.cast("double")), F.lit(0.0)).alias(name))
    return rows.groupBy("user", F.window("ts", "1 day")).agg(*totals).select("user", F.to_date("window.start").alias("day"), *measures()[kind])


def moving_deviations(days: DataFrame, names: list[str], floors: list[float], config: BaselineConfig = BaselineConfig()) -> DataFrame:
    """(user, day, z) of a stream of (user, day, x), x an array of the named features.

    The state of a user is the running mean and variance, and the first days until there are
    enough to seed them. Days have to come in order; one not after the last is dropped.
    """
    n, alpha, eps, least = config.min_history, config.alpha, config.epsilon, np.array(floors)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, head, mean, var = state.get if state.exists else (-1, [], [], [])
        head, m, v, out = list(np.array(head, float).reshape(-1, len(names))), np.array(mean, float), np.array(var, float), []
        rows = pd.concat(list(batches)).sort_values("day")
        for d, x in zip(rows["day"], rows["x"]):
            number = pd.Timestamp(d).toordinal()
            if number <= last:
                continue
            last, x = number, np.asarray(x, float)
            if len(m):
                z = (x - m) / np.maximum(np.sqrt(v + eps), least)
                m = (1 - alpha) * m + alpha * x
                v = (1 - alpha) * v + alpha * (x - m) ** 2
            else:
                z, head = np.zeros(len(x)), [*head, x]
                if len(head) == n:
                    m, v, head = np.mean(head, axis=0), np.var(head, axis=0), []
            out.append((key[0], d, z.tolist()))
        state.update((last, np.array(head).ravel().tolist(), m.tolist(), v.tolist()))
        yield pd.DataFrame(out, columns=["user", "day", "z"])

    schema = "last bigint, head array<double>, mean array<double>, var array<double>"
    return days.groupBy("user").applyInPandasWithState(run, "user string, day date, z array<double>", schema, "append", GroupStateTimeout.NoTimeout)
