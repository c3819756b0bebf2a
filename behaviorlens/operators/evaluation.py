"""Metrics of detectors from scored rows, as plain aggregates and windows.

Scores are first counted by distinct value, so ties are one threshold and the running sums are over
thresholds, not rows. Running sums go through stretches of thresholds between approximate quantiles,
each in a task of its own, and the sums of the stretches above are added; so one model with as many
scores as rows is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of thresholds whose running sums are made apart, and buckets of ranks in a stratum.
STRETCHES, BUCKETS = 64, 1024


def threshold_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, prob, tp and fp at or above the threshold, p and n in all."""
    counts = scored.groupBy(*by, "prob").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("all"))
    counts = counts.select(*by, "prob", "pos", (F.col("all") - F.col("pos")).alias("neg"))
    quantiles = F.percentile_approx("prob", [i / STRETCHES for i in range(1, STRETCHES)], 1000)
    totals = counts.groupBy(*by).agg(quantiles.alias("_q"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # a row per group
    rows = counts.join(totals, by) if by else counts.join(F.broadcast(totals))
    rows = rows.withColumn("_b", F.size(F.filter("_q", lambda q: q > F.col("prob")))).drop("_q")
    sums = rows.groupBy(*by, "_b").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))  # at most STRETCHES rows per group
    above = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in ("tp", "fp")])
    down = Window.partitionBy(*by, "_b").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)}).join(sums, [*by, "_b"])
    return out.select(*by, "prob", "pos", "neg", (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"), "p", "n")


def ranking_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, auprc, auroc, best_f1, best_threshold from (by, prob, label).

    The area under precision and recall is the sum of its steps; the best F1 has the lowest of its
    thresholds. With one class alone all are 0 and the threshold is 0.5.
    """
    t = threshold_counts(scored, by)
    precision, f1 = F.col("tp") / (F.col("tp") + F.col("fp")), 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    out = t.where(both).groupBy(*by).agg(
        (F.sum(F.col("pos") * precision) / F.max("p")).alias("auprc"),
        (F.sum(area) / (F.max("p") * F.max("n"))).alias("auroc"),
        F.max(f1).alias("best_f1"),
        F.max_by("prob", F.struct(F.round(f1, 12), -F.col("prob"))).alias("best_threshold"),
    )
    groups = scored.select(*by).distinct()
    joined = groups.join(out, by, "left") if by else groups.join(out)
    return joined.fillna({"auprc": 0.0, "auroc": 0.0, "best_f1": 0.0, "best_threshold": 0.5})


def precision_at(scored: DataFrame, by: list[str], ks: tuple[int, ...] = (10, 20, 50), tie: str = "id") -> DataFrame:
    """by and p_at_k for each k: of the k best rows, or of all if there are fewer; equal scores by `tie`."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("prob"), tie))
    top = scored.withColumn("_r", rank).where(F.col("_r") <= max(ks))
    return top.groupBy(*by).agg(*[F.avg(F.when(F.col("_r") <= k, F.col("label"))).alias(f"p_at_{k}") for k in ks])


def by_scenario(scored: DataFrame) -> DataFrame:
    """The rows once for each scenario that is not 0: its own positives and all benign rows."""
    scenarios = scored.where("scenario <> 0").agg(F.collect_set("scenario").alias("_s"))  # one row, as long as there are scenarios
    benign = scored.where("label = 0").join(F.broadcast(scenarios)).withColumn("for_scenario", F.explode("_s")).drop("_s")
    own = scored.where("scenario <> 0 and label = 1").withColumn("for_scenario", F.col("scenario"))
    return own.unionByName(benign)


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp and precision, recall and F1."""
    hit, pos = F.col("prob") >= threshold, F.col("label") == 1
    counts = scored.agg(*[F.count_if(c).alias(n) for n, c in (("tn", ~hit & ~pos), ("fp", hit & ~pos), ("fn", ~hit & pos), ("tp", hit & pos))])
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-8), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-8)
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))


def detection_latency(flagged: DataFrame, insiders: DataFrame, threshold: float) -> DataFrame:
    """(user, days) from the attack's start to the start of the first window above the threshold, as whole days that have passed, rounded down; null if none."""
    first = flagged.where(F.col("prob") > threshold).groupBy("user").agg(F.min("window_start").alias("first"))
    joined = insiders.join(first, insiders.user_id == first.user, "left")
    return joined.select(F.col("user_id").alias("user"), F.floor(F.timestamp_diff("SECOND", F.col("attack_start"), F.col("first")) / 86400).cast("int").alias("days"))


def latency_summary(latency: DataFrame) -> DataFrame:
    return latency.agg(F.count("days").alias("detected"), F.count("*").alias("total"), F.median("days").alias("median_days"), F.percentile("days", 0.9).alias("p90_days"))


def ranked(users: DataFrame, seed: int, stratum: Column) -> DataFrame:
    """The rows with `_s`, the stratum, `_r`, the place in it from 0 by a seeded hash, and `_n`, its size.

    The hash's high bits are buckets of about equal size in each stratum. Places are counted inside
    a bucket and shifted by the buckets before it, so no stratum is sorted in one task.
    """
    rows = users.withColumns({"_s": stratum, "_h": F.xxhash64("user", F.lit(seed))}).withColumn("_b", F.pmod(F.shiftright("_h", 40), F.lit(BUCKETS)))
    sizes = rows.groupBy("_s", "_b").agg(F.count("*").alias("_c"))  # at most BUCKETS rows per stratum
    own = Window.partitionBy("_s")
    before = F.coalesce(F.sum("_c").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), before.alias("_f"), F.sum("_c").over(own).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "user")) - 1
    placed = rows.withColumn("_i", inside).join(sizes, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    return placed.withColumn("_r", F.col("_i") + F.col("_f")).drop("_h", "_b", "_i", "_f", "_s2", "_b2")


def folds(users: DataFrame, n: int, seed: int, stratum: Column) -> DataFrame:
    """(user, fold): users dealt to folds within each stratum; the folds of a stratum differ by one user at most."""
    return ranked(users, seed, stratum).withColumn("fold", F.pmod("_r", F.lit(n)).cast("int")).drop("_s", "_r", "_n")


def holdout(users: DataFrame, share: float, seed: int, stratum: Column) -> DataFrame:
    """The users with `held`: true for round(n * share) of the n users of each stratum."""
    return ranked(users, seed, stratum).withColumn("held", F.col("_r") < F.round(F.col("_n") * share)).drop("_s", "_r", "_n")


def results_table(rows: list[dict], columns: tuple[str, ...] = ("model", "auprc", "auroc", "best_f1")) -> str:
    """Fixed-width text of a few result rows."""
    text = [[c for c in columns]] + [[f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]
    widths = [max(map(len, col)) for col in zip(*text)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in text)
