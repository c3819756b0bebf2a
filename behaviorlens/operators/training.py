"""Splits, training sets, cross-validation, ablations and comparisons of detectors.

Everything that is counted or compared is a plain aggregate over tables of scores, folds and
windows; what trains is given as a function, so that these hold for any detector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.config import WindowConfig
from behaviorlens.operators import daily as D
from behaviorlens.operators import evaluation as E
from behaviorlens.operators import scoring as S
from behaviorlens.operators import windows as W
from behaviorlens.sources.csv_logs import exists
from behaviorlens.sources.store import written

#: Window sizes that the ablation tries, in days.
ABLATION_SIZES = (7, 14, 28, 56)
METRICS = ("auprc", "auroc", "best_f1", "median_days")


#: What a training has to be told.
REQUIRED = ("epochs", "batch_size", "patience", "learning_rate", "layers")


def validate_config(values: dict, required: Iterable[str] = ()) -> dict:
    """The values themselves; ValueError names those that no training can use, and required ones that are absent.

    Counts are positive whole numbers, rates positive numbers, and the last layer has one unit.
    """
    wrong = [name for name in required if name not in values]
    for name, x in values.items():
        if name == "layers":
            if not x or x[-1] != 1 or any(not isinstance(n, int) or isinstance(n, bool) or n <= 0 for n in x):
                wrong.append(name)
        elif name.endswith(("rate", "decay", "alpha", "gamma")):
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not x > 0:
                wrong.append(name)
        elif isinstance(x, bool) or not isinstance(x, int) or x <= 0:
            wrong.append(name)
    if wrong:
        raise ValueError(f"unusable values of {', '.join(sorted(wrong))}")
    return values


def imbalance(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: rows, positives and the share of positives."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(label).alias("share"))


def split_features(logs: dict[str, DataFrame], insiders: DataFrame, train_end: str, validation_end: str, inclusive_end_day: bool = False) -> DataFrame:
    """Daily features with `split` and `is_malicious`.

    Each event goes to the split that its own time is in, so a day that a split's end cuts through
    has a row in both, as features of separate splits have.
    """
    split = D.time_split(F.col("date"), train_end, validation_end, inclusive_end_day)
    rows = D.daily_features({k: x.withColumn("split", split) for k, x in logs.items()}, by=("split",))
    return D.label_days(rows, D.malicious_days(insiders))


def split_summary(rows: DataFrame) -> DataFrame:
    """(split, rows, users, malicious, ratio)."""
    m = F.sum(F.col("is_malicious").cast("long"))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("user").alias("users"), m.alias("malicious"), (m / F.count("*")).alias("ratio"))


def training_set(rows: DataFrame, names: tuple[str, ...] = C.FEATURES, embeddings: DataFrame | None = None) -> DataFrame:
    """The rows of all splits with features scaled by the training rows alone, and each user's embedding, unscaled, if there are any.

    `embeddings` has (user, vector); a user without one has null.
    """
    scaled = S.standardised(rows, F.col("split") == "train", names)
    return scaled if embeddings is None else scaled.join(embeddings.select("user", F.col("vector").alias("embedding")), "user", "left")


def split_windows(days: DataFrame, insiders: DataFrame, share: float = 0.2, seed: int = 42, config: WindowConfig = WindowConfig()) -> DataFrame:
    """The labelled windows with `held`: all windows of a user are in one part, and insiders are dealt evenly."""
    users = days.select("user").distinct().join(insiders.select(F.col("user_id").alias("user"), F.lit(1).alias("_i")).distinct(), "user", "left")
    parts = E.holdout(users, share, seed, F.coalesce("_i", F.lit(0))).select("user", "held")
    return W.label_windows(W.window_rows(days.select("user", "day"), config), insiders, config).join(parts, "user")


def inner_holdout(rows: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """The windows with `held` for about `share` of them, by a hash of user and start; a user may be on both sides."""
    return rows.withColumn("held", F.pmod(F.xxhash64("user", "start", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def cross_validate(rows: DataFrame, fit: Callable[[DataFrame, Column, int], DataFrame], insiders: DataFrame, n: int = 5, seeds: Iterable[int] = (42,), threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scores of all rows, out of fold, for each seed; and the metrics of each seed and fold.

    `rows` has user, window_start and label. `fit` takes all rows, which of them are held out, and
    the seed, fits on the others and returns the scores (user, window_start, label, prob) of those.
    """
    rows = written(rows)  # so that features are made once, and not for each fold and metric
    users, scores = rows.groupBy("user").agg(F.max("label").alias("_p")), []
    for seed in seeds:
        dealt = written(rows.join(E.folds(users, n, seed, F.col("_p")).drop("_p"), "user"))
        for k in range(n):
            found = fit(dealt, F.col("fold") == k, seed)
            scores.append(found.withColumns({"seed": F.lit(seed), "fold": F.lit(k)}))
    scored = written(reduce(DataFrame.unionByName, scores))
    return scored, fold_metrics(scored, insiders, threshold)


def fold_metrics(scored: DataFrame, insiders: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(seed, fold, auprc, auroc, best_f1, median_days) of scored windows; median_days is null where no attack was found."""
    ranking = E.ranking_metrics(scored, ["seed", "fold"]).drop("best_threshold")
    first = scored.where(F.col("prob") > threshold).groupBy("seed", "fold", "user").agg(F.min("window_start").alias("first"))
    days = first.join(insiders, first.user == insiders.user_id).select("seed", "fold", F.floor(F.timestamp_diff("SECOND", F.col("attack_start"), F.col("first")) / 86400).alias("days"))
    return ranking.join(days.groupBy("seed", "fold").agg(F.median("days").alias("median_days")), ["seed", "fold"], "left")


def cross_validation_summary(metrics: DataFrame) -> DataFrame:
    """(metric, mean, std): mean and population deviation of the folds within a seed, and the means of both over the seeds; nulls don't count."""
    long = metrics.select("seed", "fold", *[F.col(m).cast("double") for m in METRICS]).unpivot(["seed", "fold"], list(METRICS), "metric", "value")
    seeds = long.groupBy("metric", "seed").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return seeds.groupBy("metric").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def max_history(days: DataFrame) -> DataFrame:
    """One row: the most active days of any user."""
    return days.groupBy("user").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_days"))


def window_ablation(days: DataFrame, insiders: DataFrame, sizes: tuple[int, ...] = ABLATION_SIZES, stride: int = 7, score: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(size, n_windows, positives, status) of each window size: ok, or why it is skipped.

    With `score` there are `auprc` of the sizes that are ok, null for others, and `is_best`, the
    size with the largest one, the smaller size among equals. `score` takes the rows of the windows
    of one size (user, start, idx, day) and their labels (user, start, window_start, label) and
    returns (user, start, label, prob); what it fits, it has to fit out of fold.
    """
    history = max_history(days).first()
    longest = history[0] if history and history[0] else 0
    parts = []
    for size in sizes:
        config = WindowConfig(size=size, stride=stride)
        rows = W.window_rows(days.select("user", "day"), config)
        labelled = W.label_windows(rows, insiders, config)
        labelled = labelled if score is None else written(labelled)
        counts = labelled.agg(F.count("*").alias("n_windows"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("positives"))
        status = F.when(F.lit(longest < size), "skipped_insufficient_history").when(F.col("positives") == 0, "skipped_no_positive_windows").otherwise("ok")
        part = counts.select(F.lit(size).alias("size"), "n_windows", "positives", status.alias("status"))
        if score is not None:
            auprc = F.lit(None).cast("double").alias("auprc")
            if longest >= size and not labelled.where("label = 1").isEmpty():
                part = part.join(F.broadcast(E.ranking_metrics(score(rows, labelled).select("label", "prob"), []).select("auprc")))  # one row each
            else:
                part = part.withColumn("auprc", auprc)
        parts.append(part)
    out = reduce(DataFrame.unionByName, parts)
    if score is None:
        return out
    out = written(out)  # as many rows as sizes
    best = out.where("auprc is not null").agg(F.max_by("size", F.struct("auprc", -F.col("size"))).alias("_best"))
    return out.join(F.broadcast(best)).withColumn("is_best", F.coalesce(F.col("size") == F.col("_best"), F.lit(False))).drop("_best")


def feature_importance(model, names: tuple[str, ...], n: int = 20) -> list[tuple[str, float]]:
    """The n features of a tree model that it splits on with most gain, by name among equals; those without any are left out."""
    found = [(names[i], float(x)) for i, x in enumerate(model.featureImportances.toArray()) if x > 0]
    return sorted(found, key=lambda x: (-x[1], x[0]))[:n]


def save_results(spark: SparkSession, folder: str, model: str, values: dict) -> None:
    """One JSON row of a model's results, in a folder of its name; what was there is replaced."""
    row = spark.range(1).select(F.lit(model).alias("model"), *[F.lit(v).alias(k) for k, v in values.items()])
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/model={model}")


def compare_models(spark: SparkSession, folder: str, models: Iterable[str]) -> DataFrame:
    """(model, auprc, auroc, best_f1) of the models that have results with an auprc, best first; others are left out."""
    ddl = "model string, auprc double, auroc double, best_f1 double"
    there = [f"{folder}/model={m}" for m in models if exists(spark, f"{folder}/model={m}")]
    rows = spark.read.schema(ddl).json(there) if there else spark.createDataFrame([], ddl)
    return rows.where("auprc is not null").orderBy(F.desc("auprc"), "model")


#: The areas that a baseline has to exceed, and by which one rung has to exceed the one before it.
GATES = {"baseline": 0.20, "temporal": 0.03, "graph": 0.02}


def gates(results: DataFrame) -> DataFrame:
    """(gate, value, needed, passed) from (rung, auprc), several models to a rung, of which the best counts.

    The best baseline is measured by its own area, the temporal rung by what it is above that, the
    graph rung by what it is above the temporal one. Without one of the two, value is null and the gate isn't passed.
    """
    best = results.agg(*[F.max(F.when(F.col("rung") == r, F.col("auprc"))).alias(r) for r in GATES])
    values = {"baseline": F.col("baseline"), "temporal": F.col("temporal") - F.col("baseline"), "graph": F.col("graph") - F.col("temporal")}
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), values[g].alias("value"), F.lit(x).alias("needed")) for g, x in GATES.items()])
    met = F.when(F.col("gate") == "baseline", F.col("value") > F.col("needed")).otherwise(F.round("value", 12) >= F.col("needed"))
    return best.select(F.explode(rows).alias("g")).select("g.*").withColumn("passed", F.coalesce(met, F.lit(False)))


def confusion_shares(counts: DataFrame) -> DataFrame:
    """The four counts as shares of their true class; 0 for a class without rows."""
    of = lambda part, *whole: F.coalesce(F.col(part) / F.nullif(reduce(lambda a, b: a + b, [F.col(w) for w in whole]), F.lit(0)), F.lit(0.0)).alias(f"{part}_share")
    return counts.select(of("tn", "tn", "fp"), of("fp", "tn", "fp"), of("fn", "fn", "tp"), of("tp", "fn", "tp"))


def focal_loss(prob: Column, label: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    """The focal loss of a probability."""
    p = F.least(F.greatest(prob, F.lit(1e-7)), F.lit(1 - 1e-7))
    right = F.when(label == 1, p).otherwise(1 - p)
    return -F.when(label == 1, alpha).otherwise(1 - alpha) * F.pow(1 - right, F.lit(gamma)) * F.log(right)


def static_features(users: DataFrame, people: DataFrame, roles: DataFrame, departments: DataFrame, directory: DataFrame) -> DataFrame:
    """(user, O, C, E, A, N, role, department): scaled traits of the given people, and vocabulary numbers, 0 for what is unknown.

    `roles` and `departments` are vocabularies (value, idx); another version's users meet those
    they were trained with, and traits are scaled among the users' own version.
    """
    named = S.traits(people, users).join(directory.select(F.col("user_id").alias("user"), F.col("role").alias("_r"), F.col("department").alias("_d")).dropDuplicates(["user"]), "user", "left")
    r, d = roles.toDF("_r", "_ri"), departments.toDF("_d", "_di")
    out = named.join(r, "_r", "left").join(d, "_d", "left")
    return out.select("user", *"OCEAN", F.coalesce("_ri", F.lit(0)).cast("long").alias("role"), F.coalesce("_di", F.lit(0)).cast("long").alias("department"))


def score_version(fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], source: DataFrame, target: DataFrame, insiders: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scores of one version's windows by a detector fitted on another's, and their metrics.

    `fit` takes the source's rows and returns what scores rows (user, window_start, label, prob).
    """
    scored = fit(source)(target).withColumns({"seed": F.lit(0), "fold": F.lit(0)})
    return scored, fold_metrics(scored, insiders, threshold).drop("seed", "fold")


def samples_by_period(windows: DataFrame, periods: DataFrame, nodes: DataFrame) -> DataFrame:
    """The windows that have a graph of the same period and a node of their user: with `period`, in order of their start, and `node`."""
    numbered = periods.select("window_start", "window_end").distinct().withColumn("period", F.row_number().over(Window.orderBy("window_start", "window_end")) - 1)  # as many as periods
    return windows.join(numbered, ["window_start", "window_end"]).join(nodes.select("user", F.col("idx").alias("node")), "user")


def period_batches(samples: DataFrame, seed: int, epoch: int) -> DataFrame:
    """(place, period, rows): one batch per period, in an order that each epoch shuffles anew and a seed fixes."""
    sizes = samples.groupBy("period").agg(F.count("*").alias("rows"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("period", F.lit(seed + epoch)), "period")) - 1).select("place", "period", "rows")
