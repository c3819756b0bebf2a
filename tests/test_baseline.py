import datetime as dt

import numpy as np
import pytest

from behaviorlens import config as C
from behaviorlens.config import BaselineConfig, WindowConfig
from behaviorlens.operators import baseline as B
from behaviorlens.operators import windows as W

START = dt.date(2010, 1, 1)


def frame(spark, series):
    """One column of values for each user in all features."""
    rows = [(u, START + dt.timedelta(days=i), *[float(x)] * len(C.FEATURES)) for u, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "user string, day date, " + ", ".join(f"{n} double" for n in C.FEATURES))


def reference(xs, mean=None, var=None, floor=0.1, a=0.05, n=14):
    """The recursion in plain Python."""
    xs, start = np.asarray(xs, float), 0
    if mean is None:
        if len(xs) < n:
            return np.zeros(len(xs))
        mean, var, start = xs[:n].mean(), xs[:n].var(), n
    out = np.zeros(len(xs))
    for i in range(start, len(xs)):
        out[i] = (xs[i] - mean) / max(np.sqrt(var + 1e-6), floor)
        mean = (1 - a) * mean + a * xs[i]
        var = (1 - a) * var + a * (xs[i] - mean) ** 2
    return out


def scores(z, user, feature="logon_count"):
    return np.array([r.z for r in z.where(f"user = '{user}' and feature = '{feature}'").orderBy("day").collect()])


def test_recursion_and_no_look_ahead(spark):
    rng = np.random.default_rng(0)
    series = {"a": rng.poisson(3, 40), "constant": [5] * 30, "spike": [*rng.poisson(3, 29), 60], "short": [1, 2, 3]}
    z = B.deviations(frame(spark, series))
    for user, xs in series.items():
        assert scores(z, user) == pytest.approx(reference(xs), abs=1e-9)
    assert scores(z, "spike")[-1] > 3 and not scores(z, "constant").any() and not scores(z, "short").any()
    longer = B.deviations(frame(spark, {"a": [*series["a"], 99, 0]}))
    assert scores(longer, "a")[:40] == pytest.approx(scores(z, "a"), abs=1e-12)
    shuffled = B.deviations(frame(spark, series).orderBy("logon_count").repartition(3))
    assert scores(shuffled, "a") == pytest.approx(scores(z, "a"), abs=1e-12)


def test_cold_start_from_a_cohort(spark):
    series = {"new": [5.0] * 5}
    prior = spark.createDataFrame([("new", n, 0.0, 1.0) for n in C.FEATURES], "user string, feature string, mean double, var double")
    z = B.deviations(frame(spark, series), prior)
    assert scores(z, "new") == pytest.approx(reference([5.0] * 5, 0.0, 1.0), abs=1e-9)


def test_cohorts_fall_back(spark):
    users = [f"e{i}" for i in range(5)] + ["admin", "stranger"]
    f = frame(spark, {u: [1, 2, 3] for u in users})
    ldap = spark.createDataFrame([(u, "Engineer", "Lab") for u in users[:5]] + [("admin", "Admin", "Lab"), ("nodata", "Admin", "Lab")], "user_id string, role string, department string")
    got = {r.user: (r.level, r.cohort) for r in B.assign_cohorts(f, ldap, 5).collect()}
    assert got["e0"] == ("role", "Engineer") and got["admin"] == ("department", "Lab") and got["stranger"] == ("global", "all")
    stats = {(r.level, r.cohort): r for r in B.cohort_statistics(f, ldap, 5).where("feature = 'logon_count'").collect()}
    assert set(stats) == {("role", "Engineer"), ("department", "Lab"), ("global", "all")}
    assert stats["global", "all"].users == 7 and stats["role", "Engineer"].var == pytest.approx(2 / 3)
    assert B.median_user_std(f).where("feature = 'logon_count'").first().median_std == pytest.approx(1.0)


def test_gate(spark):
    rng = np.random.default_rng(1)
    series = {u: rng.normal(3, 0.5, 60) for u in ("n1", "n2", "ins")}
    series["ins"][40:56] = rng.normal(15, 0.5, 16)
    insiders = spark.createDataFrame([("ins", 1, START + dt.timedelta(40), START + dt.timedelta(55))], "user_id string, scenario int, attack_start date, attack_end date")
    z = B.deviations(frame(spark, series))
    row = B.validate(z, insiders).first()
    assert row.passed and row.attack > 2 and row.lift > 1
    assert B.daily_magnitude(z).where("user = 'n1'").agg({"mean_abs_z": "avg"}).first()[0] < 2
    assert set(C.FEATURES) <= set(B.wide_deviations(z).columns)


def test_windows(spark):
    rng = np.random.default_rng(2)
    days = spark.createDataFrame([(u, START + dt.timedelta(i), float(rng.normal())) for u in ("ins", "ok") for i in range(90)], "user string, day date, z double").withColumn("feature", W.F.lit("logon_count"))
    rows = W.window_rows(days, WindowConfig())
    assert rows.select("user", "start").distinct().count() == 2 * 9 and rows.count() == 2 * 9 * 28
    insiders = spark.createDataFrame([("ins", 2, START + dt.timedelta(50), START + dt.timedelta(65))], "user_id string, scenario int, attack_start date, attack_end date")
    kept = W.label_windows(rows, insiders)
    every = W.label_windows(rows, insiders, keep_excluded=True)
    assert every.count() == 18 and 0 < kept.where("label = 1").count() and kept.where("user = 'ok' and label <> 0").count() == 0
    assert every.where("label = -1").count() == every.where("overlap > 0 and overlap < 0.5").count() > 0
    assert W.window_rows(days.limit(5)).count() == 0
    stats = W.window_statistics(rows).where("user = 'ok' and start = 7").first()
    z = np.array([r.z for r in rows.where("user = 'ok' and start = 7").orderBy("idx").collect()])
    assert stats.max_dev == pytest.approx(abs(z).max()) and stats.std_dev == pytest.approx(z.std()) and stats.trend == pytest.approx(np.polyfit(range(28), z, 1)[0])


def test_bursts(spark):
    z = [0, 3, -4, 0, 2.5, 1, 2, 9]
    rows = spark.createDataFrame([("u", 0, "f", i, float(x)) for i, x in enumerate(z)], "user string, start int, feature string, idx int, z double")
    assert W.max_bursts(rows).first().max_burst == 9.0
    assert W.max_bursts(rows.where("idx < 7")).first().max_burst == 7.0
    assert W.cross_statistics(rows).first().anomalous_days == 4
    assert BaselineConfig().alpha == 0.05


def test_ties_in_metrics(spark):
    from behaviorlens.operators import evaluation as E

    rows = [(i, p, l) for i, (p, l) in enumerate([(0.9, 1), (0.9, 0), (0.5, 1), (0.2, 0), (0.2, 1), (0.1, 0)])]
    scored = spark.createDataFrame([("m", *r) for r in rows], "model string, id int, prob double, label int")
    got = E.ranking_metrics(scored, ["model"]).first()
    # By hand: recall 1/3, 2/3, 1 at precision 1/2, 2/3, 3/5; nine pairs of which five and two halves are in order.
    assert got.auprc == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3) and got.auroc == pytest.approx((2 + 0.5 + 2 + 1 + 0.5) / 9)
    assert got.best_f1 == pytest.approx(0.75) and got.best_threshold == 0.2
    one = E.ranking_metrics(scored.where("label = 0"), ["model"]).first()
    assert (one.auprc, one.auroc, one.best_threshold) == (0.0, 0.0, 0.5)
    folds = E.folds(scored.select(W.F.concat(W.F.lit("u"), "id").alias("user"), "label"), 3, 1, W.F.col("label"))
    assert folds.count() == 6
    assert "auprc" in E.results_table([{"model": "m", "auprc": 0.5, "auroc": 0.5, "best_f1": 1.0}])
