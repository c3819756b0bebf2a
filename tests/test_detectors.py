import os

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import models as M
from behaviorlens.plans import daily_queries as DQ
from behaviorlens.plans import serving_queries as SQ

SF = "/root/testdata/sf0.001"


def test_every_row_is_scored_without_its_user(spark):
    rows = spark.createDataFrame([(f"u{u}", d, int(u % 4 == 0)) for u in range(20) for d in range(3)], "user string, day int, label int")
    trained = []

    def fit(rows, held):
        users = {r.user for r in rows.where(~held).select("user").distinct().collect()}
        trained.append(users)
        return rows.where(held).select("user", "day", F.col("user").isin(*users).alias("seen"))

    got = M.out_of_fold(rows, fit).collect()
    assert sorted((r.user, r.day) for r in got) == sorted((r.user, r.day) for r in rows.collect())
    assert not any(r.seen for r in got) and len(trained) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_registered_detectors_do_the_whole_job(spark, monkeypatch):
    rounds, epochs = [], []
    trees, net = M.GBTClassifier, M.MultilayerPerceptronClassifier
    monkeypatch.setattr(M, "GBTClassifier", lambda maxIter, **k: rounds.append(maxIter) or trees(maxIter=2, **k))
    monkeypatch.setattr(M, "MultilayerPerceptronClassifier", lambda maxIter, **k: epochs.append(maxIter) or net(maxIter=2, **k))
    rows, names = SQ.window_features(spark, SF)
    assert len(names) == 129
    windows, days = SQ.gbt_window_scores(spark, SF), SQ.mlp_user_day_scores(spark, SF)
    assert set(rounds) == {300} and set(epochs) == {50}
    assert windows.count() == windows.select("user", "start").distinct().count() == DQ.labelled_windows(spark, SF).count()
    assert days.count() == days.select("user", "day").distinct().count() == DQ.features(spark, SF).count()
