"""Latency, folds, holdouts, detection, cosine and the functions around training, on small rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.functions import predicates as P
from behaviorlens.operators import evaluation as E
from behaviorlens.operators import fusion as FU
from behaviorlens.operators import graph_assembly as GA
from behaviorlens.operators import models as M
from behaviorlens.operators import scoring as S
from behaviorlens.operators import similarity as SIM
from behaviorlens.operators import training as T
from behaviorlens.sources import csv_logs as L


def test_latency_is_whole_days_rounded_down(spark):
    flagged = spark.sql("select 'a' user, 0.9 prob, timestamp_ntz'2024-01-10' window_start union all select 'b', 0.9, timestamp_ntz'2024-01-12' union all select 'c', 0.1, timestamp_ntz'2024-01-12'")
    attacks = spark.sql("select user_id, timestamp_ntz'2024-01-10 01:34:19' attack_start from values ('a'), ('b'), ('c') t(user_id)")
    assert {r.user: r.days for r in E.detection_latency(flagged, attacks, 0.5).collect()} == {"a": -1, "b": 1, "c": None}


def test_folds_and_holdouts_are_even_in_each_stratum(spark):
    users = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("user"), (F.col("id") % 100 < 7).cast("int").alias("pos"))
    for seed in (1, 42):
        dealt = E.folds(users, 5, seed, F.col("pos")).groupBy("pos", "fold").count().collect()
        assert {r["count"] for r in dealt if r.pos} == {14} and {r["count"] for r in dealt if not r.pos} == {186}
    held = E.holdout(users, 0.2, 3, F.col("pos"))
    assert held.count() == 1000 and {r.pos: r["count"] for r in held.where("held").groupBy("pos").count().collect()} == {1: 14, 0: 186}
    assert E.folds(users.limit(0), 5, 1, F.col("pos")).count() == 0


def test_running_sums_agree_with_one_window(spark):
    rows = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(701)) / 700).alias("prob"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) == 0).cast("int").alias("label"), (F.col("id") % 2).alias("m"))
    got = {(r.m, r.prob): (r.tp, r.fp, r.p, r.n) for r in E.threshold_counts(rows, ["m"]).collect()}
    plain = [(r.m, r.prob, r.label) for r in rows.collect()]
    for (m, prob), (tp, fp, p, n) in list(got.items())[::25]:
        own = [(x, y) for k, x, y in plain if k == m]
        assert (tp, fp) == (sum(y for x, y in own if x >= prob), sum(1 - y for x, y in own if x >= prob)) and (p, n) == (sum(y for _, y in own), sum(1 - y for _, y in own))


def test_detection_without_files(spark, tmp_path):
    def folder(name, **files):
        d = tmp_path / name
        d.mkdir()
        for f, text in files.items():
            (d / f"{f}.csv").write_text(text)
        return str(d)

    email = "id,date,user,pc,to,cc,bcc,from,size,attachments,content\n"
    assert L.detect(spark, folder("a", email=email)) == "r4x"
    assert L.detect(spark, folder("b", http="ID,DATE,USER,PC,URL,ACTIVITY,CONTENT\n")) == "r6x"
    assert L.detect(spark, folder("c", http="{x},1,DTAA/A,PC,http://a\n")) == "r1"
    assert L.detect(spark, folder("d", logon="id\n")) == "r5x"
    assert L.detect(spark, folder("e", email="id,date,to,from\n")) == "r2"


def test_event_texts(spark):
    rows = spark.createDataFrame([("logon", "Logon", None), ("logon", "other", None), ("file", None, "True")], "kind string, activity string, removable string")
    row = {"pc": F.lit("PC-1"), "activity": F.col("activity"), "filename": F.lit("a/b.doc"), "to_removable_media": F.col("removable"), "to": F.lit(""), "size": F.lit("0"), "url": F.lit("")}
    assert [r.t for r in rows.select(P.describe_event(F.col("kind"), row).alias("t")).collect()] == ["Logged on at PC-1", "Logged off at PC-1", "File access: b.doc → removable drive"]


def test_cosine_without_directions_and_in_blocks(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "point_id long, vector array<double>")
    whole = SIM.find_similar(points, points, 2).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in whole} == {1, 2, 5} and [(r.point_id, r.rank) for r in whole if r.query_id == 1] == [(2, 1), (5, 2)]
    assert SIM.find_similar(points, points, 2, block_numbers=2).orderBy("query_id", "rank").collect() == whole
    near = SIM.lsh_neighbours(points, points, SIM.random_planes(2, 2, 8), 2).collect()
    assert {(r.query_id, r.point_id) for r in near} <= {(r.query_id, r.point_id) for r in whole} and (1, 2) in {(r.query_id, r.point_id) for r in near}


def test_configs_results_and_sorting(spark, tmp_path):
    assert T.validate_config({"epochs": 3, "learning_rate": 0.1, "layers": [8, 1]})
    for wrong in ({"epochs": 0}, {"epochs": True}, {"learning_rate": -1}, {"layers": [8, 2]}, {"layers": []}):
        with pytest.raises(ValueError):
            T.validate_config(wrong)
    folder = str(tmp_path / "results")
    T.save_results(spark, folder, "trees", {"auprc": 0.5, "auroc": 0.9, "best_f1": 0.4})
    T.save_results(spark, folder, "perceptron", {"auprc": 0.7, "auroc": 0.8, "best_f1": 0.6})
    T.save_results(spark, folder, "untrained", {"auroc": 0.8})
    assert [r.model for r in T.compare_models(spark, folder, ["trees", "perceptron", "untrained", "absent"]).collect()] == ["perceptron", "trees"]
    assert T.compare_models(spark, str(tmp_path / "none"), ["x"]).count() == 0
    alerts = spark.createDataFrame([("a", 0.2, "2024-01-02", "open"), ("b", 0.9, "2024-01-01", "open")], "id string, score double, date string, status string")
    assert [r.id for r in S.sorted_alerts(alerts).collect()] == ["b", "a"] and [r.id for r in S.sorted_alerts(alerts, "date", False).collect()] == ["b", "a"]
    assert {r.status for r in S.mute(alerts, "a").where("id = 'a'").collect()} == {"muted"}
    S.append_alerts(alerts, str(tmp_path / "alerts"))
    S.append_alerts(alerts, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 4


def test_cross_validation_and_versions(spark):
    rows = spark.range(120).select(F.concat(F.lit("u"), F.col("id") % 40).alias("user"), F.col("id").cast("int").alias("start"), F.expr("date_add(date'2024-01-01', cast(id as int) % 20)").alias("window_start"), (F.col("id") % 40 < 8).cast("int").alias("label"))
    attacks = spark.sql("select concat('u', id) user_id, timestamp_ntz'2024-01-01' attack_start from range(8)")
    seen = []

    def fit(rows, held, seed):
        seen.append((seed, rows.where(held).select("user").distinct().count()))
        return rows.where(held).select("user", "window_start", "label", (F.col("label") * 0.5 + 0.3).alias("prob"))

    scored, metrics = T.cross_validate(rows, fit, attacks, n=4, seeds=(1, 2))
    assert scored.count() == 240 and sum(n for _, n in seen) == 80 and {n for _, n in seen} == {10}
    assert {(r.auprc, r.auroc) for r in metrics.collect()} == {(1.0, 1.0)}
    summary = {r.metric: (r.mean, r.std) for r in T.cross_validation_summary(metrics).collect()}
    assert summary["auprc"] == (1.0, 0.0)
    held = T.inner_holdout(rows, 0.5)
    assert 0 < held.where("held").count() < 120
    _, other = T.score_version(lambda source: lambda target: fit(target, F.lit(True), 0), rows, rows.where("label = 0"), attacks)
    assert other.first().auprc == 0.0
    windows = rows.withColumn("window_end", F.date_add("window_start", 27))
    nodes = spark.createDataFrame([("u1", 0), ("u2", 1)], "user string, idx long")
    samples = T.samples_by_period(windows, windows, nodes)
    assert samples.count() == 6 and samples.select("node").distinct().count() == 2
    orders = [[r.period for r in T.period_batches(samples, 7, epoch).orderBy("place").collect()] for epoch in (0, 0, 1)]
    assert orders[0] == orders[1] and sorted(orders[0]) == sorted(orders[2])


def test_importances(spark):
    rows = spark.range(60).select((F.col("id") % 2).cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 2).cast("int").alias("label"))
    model = M.boosted_trees(M.assemble(rows, ("a", "b")), rounds=1)
    assert T.feature_importance(model, ("a", "b")) == [("a", 1.0)]


def test_hidden_users_keep_their_edges(spark):
    log = spark.createDataFrame([("1", "2024-01-02 10:00", "a", "PC", "Logon"), ("2", "2024-01-03 10:00", "b", "PC", "Logon"), ("3", "2024-03-03 10:00", "c", "PC", "Logon")], "id string, d string, user string, pc string, activity string")
    log = log.select("id", F.col("d").cast("timestamp_ntz").alias("date"), "user", "pc", "activity")
    nothing = log.limit(0)
    blank = lambda *names: nothing.select("id", "date", "user", "pc", *[F.lit(None).cast("string").alias(n) for n in names])
    logs = {"logon": log, "device": nothing, "file": blank("filename", "to_removable_media", "content"), "email": blank("to", "cc", "bcc", "from", "size", "attachments"), "http": blank("url")}
    insiders = spark.createDataFrame([("b",)], "user_id string")
    graph = GA.hetero_graph(logs, insiders, "2024-01-01", "2024-01-31", hidden=spark.createDataFrame([("b",)], "user string"))
    assert {r.user: (r.idx, r.y, r.in_training) for r in graph.nodes["user"].collect()} == {"a": (0, 0, True), "b": (1, 1, False)}
    assert sorted((r.src, r.dst) for r in graph.edges["logon"].collect()) == [(0, 0), (1, 0)]
    more = GA.cumulative_graphs(logs, insiders, "2024-01-01", {"train": "2024-01-02 23:00", "test": "2024-12-31"})
    assert more["train"].nodes["user"].count() == 1 and more["test"].nodes["user"].count() == 3


def test_required_values_have_to_be_there():
    whole = {"epochs": 3, "batch_size": 8, "patience": 2, "learning_rate": 0.1, "layers": [8, 1]}
    assert T.validate_config(whole, T.REQUIRED) == whole
    with pytest.raises(ValueError, match="epochs, patience"):
        T.validate_config({k: v for k, v in whole.items() if k not in ("epochs", "patience")}, T.REQUIRED)


def test_gates(spark):
    rows = [("baseline", 0.25), ("baseline", 0.10), ("temporal", 0.28), ("graph", 0.29)]
    got = {r.gate: (r.value, r.passed) for r in T.gates(spark.createDataFrame(rows, "rung string, auprc double")).collect()}
    assert got["baseline"] == (0.25, True) and got["temporal"][1] and got["temporal"][0] == pytest.approx(0.03) and not got["graph"][1]
    assert not any(r.passed for r in T.gates(spark.createDataFrame([], "rung string, auprc double")).collect())


def test_results_are_text_of_fixed_width():
    text = E.results_table([{"model": "trees", "auprc": 0.51234, "auroc": 0.9, "best_f1": 0.4}, {"model": "mlp", "auprc": 0.5, "auroc": 0.91, "best_f1": 0.41}])
    assert text.splitlines() == ["model  auprc   auroc   best_f1", "trees  0.5123  0.9000  0.4000", "mlp    0.5000  0.9100  0.4100"]


def test_all_windows_of_a_user_are_on_one_side(spark):
    days = spark.createDataFrame([(f"u{u}", dt.date(2010, 1, 4) + dt.timedelta(d)) for u in range(20) for d in range(50)], "user string, day date")
    insiders = spark.createDataFrame([(f"u{u}", dt.datetime(2010, 1, 10), dt.datetime(2010, 2, 20), 1) for u in range(5)], "user_id string, attack_start timestamp_ntz, attack_end timestamp_ntz, scenario int")
    got = T.split_windows(days, insiders).collect()
    sides = {}
    for r in got:
        sides.setdefault(r.user, set()).add(r.held)
    assert len(sides) == 20 and all(len(s) == 1 for s in sides.values())
    held = {u for u, s in sides.items() if s == {True}}
    assert len(held) == 4 and len(held & {f"u{u}" for u in range(5)}) == 1


def test_a_loaded_pipeline_scores_like_the_stored_one(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"u{i}", float(rng.normal()), float(rng.normal()) if i % 7 else None, ("dev", "ops", None)[i % 3], int(i % 5 == 0)) for i in range(80)]
    table = spark.createDataFrame(rows, "user string, x double, y double, role string, label int")
    prepared = FU.prepared(table, ("x", "y"), ("role",))
    store = FU.ModelStore(spark, str(tmp_path))
    model = FU.fit(prepared, ("x", "y"), ("role",))
    store.save("fusion", model, numbers=["x", "y"])
    unseen = FU.prepared(spark.createDataFrame([("new", 0.1, None, "pilot", 0)], table.schema), ("x", "y"), ("role",)).union(prepared)
    a, b = ({r.user: r.prob for r in M.scores(m, unseen, "user").collect()} for m in (model, store.load("fusion")))
    assert a == b and len(a) == 81 and store.about("fusion") == {"numbers": ["x", "y"]} and store.names() == ["fusion"]
    with pytest.raises(KeyError):
        store.load("none")
    store.save("fusion", model, numbers=[])
    assert store.about("fusion") == {"numbers": []}
