import datetime as dt

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import graph_assembly as GA
from behaviorlens.plans import ingest_queries as IQ
from behaviorlens.sources.graph_cache import GraphCache, content_key
from behaviorlens.sources.points import PointStore
from behaviorlens.sources.snapshots import AlertStore, SnapshotTable, read_json, write_json


def alerts(spark, *ids, score=0.5):
    rows = [(i, f"u{i}", dt.date(2010, 1, 4), score + 0.01 * k, "open", None, ["a"]) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, user string, date date, score double, status string, created_at timestamp, top_features array<string>")


def statuses(store):
    return {r.id: r.status for r in store.alerts.read().collect()}


def test_alerts_change_as_a_whole(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path))
    assert store.load().count() == 0
    store.add(alerts(spark, "a", "b"))
    before = store.load()
    store.add(alerts(spark, "b", "c"))
    assert statuses(store) == {"a": "open", "b": "open", "c": "open"}
    assert [r.id for r in before.collect()] == ["b", "a"]  # one who reads still sees the old state
    store.block("a")
    store.block("a")
    store.mute("b")
    assert statuses(store) == {"a": "blocked", "b": "muted", "c": "open"} and store.blocks.read().count() == 1
    assert [r.id for r in store.load("open").collect()] == ["c"]
    version = store.alerts.version()
    for step in (store.mute, store.block):
        with pytest.raises(KeyError):
            step("nobody")
    assert store.alerts.version() == version and store.blocks.read().count() == 1


def test_a_broken_change_leaves_nothing_that_is_read(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), "x int")
    table.change(lambda now: now.union(spark.createDataFrame([(1,)], "x int")))
    fail = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception):  # noqa: B017
        table.change(lambda now: now.select(fail("x").alias("x")))
    assert [r.x for r in table.read().collect()] == [1] and table.version() == 1
    assert table.vacuum() == 1 and [r.x for r in table.read().collect()] == [1]


def test_of_two_changes_one_is_made_again(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), "x int")
    other, tries = SnapshotTable(spark, str(tmp_path), "x int"), []

    def slow(now):
        if not tries:  # while this one is at work, another one commits
            other.change(lambda now: now.union(spark.createDataFrame([(7,)], "x int")))
        tries.append(1)
        return now.union(spark.createDataFrame([(1,)], "x int"))

    assert table.change(slow) == 2 and len(tries) == 2
    assert sorted(r.x for r in table.read().collect()) == [1, 7] and [r.x for r in table.read(1).collect()] == [7]


def test_json_is_whole_or_as_it_was(spark, tmp_path):
    path = str(tmp_path / "a.json")
    assert read_json(spark, path, {"default": 1}) == {"default": 1}
    write_json(spark, path, {"x": [1, "é"]})
    write_json(spark, path, {"x": 2})
    assert read_json(spark, path) == {"x": 2} and [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []
    (tmp_path / "b.json").write_text('{"x": ')
    assert read_json(spark, str(tmp_path / "b.json"), []) == []


def points(spark, n=4000):
    rows = [("v1" if i % 4 else "v2", f"u{i * 7919 % n}", f"d{i % 8}", i % 5, i / n, [float(i), 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "version string, user_id string, department string, scenario int, score double, vector array<double>")


def rows_scanned(df):
    """The rows that the scan gave out, after row groups and partitions were left out."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution()
    df.collect()
    leaf = plan.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value(), leaf.metrics().apply("numFiles").value()


def test_indexes_leave_out_what_is_not_asked_for(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"), 2, users=5000, group_bytes=4096)
    assert store.read() is None
    store.write(points(spark), parts=4)
    every, files = rows_scanned(store.read())
    assert every == 4000
    other, fewer = rows_scanned(store.where(version="v2"))
    assert other == 1000 and fewer < files
    plan = store.where(version="v2", user_id="u5", department="d1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "PushedFilters: [IsNotNull(user_id), IsNotNull(department), EqualTo(user_id,u5), EqualTo(department,d1)]" in plan
    sorted_field, _ = rows_scanned(store.where(department="d3", version="v1"))
    assert sorted_field <= 2000  # the row groups of other departments aren't read
    absent, _ = rows_scanned(store.where(user_id="u5x", version="v1"))
    present, _ = rows_scanned(store.where(user_id="u5", version="v1"))
    assert absent <= 300 and present < 3000  # a user who isn't there is between the least and largest of all groups: the Bloom filters tell
    assert store.where(user_id="u5").count() == 1 and store.where(F.col("score") > 0.5, scenario=3).count() == points(spark).where("score > 0.5 and scenario = 3").count()
    with pytest.raises(ValueError, match="no index"):
        store.where(colour="red")


def test_a_version_is_replaced_and_others_stay(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"), 2)
    store.write(points(spark, 40))
    store.write(spark.createDataFrame([("v2", "new", None, None, None, [1.0, 2.0])], points(spark, 1).schema))
    assert store.where(version="v1").count() == 30
    row = store.where(version="v2").collect()
    assert len(row) == 1 and (row[0].department, row[0].scenario, row[0].score) == ("", 0, 0.0)
    with pytest.raises(Exception, match="has not the length 2"):
        store.write(spark.createDataFrame([("v3", "x", "d", 1, 0.1, [1.0])], points(spark, 1).schema))
    assert store.where(version="v3").count() == 0
    near = store.similar(store.where(version="v1").where("user_id = 'u39'").limit(1), 2, version="v1").collect()
    assert len(near) == 2


def test_another_cap_never_returns_a_stale_window(spark, tmp_path):
    cache, calls = GraphCache(spark, str(tmp_path)), []

    def build(cap):
        def run(starts):
            calls.append((cap, starts))
            rows = [(dt.date.fromisoformat(s), i) for s in ("2010-01-04", "2010-01-11", "2010-01-18") for i in range(cap) if s != "2010-01-18"]
            return {"edges": spark.createDataFrame(rows, "window_start date, n int")}

        return run

    small, large = content_key(["b", "a"], cap=2), content_key(["a", "b", "b"], cap=3)
    assert small == content_key(["a", "b"], cap=2) and len({small, large, content_key(["a"], cap=2)}) == 3
    starts = ["2010-01-04", "2010-01-11", "2010-01-18"]
    assert cache.tables(small, starts[:1], build(2))["edges"].count() == 2
    assert cache.tables(small, starts, build(2))["edges"].count() == 4
    assert calls == [(2, starts[:1]), (2, starts[1:])]  # a window without an edge is built once, too
    assert cache.tables(small, starts, build(2))["edges"].count() == 4 and len(calls) == 2
    assert cache.tables(large, starts[:2], build(3))["edges"].count() == 6 and len(calls) == 3
    assert cache.tables(small, starts[:2], build(2))["edges"].count() == 4 and len(calls) == 3


def test_problems_of_a_graph():
    node, edge = {"n": 3, "max_idx": 2, "odd_labels": 0, "gaps": 0}, {"n_edges": 4, "n_skipped": 1, "min_src": 0, "max_src": 2, "min_dst": 0, "max_dst": 2}
    sound = {f"nodes/{k}": dict(node) for k in GA.KEYS} | {f"edges/{k}": dict(edge) for k in GA.ENDS}
    assert GA.problems(sound) == []
    sound["nodes/user"] |= {"odd_labels": 2, "max_idx": 5}
    sound["edges/http"] |= {"max_dst": 3}
    assert GA.problems(sound) == ["user: 3 nodes are numbered to 5", "user: 2 rows with an odd label", "http: dst is out of bounds"]


def test_alerts_that_come_in_twice_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(5).selectExpr("concat('u', id) AS user", "DATE'2024-01-08' AS date", "id / 10 AS score", "'open' AS status", "array(named_struct('feature', 'a')) AS top_features")
    monkeypatch.setattr(IQ.SQ, "alerts", lambda s, d: rows.mapInArrow(seen, rows.schema))
    got = {(r.user, r.status) for r in IQ.alert_lifecycle(spark, "").collect()}
    assert len(got) == 5 and sum(status == "open" for _, status in got) == 3
    assert made.value == 5


def test_only_missing_windows_are_built_and_each_table_once(spark, monkeypatch):
    from behaviorlens.operators import graph as G
    from behaviorlens.plans import graph_queries as GQ

    assert GA.reaching(GQ.WINDOWS, ["2024-01-15", "2024-01-08"]) == {"first": "2024-01-08", "last": "2024-01-28", "size": 14, "stride": 7}
    events, asked = spark.range(30).select(F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(id as int))").alias("date")), []
    starts = lambda w: {(str(r.window_start), r.date.day) for r in G.in_windows(events, **w).collect()}
    assert starts(GA.reaching(GQ.WINDOWS, ["2024-01-08"])) == {x for x in starts(GQ.WINDOWS) if x[0] == "2024-01-08"}
    build = GA.windowed_graph
    monkeypatch.setattr(GA, "windowed_graph", lambda logs, windows, *a, **k: asked.append((windows["first"], windows["last"])) or build(logs, windows, *a, **k))
    out = IQ.numbered_window_graph(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and asked == [("2024-01-01", "2024-01-14"), ("2024-01-08", "2024-01-28")]
