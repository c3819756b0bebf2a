import numpy as np

from behaviorlens.operators import similarity as SIM


def table(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "point_id long, vector array<double>")


def test_codes_find_neighbours_among_a_twentieth_of_the_points(spark):
    x = np.random.default_rng(0).standard_normal((2000, 64))  # no clusters at all
    points = table(spark, x.tolist())
    queries = points.where("point_id % 100 = 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in SIM.code_neighbours(points, queries, 64, 5).collect():
        assert abs(r.score - unit[r.query_id] @ unit[r.point_id]) < 1e-9
        got.setdefault(r.query_id, {})[r.point_id] = r.rank
    hits = 0
    for q in range(0, 2000, 100):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(got[q]))
        assert sorted(got[q].values()) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * 5 * 20
    # How many pairs are compared by their vectors: what the codes leave.
    codes = {r.point_id: np.array(r.code, np.int64).view(np.uint64) for r in SIM.sign_codes(points, 64).collect()}
    apart = np.array([[np.bitwise_count(codes[q] ^ codes[p]).sum() if p != q else 999 for p in range(2000)] for q in range(0, 2000, 100)])
    reach = np.sort(apart, axis=1)[:, 100]
    assert (apart <= reach[:, None]).mean() < 0.1


def test_blocks_and_odd_points(spark):
    x = np.random.default_rng(1).standard_normal((60, 8))
    points = table(spark, [*x.tolist(), [0.0] * 8, None, [1.0]])
    whole = SIM.code_neighbours(points, points, 8, 3, share=1.0).collect()
    parts = SIM.code_neighbours(points, points, 8, 3, share=1.0, block_numbers=100).collect()
    key = lambda rows: sorted((r.query_id, r.rank, r.point_id, round(r.score, 9)) for r in rows)
    want = SIM.find_similar(table(spark, x.tolist()), table(spark, x.tolist()), 3).collect()
    assert key(whole) == key(parts) == key(want)
    assert SIM.code_neighbours(points.limit(0), points.limit(0), 8, 3).count() == 0


def test_new_points_replace_stored_ones_of_their_key(spark):
    ddl = "version string, user_id string, score double, department string, scenario int, vector array<double>"
    stored = spark.createDataFrame([("v1", "a", 0.1, "x", 1, [1.0]), ("v1", "b", 0.2, "x", 1, [2.0]), ("v2", "a", 0.3, "x", 1, [3.0])], ddl)
    new = spark.createDataFrame([("v1", "a", None, None, None, [9.0]), ("v1", "c", 0.5, "y", 2, [4.0])], ddl)
    got = {(r.version, r.user_id): (r.score, r.department, r.scenario, r.vector) for r in SIM.upsert(stored, new).collect()}
    assert got == {("v1", "a"): (0.0, "", 0, [9.0]), ("v1", "b"): (0.2, "x", 1, [2.0]), ("v2", "a"): (0.3, "x", 1, [3.0]), ("v1", "c"): (0.5, "y", 2, [4.0])}


def test_cells_give_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(SIM, "CELL_POINTS", 16)
    monkeypatch.setattr(SIM, "TOGETHER", 7)
    x = np.random.default_rng(2).standard_normal((90, 6))
    x[40:60] = x[3]  # more copies than k, which tie by their ids
    rows = [*x.tolist(), [0.0] * 6, None, [float("nan")] * 6]
    points = table(spark, rows)
    unit = {i: np.array(v) / (sum(c * c for c in v) ** 0.5) for i, v in enumerate(rows) if v is not None and any(v)}
    dot = lambda a, b: sum(float(p) * float(q) for p, q in zip(a, b))
    scores = {(q, p): dot(unit[p], unit[q]) for q in unit for p in unit if p != q}
    nearest = lambda ok: {(q, p): r + 1 for q in unit for r, p in enumerate(sorted((p for p in unit if p != q and ok(q, p)), key=lambda p: (-np.nan_to_num(scores[q, p], nan=9), p))[:4])}
    got = {(r.query_id, r.point_id): r.rank for r in SIM.find_similar(points, points, 4, block_numbers=200).collect()}
    assert got == nearest(lambda q, p: True)
    planes = SIM.random_planes(6, 3, 4)
    signs = {i: [tuple(dot(v, w) >= 0 or np.isnan(v[0]) for w in t) for t in planes] for i, v in unit.items()}
    found = SIM.lsh_neighbours(points, points, planes, 4)
    got = {(r.query_id, r.point_id): r.rank for r in found.collect()}
    assert got == nearest(lambda q, p: any(a == b for a, b in zip(signs[q], signs[p])))
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (found, SIM.find_similar(points, points, 4))]
    assert all("FlatMapCoGroupsInArrow" in p and "NestedLoop" not in p for p in plans)  # a task never ranks all its pairs
