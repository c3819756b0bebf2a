import numpy as np
import pytest

from behaviorlens.operators import messages as MP


def brute(edges, values, hops, weighted):
    out, state = {}, dict(values)
    for hop in range(1, hops + 1):
        cells, whole = {}, {}
        for kind, src, dst, n in edges:
            if src in state:
                for key, into in (((dst, kind), cells), (dst, whole)):
                    into.setdefault(key, []).append((state[src], n if weighted else 1))
        mean = lambda xs: sum(x * w for x, w in xs if x is not None) / sum(w for x, w in xs if x is not None) if any(x is not None for x, _ in xs) else None
        out |= {(dst, hop, kind): (len(xs), mean(xs)) for (dst, kind), xs in cells.items()}
        state = {dst: mean(xs) for dst, xs in whole.items()}
    return out


@pytest.mark.parametrize("weighted,share", [(False, 100_000), (True, 7)])
def test_means_of_neighbours_with_hubs_split(spark, weighted, share):
    rng = np.random.default_rng(2)
    edges = {(("logon", "mail")[k], f"user:{a}", f"pc:{b}") for k, a, b in zip(rng.integers(0, 2, 150), rng.integers(0, 25, 150), rng.integers(0, 6, 150))}
    edges |= {("logon", "user:hub", f"pc:x{i}") for i in range(60)} | {("logon", f"user:{i}", "pc:all") for i in range(25)}
    edges = [(k, s, d, int(rng.integers(1, 5))) for k, s, d in sorted(edges)]
    edges += [(f"rev_{k}", d, s, n) for k, s, d, n in edges]
    values = {f"user:{i}": float(rng.normal()) for i in range(20)} | {"user:hub": 5.0, "user:21": None}
    table = spark.createDataFrame(edges, "kind string, src string, dst string, n long")
    start = spark.createDataFrame(list(values.items()), "node string, x double")
    assert (MP.hubs_of(table, share).count() > 0) == (share == 7)
    found = MP.neighbour_means(table, start, ("x",), 3, weighted, share)
    got = {(r.node, r.hop, r.kind): (r.neighbours, r.x) for r in found.collect()}
    want = brute(edges, values, 3, weighted)
    assert set(got) == set(want)
    for k, (n, x) in want.items():
        assert got[k][0] == n and (got[k][1] is None if x is None else got[k][1] == pytest.approx(x)), k
    wide = {r.user: r for r in MP.context(found, "user", "user", 2, ("x",), ("rev_logon", "rev_mail")).collect()}
    assert wide["hub"].h2_rev_logon_x == pytest.approx(want["user:hub", 2, "rev_logon"][1])


def test_hubs_are_bounded(spark):
    edges = spark.createDataFrame([("e", f"s{i % 40}", f"d{i}", 1) for i in range(400)], "kind string, src string, dst string, n long")
    assert MP.hubs_of(edges, share=1, most=20).count() <= 20 and MP.hubs_of(edges, share=1, most=4000).count() == 40
    assert MP.neighbour_means(edges.limit(0), spark.createDataFrame([], "node string, x double"), ("x",)).count() == 0
