import hashlib
import zlib

import numpy as np
import pytest

from behaviorlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, block int, kind string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seqs[c] = own.get(base, [])[:h] + ts[h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if tuple(seqs[c]) == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def conversations(seed, count, texts=3, longest=6):
    rng = np.random.default_rng(seed)
    return [(c, t, ("user", "assistant")[t % 2], f"say {'word ' * int(w)}".strip()) for c in range(count) for t, w in enumerate(rng.integers(0, texts, rng.integers(1, longest + 1)))]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(spark, conversations(partitions, 150))
        check(spark, conversations(partitions, 90, texts=1, longest=4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_most_conversations_are_the_same(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(3)]
    check(spark, same + [(1000 + c, *turn) for c, *turn in conversations(5, 20)])


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (1, 0, "user", "a  b\tc"), (5, 7, None, "only"), (-3, 0, "user", "x"), (-25, 2, "a", "b"), (None, 0, "user", "lost"), (45, 0, "user", "é ü")]
    rows += [(7, 0, "user", "word " * 50_000), (27, 0, "user", "word " * 50_000)]
    check(spark, rows)
    # 5 has no first conversation of its family and fewer turns than it would take from that.
    check(spark, [(5, 0, "user", "gone")])
    check(spark, [(c, 0, "user", "same") for c in range(3)])
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_smaller():
    rng = np.random.default_rng(1)
    values = rng.integers(-1, 5, 200)
    left, right = trie.nearest_smaller(values)
    for i in range(len(values)):
        assert left[i] == max((k for k in range(i) if values[k] < values[i]), default=-1)
        assert right[i] == min((k for k in range(i + 1, len(values)) if values[k] < values[i]), default=len(values))


def test_borders_by_block_minima():
    rows = [{"block": b, "inner": i, "lcp": x, "lead": 0} for b, i, x in ((3, 0, None), (5, 9, 4), (6, 7, 6), (9, 2, 3))]
    borders = trie.Borders(rows)
    assert borders.owner(9, "H", 3) == (3, "T") and borders.owner(9, "H", 5) == (9, "H")
    assert borders.owner(6, "H", 6) == (5, "H") and borders.owner(6, "H", 4) == (3, "T") and borders.owner(9, "H", 0) == (3, "H")
    assert borders.above(9, "T", 3) == (3, "T") and borders.above(9, "T", 4) == (9, "T") and borders.after(5) == 6 and borders.after(9) == -1
