from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import neardup

SCHEMA = "doc_id long, text string, label string, node int"


def brute_sets(text, k=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows):
    """Components over all pairs of rows, by (index): smallest id reachable and the sizes."""
    sets, parent = [brute_sets(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return out


def check(spark, rows):
    got = neardup.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(str, brute(rows)))
    return got


def test_edges_of_the_contract(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(5, base), (3, base.upper()), (4, None), (6, ""), (7, " \n "), (8, "one two"), (9, "One\ttwo"), (None, "lonely row without an id"), (10, base), (10, base), (11, "É a b c d"), (12, "é a b c d")]
    got = check(spark, rows)
    assert sum(r.kept for r in got if r.component_id == 3) == 1
    assert all(r.kept for r in got if r.n_shingles == 0)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in got)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_brute_force_on_chains_of_edits(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for group in range(6):
        words = list(rng.choice(vocabulary, 160))
        for _ in range(25 if group else 60):
            copy = list(words) if group % 2 else words
            for i in rng.integers(0, 160, rng.integers(1, 6)):
                copy[i] = rng.choice(vocabulary)
            rows.append((int(1000 - n), " ".join(copy)))
            n += 1
    check(spark, rows)


def test_brute_force_on_a_bucket_of_many_outliers(spark, monkeypatch):
    """Over 200 texts share most of their shingles and so their buckets, in chains and alone; the grid has many cells."""
    monkeypatch.setattr(neardup, "CELL", 400)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    words, rows = list(rng.choice(vocabulary, 60)), []
    for n in range(260):
        copy = list(words)
        for i in rng.choice(60, n % 5, replace=False):
            copy[i] = rng.choice(vocabulary)
        rows.append((int(rng.integers(0, 10**6)), " ".join(copy) + (" tail" * (n % 3))))
    check(spark, rows)


def test_cells_give_a_link_to_each_other_component():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    near, far, other = np.unique(np.append(base[:195], np.arange(5, dtype=np.uint64))), np.unique(base[:120]), np.unique(np.append(base[:180], np.arange(9, 20, dtype=np.uint64)))

    def side(rows):
        wide = [np.packbits(((neardup.minima(x, neardup.WIDE)[:, None] >> np.arange(2, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes() for *_, x in rows]
        return pa.table({"node": [r[0] for r in rows], "label": [r[1] for r in rows], "main": [1] * len(rows), "packed": wide, "items": [r[2].tobytes() for r in rows]})

    rows = [(1, 1, np.unique(base)), (2, 1, near), (3, 1, far), (9, 9, other), (11, 11, near)]
    links = neardup._compare_cells(0.5, 75)(side(rows[3:]), side(rows)).to_pylist()
    assert {(x["a"], 1 if x["b"] < 9 else x["b"]) for x in links} == {(9, 1), (9, 11), (11, 1)}


def test_size_estimates_stay_small(spark):
    """A chain takes many steps; the tables of each know their size, so no estimate multiplies from step to step."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    labels = spark.createDataFrame([(i, i) for i in range(41)], "node long, label long")
    got = neardup.components(links, labels)
    assert {r.label for r in got.collect()} == {0}
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 9


def test_very_long_text(spark):
    words = " ".join(f"w{i % 7919}" for i in range(200_000))
    check(spark, [(1, words), (2, words + " end"), (3, "short " + words[:50])])


@pytest.mark.parametrize("low_bits", [1, 2, 4])
def test_estimate_corrects_for_chance(spark, low_bits):
    rng = np.random.default_rng(low_bits)
    words = list(rng.choice([f"w{i}" for i in range(3000)], 800))
    edited = list(words)
    for i in range(0, 800, 40):
        edited[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(rng.permutation(words)))], "doc_id long, text string")
    sets = neardup.shingle_sets(docs, low_bits=low_bits).select("doc_id", "packed")
    pairs = sets.crossJoin(sets.select(F.col("doc_id").alias("other"), F.col("packed").alias("p"))).where("doc_id < other")
    got = {(r.doc_id, r.other): r.e for r in pairs.select("doc_id", "other", neardup._estimate(low_bits, 128)("packed", "p").alias("e")).collect()}
    texts = {r.doc_id: brute_sets(r.text) for r in docs.collect()}
    for (i, j), e in got.items():
        exact = len(texts[i] & texts[j]) / len(texts[i] | texts[j])
        assert abs(e - exact) < 0.25


def test_links_that_no_band_shows(spark):
    """One band of 24 minima shows hardly any link, as 32 bands of 4 miss one in 200,000; all are found."""
    rng = np.random.default_rng(11)
    vocabulary, rows = [f"w{i}" for i in range(3000)], []
    for group in range(30):
        words = list(rng.choice(vocabulary, int(rng.integers(8, 120))))
        for _ in range(3):
            copy = list(words)
            copy[int(rng.integers(0, 3))] = "other"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, "the same line at the head of many texts " * 3 + " ".join(rng.choice(vocabulary, 9 + i % 5))) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), bands=1, rows=24).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute(rows)))


def test_prefix_buckets_in_cells(spark, monkeypatch):
    """A bucket dealt to many cells gives the same pairs."""
    monkeypatch.setattr(neardup, "MET", 7)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: 30 + i % 10], f"x{int(rng.integers(0, 9))}"])) for i in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), bands=1, rows=40).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute(rows)))


def test_a_short_passage_in_many_texts_makes_few_pairs(spark, monkeypatch):
    """With all shingles in one order of their hashes, texts that share a little aren't paired by it; links are all found."""
    pairs, prefixes, prefix_pairs = [], neardup._prefixes, neardup._prefix_pairs
    monkeypatch.setattr(neardup, "_prefixes", lambda words, percent, levels: prefixes(words, percent, np.zeros_like(levels)))

    def counted(*args):
        found = prefix_pairs(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(neardup, "_prefix_pairs", counted)
    rng = np.random.default_rng(13)
    vocabulary, head = [f"w{i}" for i in range(5000)], "the head that many texts share word by word"
    rows = [(i, " ".join([head, *rng.choice(vocabulary, 96)])) for i in range(60)]
    for i in range(20):  # links, at the threshold and above
        words = list(rng.choice(vocabulary, int(rng.integers(8, 90))))
        rows += [(100 + 3 * i + k, " ".join(words + list(rng.choice(vocabulary, (len(words) - 4) // 3 * k // 2)))) for k in range(3)]
    found = neardup.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), bands=1, rows=40).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == sorted(map(str, brute(rows)))
    assert pairs[0] < 150


def test_shingles_and_minima_are_as_their_formulas():
    rng = np.random.default_rng(11)
    text = " ".join(f"W{x}" for x in rng.integers(0, 40, 1500))
    for t in (None, " ", "one", "one two three four five", "a a a a a a a a", text):
        parts = (t or "").encode().lower().split()
        h = np.array([neardup.xxhash.xxh64_intdigest(w) for w in parts], np.uint64)
        want = np.full(max(1, len(parts) - 4), min(len(parts), 5), np.uint64)
        for k in range(min(5, len(parts))):
            want = neardup._mix(want * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(want)])
        got = neardup.shingles(t)
        assert np.array_equal(got, np.unique(want) if parts else np.zeros(0, np.uint64))
        a, b = neardup._permutations(128)
        least = ((got[:, None] * a + b) >> np.uint64(32)).min(axis=0, initial=2**32 - 1)
        assert neardup.minima(got, 128).dtype == np.uint32 and np.array_equal(neardup.minima(got, 128), least)
