from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from behaviorlens.llm import simhash
from behaviorlens.llm.common import Scratch

SCHEMA = "doc_id long, text string, fp int, label string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            parent[root(i)] = root(j)
    members = {}
    for i in range(len(fps)):
        members.setdefault(root(i), []).append(ids[i])
    return [min((x for x in members[root(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two\tTHREE", "a b c d", " a  b\x0bc d e f A B c d É é x ", "w " * 40_000, "xy" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def near_texts(seed, documents=150):
    rng, texts = np.random.default_rng(seed), []
    for _ in range(documents):
        if texts and rng.random() < 0.6:
            words = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = f"w{rng.integers(2000)}"
        else:
            words = [f"w{x}" for x in rng.integers(0, 2000, rng.integers(3, 400))]
        texts.append(" ".join(words))
    return texts


def test_brute_force(spark):
    texts = [*near_texts(1), None, "", " ", "one", "one"]
    rows = [(1000 - i if i % 50 else None, t, 1, "x") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = list(zip([r[0] for r in rows], [f"{x:016x}" for x in fps], brute_components([r[0] for r in rows], fps)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_each_number_of_blocks_finds_all_links(blocks):
    masks = simhash.masks(blocks)
    rng = np.random.default_rng(blocks)
    for _ in range(300):
        flipped = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flipped & m == 0 for m in masks)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10)] == [5, 5, 6, 7]


def test_a_hot_bucket_is_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARE", 16)
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = {base}
    for _ in range(400):  # one tight group and its surroundings, which share a block with all the others
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(1, 9), replace=False)))
    fps = sorted(fps)
    with Scratch(spark) as scratch:
        found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, scratch).collect()]
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    want = brute_components(fps, fps)
    groups = {}
    for x, w in zip(fps, want):
        groups.setdefault(w, set()).add(root(x))
    assert all(len(g) == 1 for g in groups.values()) and len({r for g in groups.values() for r in g}) == len(groups)


def test_tiles_that_differ_in_population_are_skipped(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    fps = np.array([(1 << k) - 1 for k in range(0, 64, 6)], np.uint64)
    assert len(simhash.forest(fps, 4)[0]) == 0
    chain = np.array([(1 << k) - 1 for k in range(0, 64, 4)], np.uint64)
    assert len(simhash.forest(chain, 4)[0]) == len(chain) - 1


def test_registered_query(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(near_texts(2, 40))], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    from behaviorlens.llm.queries import QUERIES

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash"](spark, str(tmp_path)).collect()}
    fps = [brute_fingerprint(t) for t in near_texts(2, 40)]
    assert got == {i: (f"{x:016x}", c) for i, (x, c) in enumerate(zip(fps, brute_components(list(range(40)), fps)))}
