import hashlib
import math

import numpy as np
import pytest

from behaviorlens.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, of int"


def brute(rows, entries=256, rounds=4):
    """(vec_id, label, code, error, label_error, digest) of each kept row, in exact whole numbers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in kept]
    p = len(ints[0]) // 4 if ints else 0
    parts = [[v[k * p : (k + 1) * p] for v in ints] for k in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def assign(part, book):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book)) for x in part]

    for _ in range(rounds):
        for part, book in zip(parts, books):
            of = [i for _, i in assign(part, book)]
            for i in set(of):
                mine = [x for x, j in zip(part, of) if j == i]
                book[i] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [assign(part, book) for part, book in zip(parts, books)]
    errors = [sum(part[i][0] for part in last) for i in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], r[2], "".join(f"{part[i][1]:02x}" for part in last), errors[i], by_label[r[2]], digest) for i, r in enumerate(kept)]


def vectors(n, seed, size=8):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, size)], int(rng.integers(3))) for i in range(n)]


def run(spark, rows, **parameters):
    found = codes.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **parameters).collect()
    return sorted(map(str, [(r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found]))


def test_brute_force(spark):
    rows = vectors(60, 1)
    rows += [(100, None, 1), (101, [], 1), (102, [1.0, None] * 4, 1), (103, [float("nan")] * 8, 1), (104, [float("inf")] * 8, 1)]
    rows += [(7, rows[7][1], 2), (None, rows[3][1], None), (None, [0.0] * 8, None), (105, [0.0] * 8, None), (200, [-0.0, 1e-9, -1e-9, 5.5, -7.25, 100.0, 3.0, 2.0], 0)]
    assert run(spark, rows, entries=12) == sorted(map(str, brute(rows, 12)))


def test_fewer_vectors_than_entries_and_none(spark):
    rows = vectors(5, 2)
    assert run(spark, rows) == sorted(map(str, brute(rows)))
    assert all(r[3] == 0 for r in brute(rows))
    assert run(spark, []) == []


def test_odd_lengths(spark):
    rows = [*vectors(10, 3), (50, [1.0] * 12, 0)]
    assert run(spark, rows) == sorted(map(str, brute(rows[:10])))
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, vectors(3, 4, 6))
    with pytest.raises(ValueError, match="one byte"):
        run(spark, rows, entries=257)


def test_huge_components_count_as_the_bound(spark):
    rows = [(0, [3e38] * 4 + [0.0] * 4, 0), (1, [-3e38] * 4 + [0.0] * 4, 0)]
    found = codes.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), entries=1).collect()
    assert {r.error for r in found} == {4 * (math.isqrt((1 << 60) // 8)) ** 2}


@pytest.mark.parametrize("size,spread", [(1, 3), (2, 30), (16, 500)])
def test_annulus_is_exact_and_skips(size, spread):
    rng = np.random.default_rng(size)
    book, parts = rng.integers(-spread, spread, (256, size)), rng.integers(-spread, spread, (500, size))
    all_distances = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    at, best, looked = codes.Annulus(book).nearest(parts)
    assert (best == all_distances.min(axis=1)).all() and (at == all_distances.argmin(axis=1)).all()  # argmin takes the lower index
    assert looked < all_distances.size if size < 16 else looked <= all_distances.size
