"""Compression of vectors to codes of a few bytes, by product quantization with annular norm pruning.

A vector becomes integers, and its equal consecutive parts have a codebook each. A few rounds of
assigning parts to their nearest entries and averaging them improve the codebooks.

The nearest entry is found exactly. The entries of a codebook are sorted by their norm; a part of
norm q whose best distance so far is d can only be closer to an entry whose norm lies within
[q - d, q + d]. So each part starts at the entries whose norm is nearest to its own, and the two
ends of what was looked at move outwards, a few entries at a time, while they are inside the
annulus, which is found anew by binary search whenever the best distance shrinks. Distances are
sums of squared integers, so ties are exact; they go to the lower index.

A round is one pass over the integers: each task adds up its own parts, entry by entry, and only
those sums are shuffled. The driver holds the codebooks and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries on either side that are looked at in one step.
STEP = 8
#: Components that one step gathers, at most.
GATHER = 1 << 22
#: Widens the annulus, so that rounded roots of whole numbers can't exclude an entry on its edge.
SLACK = 1e-3

Codebook = np.ndarray  # entries x components


class Annulus:
    """The entries of one codebook, sorted by norm."""

    def __init__(self, codebook: Codebook):
        norms = np.sqrt((codebook.astype(np.float64) ** 2).sum(axis=1))
        self.index = np.lexsort((np.arange(len(codebook)), norms))
        self.norms, self.entries = norms[self.index], codebook[self.index]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part the index of its nearest entry and their squared distance, and how many distances were computed."""
        rows = max(1, GATHER // (STEP * parts.shape[1]))
        found = [self._nearest(parts[i : i + rows]) for i in range(0, max(1, len(parts)), rows)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found)

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        q, count = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1)), len(self.entries)
        best, at = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), count)
        low = np.searchsorted(self.norms, q)  # entries [low, high) have been looked at
        high, active, looked = low.copy(), np.arange(len(parts)), 0
        first, last = np.zeros(len(parts), np.int64), np.full(len(parts), count)
        while len(active):
            for side in (-1, 1):
                edge = low[active] - 1 if side < 0 else high[active]
                look = edge[:, None] + side * np.arange(STEP)
                inside = (look >= first[active, None]) & (look < last[active, None])
                look = np.clip(look, 0, count - 1)
                gap = parts[active, None, :] - self.entries[look]
                distance = np.where(inside, np.einsum("ijk,ijk->ij", gap, gap), np.iinfo(np.int64).max)
                index = np.where(inside, self.index[look], count)
                near = distance.min(axis=1)
                tied = np.where(distance == near[:, None], index, count).min(axis=1)
                better = (near < best[active]) | ((near == best[active]) & (tied < at[active]))
                best[active[better]], at[active[better]] = near[better], tied[better]
                looked += int(inside.sum())
                if side < 0:
                    low[active] = np.maximum(low[active] - STEP, 0)
                else:
                    high[active] = np.minimum(high[active] + STEP, count)
            reach = np.sqrt(best[active].astype(np.float64)) + SLACK
            first[active] = np.searchsorted(self.norms, q[active] - reach, "left")
            last[active] = np.searchsorted(self.norms, q[active] + reach, "right")
            active = active[(low[active] > first[active]) | (high[active] < last[active])]
        return at, best, looked


def whole_numbers(vector: Column, bound: int) -> Column:
    """floor(SCALE * x) of each component, held to `bound` at either end."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-bound)), F.least(F.lit(float(bound)), x.cast("double") * SCALE))).cast("long"))


def _usable(vector: Column) -> Column:
    """A vector with components, all of them finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def _split(column: pa.ListArray, parts: int) -> np.ndarray:
    """Vectors x parts x components of a batch."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1)


def _sums(codebooks: list[Codebook]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Annulus(c) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        totals = [np.zeros_like(c) for c in codebooks]
        for batch in batches:
            vectors = _split(batch.column(0), len(codebooks))
            for p, ring in enumerate(rings):
                at, _, _ = ring.nearest(vectors[:, p])
                counts[p] += np.bincount(at, minlength=len(counts[p]))
                np.add.at(totals[p], at, vectors[:, p])
        for p, total in enumerate(totals):
            used = np.flatnonzero(counts[p])
            if len(used):
                arrays = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), pa.array(list(total[used]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "n", "total"])

    return run


def _assign(codebooks: list[Codebook]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Annulus(c) for c in codebooks]
        for batch in batches:
            vectors, codes, error = _split(batch.column(2), len(codebooks)), [], 0
            for p, ring in enumerate(rings):
                at, distance, _ = ring.nearest(vectors[:, p])
                codes.append(at.astype(np.uint8))
                error = error + distance
            code = [bytes(row).hex() for row in np.stack(codes, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def improved(ints: DataFrame, codebooks: list[Codebook]) -> list[Codebook]:
    """The codebooks after one round: each used entry is the floor of the mean of its parts."""
    parts = ints.select("ints").mapInArrow(_sums(codebooks), "part int, entry int, n bigint, total array<bigint>")
    whole = parts.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    whole = whole.groupBy("part", "entry", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [c.copy() for c in codebooks]
    for part, entry, place, n, x in whole.collect():  # entries x components of a vector, whatever the rows
        out[part][entry, place] = int(x) // int(n)
    return out


def digest(codebooks: list[Codebook]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal with commas between them."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """One row per kept vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Dropped are null and empty vectors, those that hold null or non-finite components, and those
    whose length isn't that of the vector of the smallest kept id. A length that `parts` doesn't
    divide is an error, as are more entries than a byte numbers. The codebooks start with the
    vectors of the smallest ids, or all of them if those are fewer than `entries`; a null id comes
    after all others, and rows of the same id follow the order of their components. Scaled
    components beyond isqrt(2**60 / length) count as that bound, beyond which an error needn't
    fit a long (134,217,728 for 64 components, which is 131,072 before scaling); the sum of a
    label that does not fit is null. Repeated rows each have their row, and rows of null labels
    share their label_error. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(_usable(F.col("vector")))
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("vector")]
    head = rows.select("vec_id", F.size("vector").alias("n"), "vector").orderBy(*order).limit(1).first()
    size = head["n"] if head else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        ints = scratch.cut(rows.where(F.size("vector") == size).select("vec_id", "label", whole_numbers(F.col("vector"), isqrt((1 << 60) // size)).alias("ints")))
        first = ints.orderBy(F.col("vec_id").isNull(), "vec_id", "ints").limit(entries).select("ints").collect()
        start = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, size // parts)
        codebooks = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
        for _ in range(rounds if len(first) else 0):
            codebooks = improved(ints, codebooks)
        types = {f.name: f.dataType.simpleString() for f in ints.schema}
        coded = scratch.cut(ints.mapInArrow(_assign(codebooks), f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"))
        by_label = scratch.cut(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
        scratch.keep(coded, by_label)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("codebooks_sha256", F.lit(digest(codebooks)))
