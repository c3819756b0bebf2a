"""Near-duplicate detection by b-bit MinHash.

A document is the set of its distinct word shingles. One pass over the texts makes, for each, the
set's size, a digest of the whole set, the band values of its MinHash signature, and the signature
itself packed to its low bits. Documents with the same set are one class from then on.

Classes that share a band are candidates. The packed signatures give an estimate of similarity,
corrected for low bits that agree by chance, which throws out what is far below the threshold.
What is left is confirmed on the full shingle sets. Links then become components.

A bucket is never expanded into all pairs. The smallest class of a bucket is its leader, and each
class is first compared with the leader it shares most buckets with. In buckets that still hold
several components, a few more rounds do the same for the members outside the largest component,
with a member of that as the leader. Members
of the same component are never compared. What is left are outliers: each meets the members of the
other components of its bucket in the cells of a grid, where the bits of wider signatures are
counted, pairs that may still be links are confirmed on their full sets, and one link for each
other component comes out. In a bucket of n members with k outside its largest component that is
k * n counts of bits, in cells of bounded size that any number of tasks share; nothing is capped.

What signatures miss is found by prefixes. Shingles have an order, the rarer first; two sets that
are linked share one among the first few of each, as many as the threshold lets differ, and some
more among some more (`_least`). A set of which too few of those are in any other set is linked with
none, so most sets go no further. Classes of unlike components that share one of the first few are
compared on bit maps that can only come out too alike, then on their full sets, so no link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch, has_repeats, hash_pair, one_of_each, share, text_of

SHINGLE_WORDS = 5
#: A pair is linked when 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Low bits that are kept of each minimum.
LOW_BITS = 4
#: The signature of the last comparison, and the shingles on each side of a cell of its grid.
WIDE, WIDE_BITS, CELL = 1024, 2, 1 << 19
#: Rounds that compare a bucket's outliers with one more member of its largest component, at most.
STARS = 4
#: Edges that one task contracts with ease.
SMALL = 200_000
#: A pair goes on if its estimate is at most so many standard deviations below the threshold.
SLACK = 5.0
#: Shingles are counted by so many of their high bits; slots of a row of counts.
SLOT_BITS, SLOT_BLOCK = 20, 1 << 16
#: Members of a prefix bucket on each side of a cell, and bits of a map of a set's parities.
MET, MAP_BITS = 2048, 11
#: A prefix has a shingle more for each so many of a set.
SPARE = 20
#: Digests of sets that a task knows again, at most.
SEEN = 1_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The n_shingles of a row of counts.
COUNTS = -1
SETS_DDL = "doc_id bigint, r1 bigint, r2 bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, packed binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text.

    Words are runs outside `[\\x20\\x09-\\x0D]` with A-Z lower-cased: just what `lower` and `split`
    do to bytes. Fewer words than a shingle has are one shingle; no word gives an empty set.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    out = np.full(n, min(len(parts), words), np.uint64)
    for k in range(min(words, len(parts))):  # as _mix, in place
        out *= _GOLDEN
        out += h[k : k + n]
        out ^= out >> np.uint64(30)
        out *= _MIX1
        out ^= out >> np.uint64(27)
        out *= _MIX2
        out ^= out >> np.uint64(31)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


@lru_cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    state = _mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return state[:count] | np.uint64(1), state[count:]


def minima(items: np.ndarray, count: int) -> np.ndarray:
    """The least 32-bit value of a set under each of `count` hash functions, a part of the set at a time."""
    a, b = _permutations(count)
    least = np.full(count, 2**64 - 1, np.uint64)
    for i in range(0, len(items), 256):
        part = np.multiply.outer(a, items[i : i + 256])
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sets(words: int, bands: int, rows: int, low_bits: int, counting: bool = False):
    """A row for each text; counting, also COUNTS rows of a task: in r1 a block of slots, in packed how many shingles fall into each, 65535 at most."""
    types = [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "r1", "r2", "n_shingles", "s1", "s2", "bands", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                out, every = [], []
                for *row, text in zip(*(c.to_pylist() for c in part.columns)):
                    items = shingles(text, words)
                    if not len(items):
                        out.append((*row, 0, None, None, None, None))
                        continue
                    every.append(items)
                    data = items.tobytes()
                    least = minima(items, bands * rows)
                    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(bands, rows))]
                    bits = (least[:, None] >> np.arange(low_bits, dtype=np.uint32)) & 1
                    s1, s2 = (xxhash.xxh64_intdigest(data, k) for k in (1, 2))
                    out.append((*row, len(items), _signed(s1), _signed(s2), [_signed(x) for x in keys], np.packbits(bits.astype(np.uint8)).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                if counting and every:
                    counts += np.bincount(_slots(np.concatenate(every)), minlength=1 << SLOT_BITS)
        if counting and counts.any():
            blocks = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, SLOT_BLOCK)
            out = [(None, k, None, COUNTS, None, None, None, x.tobytes()) for k, x in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _slots(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _estimate(low_bits: int, count: int):
    """Similarity of two packed signatures: of two unlike minima one in 2**low_bits agrees in its low bits."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1) ^ np.frombuffer(b"".join(b), np.uint8).reshape(len(a), -1)
        if low_bits == 4:  # a byte holds two minima
            same = ((x >> 4) == 0).sum(axis=1) + ((x & 15) == 0).sum(axis=1)
        elif low_bits == 1:
            same = 8 * x.shape[1] - _ONES[x].sum(axis=1)
        else:
            same = (np.unpackbits(x, axis=1)[:, : count * low_bits].reshape(len(a), count, low_bits).sum(axis=2) == 0).sum(axis=1)
        chance = 2.0**-low_bits
        return pd.Series((same / count - chance) / (1 - chance))

    return run


def _wide(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                items = [shingles(text, words) for text in part.column(1).to_pylist()]
                bits = [((minima(x, WIDE)[:, None] >> np.arange(WIDE_BITS, dtype=np.uint32)) & 1).astype(np.uint8) for x in items]
                packed = pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.array([x.tobytes() for x in items], pa.binary())], ["node", "packed", "items"])

    return run


def _floor(percent: int, count: int, low_bits: int) -> float:
    """What an estimate from `count` minima has at least when the pair is linked, but for SLACK standard deviations."""
    chance = 2.0**-low_bits
    agree = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - SLACK * (agree * (1 - agree) / count) ** 0.5 / (1 - chance)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 2-bit minima agree in each pair of rows of 64-bit words, all against all."""
    differ = a[:, None, :] ^ b[None, :, :]
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return WIDE - np.bitwise_count(differ).sum(axis=2, dtype=np.int64)


def _compare_cells(floor: float, percent: int):
    """(a, b): for each outlier one link to each other component in the cell.

    Pairs of two outliers are looked at once, in the order of their nodes.
    """
    chance, schema = 2.0**-WIDE_BITS, pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which of the sets are linked with the set x."""
        every = np.concatenate(others)
        hits = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
        sizes = np.array([len(o) for o in others])
        common = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
        return 100 * common >= percent * (len(x) + sizes - common)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        (n1, l1), (n2, l2) = ([t[c].to_numpy() for c in ("node", "label")] for t in (one, two))
        w1, w2 = (np.frombuffer(b"".join(t["packed"].to_pylist()), np.uint64).reshape(t.num_rows, -1) for t in (one, two))
        s1, s2 = ([np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()] for t in (one, two))
        main, found = two["main"].to_numpy(), []
        for i in range(len(n1)):  # bounded memory: one outlier at a time
            may = (l2 != l1[i]) & ((l2 == main) | (n2 > n1[i]))
            may = np.flatnonzero(may)
            estimate = (_agreement(w1[i : i + 1], w2[may])[0] / WIDE - chance) / (1 - chance)
            may = may[estimate >= floor]
            if len(may):
                linked = may[links_of(s1[i], [s2[j] for j in may])]
                _, once = np.unique(l2[linked], return_index=True)
                found += [(n1[i], n2[j]) for j in linked[once]]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema) if found else schema.empty_table()

    return run


def _is_linked(words: int, percent: int):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = shingles(x, words), shingles(y, words)
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * common >= percent * (len(p) + len(q) - common))
        return pd.Series(out, dtype=bool)

    return run


def _levels(group: pa.Table) -> pa.Table:
    """The logarithms of the counts of a block of slots, a byte each."""
    total = np.zeros(SLOT_BLOCK, np.int64)
    for counts in group["counts"]:
        total += np.frombuffer(counts.as_py(), np.uint16)
    return pa.table({"block": group["block"][:1], "counts": pa.array([np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()], pa.binary())})


def _share(size: int, percent: int) -> int:
    """The least whole number that is the threshold's share of a size."""
    return -(-percent * size // 100)


def _spare(size: int, percent: int) -> int:
    """How many shingles of a set's prefix its partner has at least, if its own prefix doesn't end first."""
    return min(1 + size // SPARE, _share(size, percent))


def _least(size: Column, percent: int) -> Column:
    """How many shingles of the prefix of a set so large are in that of a set linked with it, whatever that one's size.

    The prefix that ends first lacks as many shingles of its set as the threshold's share less
    `_spare`, so of those that both sets have, `_spare` are in it and in the other; the smaller set has fewest.
    """
    share = lambda n: F.ceil(percent * n / 100)
    return F.least(1 + F.floor(share(size) / SPARE), share(share(size)))


def _prefixes(words: int, percent: int, levels: np.ndarray):
    """(token, s1, place): the first shingles of each set, those of the emptier slots first.

    A set linked with this one has at least the threshold's share of it, so of `_spare` more shingles
    than it may lack, it has so many. Sets of one shingle are only like themselves. A task gives a set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                tokens, digests, places = [], [], []
                for text in part.column(0).to_pylist():
                    items = shingles(text, words)
                    s1 = _signed(xxhash.xxh64_intdigest(items.tobytes(), 1))
                    if len(items) < 2 or s1 in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(s1)
                    first = len(items) - _share(len(items), percent) + _spare(len(items), percent)
                    tokens.append(items[np.argsort(levels[_slots(items)], kind="stable")[:first]].view(np.int64))
                    count = len(tokens[-1])
                    digests.append(np.full(count, s1))
                    places.append(np.arange(count, dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, digests, places)], ["token", "s1", "place"])

    return run


def _maps(words: int):
    """(node, size, parity): whether the number of a set's shingles in each of some slots is odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                items = [shingles(text, words) for text in part.column(1).to_pylist()]
                odd = [np.bincount((x >> np.uint64(64 - MAP_BITS)).astype(np.int64), minlength=1 << MAP_BITS) & 1 for x in items]
                packed = pa.array([np.packbits(x.astype(np.uint8)).tobytes() for x in odd], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in items], pa.int64()), packed], ["node", "size", "parity"])

    return run


def _unlike_bits():
    """In how many bits two maps differ: no more than shingles are in one of the two sets only."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int64")
        x, y = (np.frombuffer(b"".join(v), np.uint64).reshape(len(v), -1) for v in (a, b))
        return pd.Series(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64))

    return run


def _prefix_pairs(texts: DataFrame, named: DataFrame, counts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): classes with unlike labels that share a shingle of their prefixes and may be linked by their sizes and its places.

    `texts` has one column, `named` (s1, node, label, size), `counts` (block, counts). Every
    shingle counts for the order; any order gives every linked pair, this one few others. Sets that
    too few others share a prefix with are dropped, first by their shingles alone, then by those of
    other labels. A bucket of any size is dealt to the cells of a grid.
    """
    found = counts.groupBy("block").applyInArrow(_levels, "block long, counts binary").collect()  # a byte for each slot
    levels = np.frombuffer(b"".join(bytes(r.counts) for r in sorted(found, key=lambda r: r.block)), np.uint8)
    rows = texts.mapInArrow(_prefixes(words, percent, levels), "token bigint, s1 bigint, place int")

    def common(rows: DataFrame, name: str) -> DataFrame:
        """The rows whose token has several values of a column."""
        by = Window.partitionBy("token")
        return rows.withColumns({"lo": F.min(name).over(by), "hi": F.max(name).over(by)}).where("lo <> hi").drop("lo", "hi")

    shared = scratch.cut(common(rows, "s1").dropDuplicates(["token", "s1"]))
    enough = F.col("count") >= _least(F.col("size"), percent)
    met = shared.join(named.join(shared.groupBy("s1").count(), "s1").where(enough).drop("count"), "s1").select("token", "node", "label", "size", "place")
    met = scratch.cut(common(met, "label"))
    left = met.groupBy("node", "size").count().where(enough).select("node")
    # From here on one shingle that two prefixes without the spare ones have is enough.
    first = met.where(F.col("place") <= F.col("size") - F.ceil(percent * F.col("size") / 100))
    by = Window.partitionBy("token")
    last = scratch.cut(common(first.join(left, "node"), "label").withColumn("k", F.ceil(F.count("*").over(by) / MET)))
    own, every = F.pmod(F.xxhash64("node"), F.col("k")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    sides = [last.select("token", *[F.col(c).alias(c + s) for c in ("node", "label", "size", "place")], own.alias(x), every.alias(y)) for s, x, y in (("1", "i", "j"), ("2", "j", "i"))]
    like = 100 * F.least("size1", "size2") >= percent * F.greatest("size1", "size2")
    # The first shingle that two sets share has all others behind it.
    enough = (100 + percent) * (F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2"))).cast("long") >= percent * (F.col("size1") + F.col("size2")).cast("long")
    pairs = sides[0].join(sides[1], ["token", "i", "j"]).where((F.col("node1") < F.col("node2")) & (F.col("label1") != F.col("label2")) & like & enough)
    pairs = scratch.cut(pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct())
    scratch.drop(shared, met, last)
    return pairs


def components(links: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) after the labels of linked nodes have been joined.

    `labels` has one row per node. Linked labels are contracted by alternating large-star and
    small-star steps, each a join and a grouping whose output is no larger than its input, until
    every label points at the smallest of its component. The tables of a step are dropped with it.
    """
    scratch = scratch or Scratch(labels.sparkSession)
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("p")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("q")), "b")
    edges = scratch.cut(ends.where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct())
    seen, small = _digest(edges), False
    if not seen[0]:
        scratch.drop(edges)
        return labels
    while True:
        small = seen[0] <= SMALL
        cut = (lambda t: t) if small else scratch.cut  # a small step is one task, and one table
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if small else both
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        steps = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.cut(steps.where("u <> v").distinct(), small)
        before, seen = seen, _digest(new)
        scratch.drop(edges, least, large, lower)
        edges = new
        if seen == before:
            break
    roots = edges.select(F.col("u").alias("label"), F.col("v").alias("root"))
    out = scratch.cut(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
    scratch.drop(edges, labels)
    return out


def _digest(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number and two sums of hashes."""
    sums = [F.sum(h.cast("decimal(20,0)")) for h in hash_pair(5, F.col("u"), F.col("v"))]
    return tuple(edges.agg(F.count("*"), *sums).first())


def _row_hashes(id_col: str, text_col: str) -> list[Column]:
    return [h.alias(n) for h, n in zip(hash_pair(7, F.col(id_col), text_of(text_col)), ("r1", "r2"))]


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, low_bits: int = LOW_BITS, counting: bool = False) -> DataFrame:
    """doc_id, r1 and r2 (hash of the row), n_shingles, s1 and s2 (digest of the set), bands, packed.

    The last four are null for an empty set. `counting` adds the COUNTS rows of `_sets`.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_row_hashes(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_sets(words, bands, rows, low_bits, counting), SETS_DDL)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, low_bits: int = LOW_BITS
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, r1, r2 (hashes of the row).

    component_id is the smallest id reachable over links, the row's own included; of each component
    one row is kept, that of the smallest id. Null and empty texts have no shingle and link with
    nothing. Rows that repeat an id are documents of their own. A null id comes after every other:
    a component of such rows has a null component_id. An empty table gives no rows; other columns
    are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        found, best = _find_components(docs, id_col, text_col, words, percent, bands, rows, low_bits, scratch)
        scratch.keep(found, best)
    return found.join(best, "label").select("doc_id", "n_shingles", F.col("best.d").alias("component_id"), (F.col("uid") == F.col("best.u")).alias("kept"), "r1", "r2")


def _find_components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bands: int, rows: int, low_bits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, r1, r2, n_shingles, label) of each row, and (label, best): the row that stays."""
    cut = scratch.cut
    counted = cut(shingle_sets(docs, id_col, text_col, words, bands, rows, low_bits, counting=True).withColumn("uid", F.monotonically_increasing_id()))
    sets, counts = counted.where(F.col("n_shingles") != COUNTS), counted.where(F.col("n_shingles") == COUNTS).select(F.col("r1").alias("block"), F.col("packed").alias("counts"))
    # One class for each distinct set; its node is the first row that has it.
    full = sets.where("n_shingles > 0")
    classes = cut(full.groupBy("s1", "s2", "n_shingles").agg(F.min("uid").alias("node")))
    members = cut(full.join(classes.select("node"), full.uid == F.col("node"), "left_semi").select(F.col("uid").alias("node"), "r1", "r2", "n_shingles", "bands", "packed"))
    buckets = members.select("node", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "value"))
    shared = buckets.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    buckets = cut(buckets.join(shared, ["band", "value"]).where("node <> leader").select("band", "value", "leader", "node", "size"))
    labels = cut(classes.select("node", F.col("node").alias("label")))
    linked = _is_linked(words, percent)

    def near(pairs: DataFrame, signatures: DataFrame, estimate, floor: float) -> DataFrame:
        """Pairs whose signatures are similar enough to be looked at, with the estimate."""
        sides = [signatures.select(F.col("node").alias(s), F.col("packed").alias(f"p{s}")) for s in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", estimate("pa", "pb").alias("estimate"))
        return cut(both.where(F.col("estimate") >= floor))

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes; a repeated row gives its text once."""
        wanted = cut(members.join(nodes, "node").select("node", "r1", "r2"))
        # Any share of the texts may be wanted, so this is a plain shuffle of both sides at every size.
        found = docs.select(*_row_hashes(id_col, text_col), text_of(text_col).alias("text")).join(wanted.hint("merge"), ["r1", "r2"]).select("node", "text")
        found = cut(found)
        if found.count() > wanted.count():
            once = cut(found.dropDuplicates(["node"]))
            scratch.drop(found)
            found = once
        scratch.drop(wanted)
        return found

    def link(pairs: DataFrame, texts: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
        """The labels joined by the pairs that reach the threshold on their full sets, and how many those are."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = texts.join(ends, "node", "left_semi")  # later rounds have few pairs: no other text moves
        sides = [wanted.select(F.col("node").alias(s), F.col("text").alias(f"t{s}")) for s in "ab"]
        links = cut(pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").where(linked("ta", "tb")).select("a", "b"))
        n = links.count()
        labels = components(links, labels, scratch) if n else labels
        scratch.drop(links)
        return labels, n

    def mixed(labels: DataFrame) -> DataFrame:
        """Members of the buckets with several components, with `main`, the largest of them, and the shingles of all members and of those not in it."""
        inside = buckets.join(labels, "node").select("band", "value", "node", "label", "size")
        sizes = inside.groupBy("band", "value", "label").agg(F.count("*").alias("count"), F.sum("size").alias("size"))
        of = sizes.groupBy("band", "value").agg(F.max(F.struct("count", "label", "size")).alias("m"), F.sum("size").alias("all"), F.count("*").alias("labels")).where("labels > 1")
        return cut(inside.drop("size").join(of.select("band", "value", F.col("m.label").alias("main"), "all", (F.col("all") - F.col("m.size")).alias("outer")), ["band", "value"]))

    def stars_of(rows: DataFrame) -> DataFrame:
        """(a, b) for each node: of the leaders of its buckets the one with which it shares most of them."""
        shared = rows.groupBy("node", "leader").count()
        return shared.groupBy(F.col("node").alias("b")).agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("a")).select("a", "b")

    # Each class with the leader it shares most buckets with.
    texts = texts_of(buckets.select(F.explode(F.array("leader", "node")).alias("node")).distinct())
    pairs = near(stars_of(buckets), members, _estimate(low_bits, bands * rows), _floor(percent, bands * rows, low_bits))
    labels, _ = link(pairs, texts, labels)
    scratch.drop(pairs)
    # What is left: buckets that still hold several components.
    inside = mixed(labels)
    if not inside.isEmpty():
        outer = texts.join(inside.select("node").distinct(), "node", "left_semi")
        wide = cut(outer.select("node", "text").mapInArrow(_wide(words), "node bigint, packed binary, items binary"))
        floor = _floor(percent, WIDE, WIDE_BITS)
        for turn in range(STARS):
            star = F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("leader")
            leaders = inside.where("label = main").groupBy("band", "value").agg(star)
            pairs = near(stars_of(inside.where("label <> main").join(leaders, ["band", "value"])), wide, _estimate(WIDE_BITS, WIDE), floor)
            labels, n = link(pairs, texts, labels)
            scratch.drop(pairs, inside)
            inside = mixed(labels)
            if not n:
                break
        if not inside.isEmpty():
            labels = components(_outlier_links(inside, wide, floor, percent, scratch), labels, scratch)
        scratch.drop(wide)
    scratch.drop(texts, inside, buckets)
    # What no band or estimate has shown: classes that share a shingle of their prefixes.
    if not counts.isEmpty():
        named = labels.join(classes, "node").select("s1", "node", "label", F.col("n_shingles").alias("size"))
        pairs = _prefix_pairs(docs.select(text_of(text_col).cast("string").alias("text")), named, counts, words, percent, scratch)
        if not pairs.isEmpty():
            texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
            maps = cut(texts.mapInArrow(_maps(words), "node bigint, size bigint, parity binary"))
            ends = [maps.select(F.col("node").alias(s), F.col("size").alias(f"n{s}"), F.col("parity").alias(f"p{s}")) for s in "ab"]
            may = (100 + percent) * _unlike_bits()("pa", "pb") <= (100 - percent) * (F.col("na") + F.col("nb"))
            labels, _ = link(cut(pairs.join(ends[0], "a").join(ends[1], "b").where(may).select("a", "b")), texts, labels)

    named = labels.join(classes, "node").select("s1", "s2", "n_shingles", "label")
    found = sets.select("uid", "doc_id", "r1", "r2", "n_shingles", "s1", "s2").join(named, ["s1", "s2", "n_shingles"], "left")
    found = cut(found.select("uid", "doc_id", "r1", "r2", "n_shingles", F.coalesce("label", -1 - F.col("uid")).alias("label")))
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    return found, cut(found.groupBy("label").agg(F.min(order).alias("best")))


def _outlier_links(inside: DataFrame, wide: DataFrame, floor: float, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links of the members outside the main component of their bucket, one to each other component at least.

    The members of a bucket are dealt to the rows and columns of a grid by a hash; each cell, of
    about CELL by CELL shingles whatever the bucket's size, is compared on its own.
    """
    rows = inside.join(wide, "node")
    down, across = F.ceil(F.col("outer") / CELL), F.ceil(F.col("all") / CELL)
    place = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    one = rows.where("label <> main").select("band", "value", "node", "label", "packed", "items", place(down).alias("i"), every(across).alias("j"))
    two = rows.select("band", "value", "node", "label", "main", "packed", "items", place(across).alias("j"), every(down).alias("i"))
    two = two.select(*[F.col(c).alias(c) for c in two.columns])  # columns of its own, apart from those of `one`
    keys = ["band", "value", "i", "j"]
    return scratch.cut(one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(_compare_cells(floor, percent), "a bigint, b bigint").distinct())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input rows, with all their columns whatever they are called, of which one of each component stays."""
    found = near_duplicates(docs, id_col, text_col, **parameters)
    stays = found.where("kept").select("r1", "r2").distinct()
    # Of rows without a shingle every one stays, repeated or not; of others with the same id and text, one.
    empty = F.trim(F.translate(text_of(text_col), "\t\n\x0b\x0c\r", "     ")) == ""
    keyed = docs.select(*_row_hashes(id_col, text_col), empty.alias("empty"), share(), F.struct("*").alias("row"))
    kept = keyed.join(stays, ["r1", "r2"], "left_semi")
    if has_repeats(found.where("n_shingles > 0"), "r1", "r2"):
        kept = one_of_each(kept.where("not empty"), "r1", "r2").union(kept.where("empty"))
    return kept.select("row.*")
