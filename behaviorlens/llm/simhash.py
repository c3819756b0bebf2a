"""Near-duplicate detection by SimHash, with exact comparison in tiles.

A fingerprint has 64 bits, each the majority of that bit over the hashes of all word shingles.
Two are linked when they differ in at most `radius` bits. Equal fingerprints are one from then on.

The bits are cut into blocks. Two linked fingerprints agree in all but `radius` of them, so they meet
in a bucket of equal bits for at least one choice of the other blocks: no link is lost. The number
of blocks follows the number of fingerprints, so that a bucket of evenly spread ones stays small;
more blocks mean longer keys and more choices. A bucket that is larger all the same is dealt by a
hash to as many shares as it needs, and each pair of shares is a cell of bounded size.

In a cell the fingerprints are sorted by their population count and cut into tiles. Two tiles whose
population counts differ by more than the radius hold no link and are skipped; the others are
compared all against all by exclusive-or and bit counts. Out of a cell comes a spanning forest of
what is linked, which is no larger than the cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch
from behaviorlens.llm.neardup import components

BITS, SHINGLE_WORDS, SEED, RADIUS = 64, 4, 42, 4
#: Fingerprints of a bucket that the number of blocks aims at, of a share of a bucket, and of a tile, at most.
BUCKET, SHARE, TILE = 4096, 4096, 512
#: Shingles that are hashed at a time.
PART = 1 << 14

_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text, as a signed word; 0 for a text without words."""
    data = np.frombuffer((text or "").encode().lower() + b" ", np.uint8)  # of bytes, A-Z alone are lower-cased
    space = _SPACE[data]
    kept = ~space
    kept[1:] |= ~space[:-1]  # one blank after each word, so that a shingle is a slice
    if not kept.any():
        return 0
    buffer = np.where(space, np.uint8(ord(" ")), data)[kept]
    ends = np.flatnonzero(buffer == ord(" "))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(ends) - words + 1)
    low, high = starts[:n], ends[min(words, len(ends)) - 1 :][:n]
    ones = np.zeros(BITS, np.int64)
    view = memoryview(buffer.tobytes())
    for i in range(0, n, PART):
        hashes = [xxhash.xxh64_intdigest(view[a:b], SEED) for a, b in zip(low[i : i + PART].tolist(), high[i : i + PART].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """The fewest blocks for which evenly spread fingerprints leave BUCKET of them in a bucket."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and count >> sum(_widths(blocks)[radius:]) > BUCKET:
        blocks += 1
    return blocks


def _widths(blocks: int) -> list[int]:
    """How many bits each block has; the widest come first."""
    return [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits of every choice of all blocks but `radius`."""
    widths, at, each = _widths(blocks), 0, []
    for w in widths:
        each.append(((1 << w) - 1) << at)
        at += w
    return [sum(chosen) for chosen in combinations(each, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, blocks: int, radius: int) -> Column:
    """(choice, bits) of each bucket of a fingerprint."""
    return F.array(*[F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for k, m in enumerate(masks(blocks, radius))])


def forest(fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the same fingerprints as all links of a cell do; with `side`, of links across sides alone.

    The tiles are compared one pair at a time, and so are kept the root of each fingerprint.
    """
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    x = fps[order]
    ones, root, tied = np.bitwise_count(x).astype(np.int64), np.arange(len(x)), None if side is None else side[order]
    starts = range(0, len(x), TILE)
    for i in starts:
        for j in range(i, len(x), TILE):
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            if ones[j] - ones[min(i + TILE, len(x)) - 1] > radius:
                break  # and so are all tiles after it
            near = np.bitwise_count(x[a, None] ^ x[None, b]) <= radius
            if tied is not None:
                near &= tied[a, None] != tied[None, b]
            p, q = np.nonzero(near)
            p, q = p + i, q + j
            open_ = root[p] != root[q]
            while open_.any():  # hang the larger root under the smaller, then let all point at their roots
                p, q = p[open_], q[open_]
                u, v = np.maximum(root[p], root[q]), np.minimum(root[p], root[q])
                np.minimum.at(root, u, v)
                while (root[root] != root).any():
                    root = root[root]
                open_ = root[p] != root[q]
    child = np.flatnonzero(root != np.arange(len(x)))
    return x[child], x[root[child]]


def _compare(radius: int):
    """Links of the cells of a sorted partition; a cell ends where its key changes."""

    def of(cell: pa.Table) -> pa.RecordBatch:
        fps = cell["fp"].to_numpy().view(np.uint64)
        across = cell["i"][0].as_py() != cell["j"][0].as_py()
        a, b = forest(fps, radius, cell["first"].to_numpy() if across else None)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = [table[c].to_numpy() for c in ("choice", "bits", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = [0, *new.tolist()]
            for s, e in zip(starts, starts[1:]):
                if e - s > 1:
                    yield of(table.slice(s, e - s))
            rest = table.slice(starts[-1])
        if rest is not None and rest.num_rows > 1:
            yield of(rest)

    return run


def links(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between distinct fingerprints that join the same ones as all links do."""
    count = fps.count()
    blocks = blocks_for(count, radius)
    rows = fps.select("fp", F.explode(_keys(F.col("fp"), blocks, radius)).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    big = scratch.cut(sizes.where(F.col("n") > SHARE).select("choice", "bits", F.ceil(F.col("n") / SHARE).alias("shares")))
    if big.isEmpty():
        cells = rows.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "first": F.lit(True)})
    else:
        dealt = rows.join(big, ["choice", "bits"], "left").withColumn("shares", F.coalesce("shares", F.lit(1).cast("long")))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(13)), "shares"))
        # The share of a fingerprint meets every share, itself included, once: the smaller number comes first.
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        cells = met.select("fp", "choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"))
    keys = ["choice", "bits", "i", "j"]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.repartition(n, *keys).sortWithinPartitions(*keys)
    return scratch.cut(sorted_cells.select("fp", *keys, "first").mapInArrow(_compare(radius), "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest id reachable over links, the row's own included. Null and empty
    texts, and those of white space alone, have fingerprint 0, which links like any other. Rows
    that repeat an id each have their row. Null ids never are a component's id unless all of its
    ids are null. A text of any length is hashed in parts, with a few bytes of memory for each of
    its own. An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.cut(texts.mapInArrow(_fingerprints(words), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp bigint"))
        fps = scratch.cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
        labels = scratch.cut(fps.select(F.col("fp").alias("node"), F.col("fp").alias("label")))
        labels = components(links(fps, radius, scratch), labels, scratch)
        named = fps.join(labels, fps.fp == labels.node).select("fp", "label", "least")
        ids = scratch.cut(named.groupBy("label").agg(F.min("least").alias("component_id")))
        whole = scratch.cut(named.join(ids, "label").select("fp", "component_id"))
        scratch.keep(found, whole)
    return found.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
