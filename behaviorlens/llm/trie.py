"""The prefix trie of conversations, as a Cartesian tree over the LCP array of the sorted conversations.

A conversation is the sequence of its turns, each a pair of digests of role and text. Conversations
are range-partitioned and sorted; a partition is a block. LCP[j] is how many first turns the j-th
has in common with the one before it. The node of depth d that holds j reaches from the nearest
position to the left whose LCP is below d to the next one to the right: nearest smaller values.

In a block these are found with a stack, on either side. The pointers to the next smaller value lead
from one LCP interval to the one around it; equal values have the same interval, so they are one
node, and the depths between two intervals of the chain, where nothing branches, are filled in. All
figures of a node are sums, or the least, over its interval: the saved words of a subtree, too, are
the words of its conversations less those of its nodes.

Nodes that hold the first or the last conversation of a block may reach across its borders. Their
parts, as many as a block's first and last conversation have turns, are put together in a second
step: a part belongs to the nearest block to the left whose least LCP is below the part's depth,
which the minima of the blocks, one number for each, tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch, hash_pair, shuffle_partitions, text_of

#: Conversations c to c + FAMILY - 1 start like conversation c, a multiple of FAMILY, with fewer turns than LEAD.
FAMILY, LEAD = 20, 4
#: Conversations of a block, on average, at most.
BLOCK = 1 << 16
#: An LCP that no conversation has.
ENDLESS = np.iinfo(np.int64).max

NODE = {
    "kind": pa.string(), "block": pa.int32(), "depth": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "words": pa.int64(), "node_words": pa.int64(), "before": pa.int64(), "ends": pa.string(), "parent": pa.int64(), "parent_kind": pa.string(),
    "prefix": pa.binary(), "here": pa.int64(), "inner": pa.int64(), "through": pa.bool_(), "longer": pa.bool_(), "first_words": pa.int64(), "last_length": pa.int64(),
}
PART = {"owner": pa.int32(), "owner_kind": pa.string(), "block": pa.int32(), "kind": pa.string(), "depth": pa.int64(), "conv_id": pa.int64()}
FIGURES = ("n_convs", "n_children", "n_leaves", "words", "node_words")
PART |= {c: pa.int64() for c in FIGURES} | {"before": pa.int64(), "ends": pa.string(), "up": pa.int32(), "up_kind": pa.string()}


def _ddl(columns: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{c} {names[t]}" for c, t in columns.items())


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its own turns in order: k0 and k1, digests of role and text, and the words of the text."""
    text = text_of("text")
    keys = [h.alias(k) for h, k in zip(hash_pair(17, F.coalesce("role", F.lit("")), text), ("k0", "k1"))]
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *keys, F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k0", "k1", "words"))).alias("own"))
    return own.select("conv_id", F.transform("own", lambda t: F.struct(t["k0"].alias("k0"), t["k1"].alias("k1"), t["words"].alias("words"))).alias("seq"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with the first turns of the first of its family in place of its own."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD).cast("int")
    base: Column = F.col("conv_id") - F.col("conv_id") % FAMILY
    leads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, LEAD - 1).alias("lead"))
    both = own.select("conv_id", "seq", h.alias("h"), base.alias("base")).join(leads, "base", "left")
    none = F.slice("seq", 1, F.lit(0))
    head, rest = F.slice(F.coalesce("lead", none), F.lit(1), F.col("h")), F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("seq"))


def common_prefixes(k0: np.ndarray, k1: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the one before it; -1 for the first."""
    shared = np.minimum(length[1:], length[:-1])
    if not len(shared):
        return np.full(len(length), -1)
    heads = np.cumsum(shared + 1) - (shared + 1)  # each pair has one place more than turns to compare, where both end
    at = np.arange(heads[-1] + shared[-1] + 1) - np.repeat(heads, shared + 1)
    end = at == np.repeat(shared, shared + 1)
    a, b = (np.where(end, 0, np.repeat(s, shared + 1) + at) for s in (start[:-1], start[1:]))
    differ = end if not len(k0) else end | (k0[a] != k0[b]) | (k1[a] != k1[b])
    return np.concatenate([[-1], np.minimum.reduceat(np.where(differ, at, ENDLESS), heads)])


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one to the left (-1: none) and to the right (the length: none) with a smaller value."""
    n = len(values)
    left, right, stack = [-1] * n, [n] * n, []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][1] > v:
            right[stack.pop()[0]] = i
        same = stack and stack[-1][1] == v
        left[i] = left[stack[-1][0]] if same else stack[-1][0] if stack else -1
        stack.append((i, v))
    return np.array(left), np.array(right)


def intervals(lcp: np.ndarray, length: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, depth, end) of all nodes, by first and depth: a sequence opens the depths beyond its LCP."""
    n, ends = len(lcp), np.append(lcp, -1)
    j, k, high, found = np.arange(n), np.arange(1, n + 1), length.copy(), []
    while len(j):
        low = np.maximum(lcp[j], ends[k])
        count = np.maximum(high - low, 0)
        first = np.repeat(j, count)
        depth = np.repeat(low + 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append((first, depth, np.repeat(k, count)))
        high = np.minimum(high, ends[k])
        go = high > lcp[j]
        j, k, high = j[go], right[k[go]], high[go]
    first, depth, end = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((depth, first))
    return first[order], depth[order], end[order]


def _prefix_digests(k0: np.ndarray, k1: np.ndarray) -> list[bytes]:
    """Of a sequence, the digests of its first 0, 1, ... turns."""
    h, out = hashlib.blake2b(digest_size=16), []
    for turn in (b"", *np.stack([k0, k1], axis=1).astype("<i8")):
        h.update(bytes(turn))
        out.append(h.digest())
    return out


def nodes_of_block(block: int, conv: np.ndarray, start: np.ndarray, length: np.ndarray, k0: np.ndarray, k1: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """The nodes of a block: whole ones, and parts of kind H (with the first sequence) or T (with the last one alone)."""
    n, lcp = len(conv), common_prefixes(k0, k1, start, length)
    left, right = nearest_smaller(lcp)
    first, depth, end = intervals(lcp, length, right)
    sums = np.concatenate([[0], np.cumsum(words)])

    def words_of(j: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Words of the first d turns."""
        return sums[start[j] + np.maximum(d, 0)] - sums[start[j]]

    def over(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[high] - total[low]

    every = np.arange(n)
    total, opened = words_of(every, length), length > lcp
    leaf = np.append(lcp[1:] < length[:-1], False)  # whether the last one is a leaf depends on the next block
    before = words_of(first, depth - 1)
    head = first == 0
    branch = np.sort(lcp[opened] * (n + 1) + every[opened])
    children = np.searchsorted(branch, depth * (n + 1) + end) - np.searchsorted(branch, depth * (n + 1) + first + 1)
    longer = length[first] > depth
    own = np.where(head, 0, total[first] - before)
    kind = np.where(head, "H", np.where(end == n, "T", ""))
    least = np.minimum.reduceat(np.append(conv, ENDLESS), np.stack([first, end], axis=1).ravel())[::2]

    # The node around: the same first one, a depth less, or the interval of the first one's own LCP.
    index = np.cumsum(np.maximum(length - lcp, 0)) - np.maximum(length - lcp, 0)
    above = np.where(depth - 1 > lcp[first], first, left[first])
    up = np.where(depth > 0, index[np.maximum(above, 0)] + depth - 1 - (lcp[np.maximum(above, 0)] + 1), 0)
    parent = [int(least[u]) if d and not kind[u] else None for u, d in zip(up.tolist(), depth.tolist())]
    parent_kind = np.where(depth > 0, kind[up], "")

    after = np.append(np.flatnonzero(opened), n)
    run = after[np.searchsorted(after, first, "right")]  # repetitions of a sequence follow it, by conv_id
    empty = hashlib.sha256(b"").hexdigest()
    ends = []
    for j, d, e, r, k in zip(first.tolist(), depth.tolist(), end.tolist(), run.tolist(), kind.tolist()):
        ids = ",".join(map(str, conv[j:r].tolist())) if d == length[j] else ""
        ends.append(ids if k else hashlib.sha256(ids.encode()).hexdigest() if ids else empty)

    inner = int(lcp[1:].min()) if n > 1 else ENDLESS
    prefix = [None] * len(first)
    for at in (0, n - 1):
        of = _prefix_digests(k0[start[at] : start[at] + length[at]], k1[start[at] : start[at] + length[at]])
        for i in np.flatnonzero(head if at == 0 else (end == n) & ~head).tolist():
            prefix[i] = of[depth[i]]
    columns = {
        "kind": kind, "block": np.full(len(first), block), "depth": depth, "conv_id": least, "n_convs": end - first, "n_children": children + np.where(head, 0, longer), "n_leaves": over(leaf, first, end),
        "words": over(total, first, end), "node_words": own + over(total - words_of(every, lcp), first + 1, end), "before": before, "ends": ends, "parent": parent, "parent_kind": parent_kind,
        "prefix": prefix, "here": words_of(first, depth), "inner": np.full(len(first), inner), "through": end == n, "longer": longer, "first_words": np.full(len(first), total[0]), "last_length": np.full(len(first), length[-1]),
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in NODE.items()], list(NODE))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    seq = pa.concat_arrays(table["seq"].chunks)
    length = seq.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = seq.flatten()
    k0, k1, words = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("k0", "k1", "words"))
    out = nodes_of_block(TaskContext.get().partitionId(), table["conv_id"].to_numpy(), np.cumsum(length) - length, length, k0, k1, words)
    for i in range(0, out.num_rows, 10_000):
        yield out.slice(i, 10_000)


class Borders:
    """What the blocks have at their borders, in the order of the blocks: a few numbers for each of them."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["block"])
        self.place = {r["block"]: i for i, r in enumerate(rows)}
        self.inner = [r["inner"] for r in rows]
        self.lcp = [-1 if r["lcp"] is None else r["lcp"] for r in rows]  # of the first sequence with the last one before
        self.lead = [r["lead"] or 0 for r in rows]  # words of what those share
        self.blocks = [r["block"] for r in rows]
        self.minima = np.array([min(a, b) for a, b in zip(self.inner, self.lcp)], np.int64)

    def owner(self, block: int, kind: str, depth: int) -> tuple[int, str]:
        """The part that opens the node to which a part belongs."""
        i = self.place[block]
        if kind == "T" or self.lcp[i] < depth:
            return block, kind
        i = int(np.flatnonzero(self.minima[:i] < depth)[-1])
        return self.blocks[i], "T" if self.inner[i] < depth else "H"

    def above(self, block: int, kind: str, depth: int) -> tuple[int, str]:
        """The part that opens the parent of the node which a part opens."""
        return self.owner(block, "T" if kind == "T" and self.inner[self.place[block]] < depth - 1 else "H", depth - 1)

    def after(self, block: int) -> int:
        """The LCP of the next block's first sequence."""
        i = self.place[block] + 1
        return self.lcp[i] if i < len(self.lcp) else -1


def _placed(borders: Borders):
    """Parts with the part that opens their node, and with what their border adds to their figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                block, kind, depth = r["block"], r["kind"], r["depth"]
                owner, owner_kind = borders.owner(block, kind, depth)
                if kind == "H":
                    i = borders.place[block]
                    r["n_children"] += r["longer"] and borders.lcp[i] <= depth
                    r["node_words"] += r["first_words"] - (r["before"] if borders.lcp[i] < depth else borders.lead[i])
                if r["through"]:
                    r["n_leaves"] += borders.after(block) < r["last_length"]
                up, up_kind = borders.above(block, kind, depth) if depth and (owner, owner_kind) == (block, kind) else (None, None)
                out.append(r | {"owner": owner, "owner_kind": owner_kind, "up": up, "up_kind": up_kind})
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in PART} for r in out], pa.schema(PART))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the sorted parts of each node; ids go through the hash as they come."""
    node, sha, some, key = None, None, False, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([node | {"ends": sha.hexdigest()}], pa.schema(PART))

    for batch in batches:
        for r in batch.to_pylist():
            if (r["owner"], r["owner_kind"], r["depth"]) != key:
                if node is not None:
                    yield done()
                node, sha, some, key = r, hashlib.sha256(), False, (r["owner"], r["owner_kind"], r["depth"])
            else:
                for c in FIGURES:
                    node[c] += r[c]
                node["conv_id"] = min(node["conv_id"], r["conv_id"])
            if r["ends"]:
                sha.update((("," if some else "") + r["ends"]).encode())
                some = True
    if node is not None:
        yield done()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; turns follow `turn`, null first, and turns of the same number
    the digests of role and text. A repeated row is a turn of its own. Rows without a conv_id
    belong to no conversation and are left out. A conversation that is rebuilt without a turn is a
    member of the root. Texts of any length are seen by their digests and words alone; the turns
    of one conversation, 24 bytes each, are sorted together in one task. Two turns are taken for one with a
    probability of about 3e-39 a pair. An empty table gives no rows; other columns are ignored.
    """
    spark = conversations.sparkSession
    with Scratch(spark) as scratch:
        own = scratch.cut(turns(conversations))
        whole = scratch.cut(rebuilt(own))
        blocks = max(shuffle_partitions(spark), -(-whole.count() // BLOCK))
        sequences = whole.repartitionByRange(blocks, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
        nodes = scratch.cut(sequences.select("conv_id", "seq").mapInArrow(_blocks, _ddl(NODE)))
        scratch.drop(own, whole)
        parts = nodes.where("kind <> ''")
        borders = Borders(_borders(parts).collect())  # a row for each block
        placed, key = scratch.cut(parts.mapInArrow(_placed(borders), _ddl(PART))), ["owner", "owner_kind", "depth"]
        merged = scratch.cut(placed.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key, "block").mapInArrow(_merged, _ddl(PART)))
        # Of each part, as large as it is in its block, the least id of the whole node.
        parents = scratch.cut(placed.select("block", "kind", "depth", *key[:2]).join(merged.select(*key, F.col("conv_id").alias("parent")), key).select("block", "kind", F.col("depth") + 1, "parent").toDF("up", "up_kind", "depth", "parent"))
        scratch.keep(nodes, merged, parents)
    saved = F.col("words") - F.col("n_convs") * F.col("before") - F.col("node_words")
    figures = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    closed = nodes.where("kind = ''")
    known = closed.where("parent_kind = ''").select(F.col("parent").alias("parent_conv_id"), *figures)
    across = closed.where("parent_kind <> ''").select("block", "parent_kind", *figures).toDF("up", "up_kind", *known.columns[1:]).union(merged.select("up", "up_kind", *figures))
    joined = across.join(parents, ["up", "up_kind", "depth"], "left").select(F.col("parent").alias("parent_conv_id"), *known.columns[1:])
    return known.union(joined).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _borders(parts: DataFrame) -> DataFrame:
    """block, inner (the least LCP inside), lcp (of its first sequence with the last one before it), lead (their common words)."""
    heads, tails = parts.where("kind = 'H'"), parts.where("through")
    blocks = heads.groupBy("block").agg(F.first("inner").alias("inner"))
    blocks = blocks.withColumn("previous", F.lag("block").over(Window.orderBy("block")))  # a row for each block
    first = heads.select("block", "depth", "prefix", "here").join(blocks.select("block", "previous"), "block")
    last = tails.select(F.col("block").alias("previous"), "depth", "prefix")
    same = first.join(last, ["previous", "depth", "prefix"]).groupBy("block").agg(F.max("depth").alias("lcp"), F.max_by("here", "depth").alias("lead"))
    return blocks.join(same, "block", "left").select("block", "inner", "lcp", "lead")
