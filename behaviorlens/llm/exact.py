"""Exact deduplication by deterministic block naming.

Each text, without its white space, is cut into blocks of a fixed number of bytes. The distinct
blocks are sorted and numbered: two blocks have the same number only if they are the same bytes.
Then adjacent numbers are paired, the distinct pairs sorted and numbered in turn, and so on, until
one number is left for each document. Two documents have the same (level, number) exactly when
their texts are equal; nothing rests on a hash being free of collisions.

Block text is moved once, to be sorted. Its occurrences find their number through a 128-bit digest
that has been proven to be one-to-one on this very corpus; if it is not, it is drawn anew with
another seed. Every grouping is pre-aggregated, and every join has two plain shuffles, so adaptive
execution splits the partition of a group of copies that holds a large part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch, has_repeats, hash_pair, one_of_each, share, text_of, without_white_space

BLOCK_BYTES = 4096


def _blocks(text: Column, block_bytes: int) -> Column:
    """Blocks of a binary column; an empty text has one empty block."""
    last = F.greatest(F.lit(0), (F.octet_length(text) - 1).cast("long"))
    return F.transform(
        F.sequence(F.lit(0), F.floor(last / block_bytes).cast("int")),
        lambda i: F.substring(text, i * block_bytes + 1, F.lit(block_bytes)),
    )


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, each with an integer that follows their order within its partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(raw: DataFrame, block_bytes: int, digest, scratch: Scratch) -> tuple[DataFrame, int]:
    """(h1, h2, name) of every distinct block, and the seed with which the digest tells all of them apart."""
    seed = 0
    while True:
        blocks = raw.select(F.explode(_blocks(F.col("raw"), block_bytes)).alias("block")).distinct()
        h1, h2 = digest(seed, F.col("block"))
        names = scratch.cut(_numbered(blocks, "block").select(h1.alias("h1"), h2.alias("h2"), "name"))
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            return names, seed
        scratch.drop(names)
        seed += 1


def identify_texts(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest=hash_pair) -> DataFrame:
    """One row per input row: uid, doc_id, n_chars, text_sha256, level, name.

    (level, name) is the same for two rows exactly when their texts are equal after white space
    is deleted. uid numbers the rows, so repeated and null ids stay apart. Null and empty texts,
    and texts of white space only, are equal to one another; a very long text is many blocks, which
    are rows of their own. Other columns are ignored.
    """
    raw = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text_of(text_col)).cast("long").alias("n_chars"),
        F.encode(without_white_space(text_of(text_col)), "UTF-8").alias("raw"),
    )
    names, seed = _block_names(raw.select("raw"), block_bytes, digest, scratch)
    base = scratch.cut(
        raw.select(
            "doc_id",
            "n_chars",
            F.sha2("raw", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("raw"), block_bytes), lambda b: F.struct(*[h.alias(n) for h, n in zip(digest(seed, b), ("h1", "h2"))])).alias("digests"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    rest = scratch.cut(
        base.select("uid", F.size("digests").alias("n"), F.posexplode("digests").alias("i", "digest"))
        .select("uid", "n", "i", F.col("digest.h1").alias("h1"), F.col("digest.h2").alias("h2"))
        .join(names, ["h1", "h2"])
        .select("uid", "n", "i", "name")
    )
    scratch.drop(names)
    level, done = 0, []
    longest = rest.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(scratch.cut(rest.where("n = 1").select("uid", F.lit(level).alias("level"), "name")))
        if longest == 1:
            break
        level, longest = level + 1, (longest + 1) // 2
        odd = F.col("i") % 2 == 1
        pairs = scratch.cut(
            rest.where("n > 1")
            .groupBy("uid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("i") / 2).cast("int").alias("i"))
            .agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right"))
        )
        names = scratch.cut(_numbered(pairs.select("left", "right").distinct(), "left", "right"))
        scratch.drop(rest)
        rest = scratch.cut(pairs.join(names, ["left", "right"]).select("uid", "n", "i", "name"))
        scratch.drop(pairs, names)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return base.drop("digests").join(found, "uid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest=hash_pair) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the row with the most code points stays, among ties the one with the smallest
    id; a null id comes after every other; of fully repeated rows exactly one stays.
    An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.cut(identify_texts(docs, scratch, id_col, text_col, block_bytes, digest))
        best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("uid").alias("u")))
        groups = scratch.cut(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best")))
        scratch.keep(rows, groups)
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.u")).alias("kept"), "text_sha256", "n_chars"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input rows, with all their columns whatever they are called, of which one of each group of equal texts stays."""
    def key(doc_id: str | Column, n_chars: Column, sha: Column) -> list[Column]:
        return [F.xxhash64(F.lit(k), doc_id, n_chars, sha).alias(f"k{k}") for k in (0, 1)]

    groups = exact_groups(docs, id_col, text_col, block_bytes)
    stays = groups.where("kept").select(*key("doc_id", F.col("n_chars"), F.col("text_sha256")))
    text = text_of(text_col)
    keyed = docs.select(*key(id_col, F.char_length(text).cast("long"), F.sha2(F.encode(without_white_space(text), "UTF-8"), 256)), share(), F.struct("*").alias("row"))
    found = keyed.join(stays, ["k0", "k1"], "left_semi")
    # Only rows with the same id and the same text are still there more than once.
    found = one_of_each(found, "k0", "k1") if has_repeats(groups, "doc_id", "n_chars", "text_sha256") else found
    return found.select("row.*")
