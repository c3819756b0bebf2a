"""Line deduplication with per-document keep bitmaps.

Every line becomes a 128-bit hash of its key with the document and position it came from; no text
is moved for the search. The hashes are range-partitioned, with a secondary sort by document and
position, and streamed: the first occurrence of a key in each document is flagged, and the flags
are summed per key. A key found in enough documents marks all of its occurrences, which come back
as one compressed bitmap of kept lines per document. Only that bitmap meets the text again.

The bitmap is compressed by leaving out what is the rule: its words of 64 lines are stored only
where some line of them goes; a word that isn't there keeps all of its lines.

A key that holds a large part of all lines is salted by document before the range partitioning,
its flags are pre-aggregated, and the join that marks its occurrences has two plain shuffles, so
that adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import WHITE_SPACE, Scratch, ascii_lower, hash_pair, shuffle_partitions, text_of

#: Lines in one bitmap word.
WORD = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE_SPACE)))


def _row_hashes(id_col: str, text_col: str) -> list[Column]:
    """The identity of a row: its id and its whole text."""
    return [h.alias(n) for h, n in zip(hash_pair(7, F.col(id_col), text_of(text_col)), ("r1", "r2"))]


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key_chars: int = 1) -> DataFrame:
    """One row per line whose key is long enough: r1, r2 (the row), doc_id, position, h1, h2."""
    lines = _lines(text_of(text_col))
    hashed = F.transform(lines, lambda x: F.struct(F.char_length(_key(x)).alias("n"), *[h.alias(a) for h, a in zip(hash_pair(3, _key(x)), ("h1", "h2"))]))
    return (
        docs.select(*_row_hashes(id_col, text_col), F.col(id_col).alias("doc_id"), F.posexplode(hashed).alias("position", "x"))
        .where(F.col("x.n") >= min_key_chars)
        .select("r1", "r2", "doc_id", "position", F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
    )


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """The occurrences in key order with `first`: true for the first one of its key in its document."""
    n = shuffle_partitions(occurrences.sparkSession)
    salted = occurrences.withColumn("salt", F.pmod(F.col("r2"), F.lit(n)))
    within = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "r1", "r2", "position")
    before = F.lag(F.struct("r1", "r2")).over(within)
    return salted.repartitionByRange(n, "h1", "h2", "salt").withColumn("first", ~before.eqNullSafe(F.struct("r1", "r2")))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """r1, r2, keep: the bitmap of kept lines as sorted (word, bits), bit i of word w set where line 64 w + i stays.

    Words whose lines all stay are left out, and so are rows that lose nothing: a bitmap is in
    proportion to the lines that go, wherever they stand in a text of any length.
    """
    with Scratch(docs.sparkSession) as scratch:
        seen = scratch.cut(line_occurrences(docs, id_col, text_col, min_key_chars))
        counts = first_occurrences(seen).groupBy("h1", "h2").agg(F.count_if("first").alias("n_docs"))
        frequent = scratch.cut(counts.where(F.col("n_docs") >= min_docs).select("h1", "h2"))
        scratch.keep(seen, frequent)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("position") % WORD).cast("int"))
    words = (
        seen.join(frequent, ["h1", "h2"])
        .groupBy("r1", "r2", F.floor(F.col("position") / WORD).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("r1", "r2")
        .agg(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"))
    )
    return words


def _kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that stay: runs before each stored word, the kept ones of its lines, and the run after the last."""
    start = lambda k: F.when(k == 0, 0).otherwise((F.get(keep, k - 1)["word"] + 1) * WORD)

    def until(entry: Column, k: Column) -> Column:
        at = entry["word"] * WORD
        own = F.filter(F.slice(lines, at + 1, F.lit(WORD)), lambda _, i: F.call_function("getbit", entry["bits"], i) == 1)
        return F.concat(F.slice(lines, start(k) + 1, at - start(k)), own)

    after = F.element_at(keep, -1)["word"] + 1
    rest = F.slice(lines, after * WORD + 1, F.greatest(F.lit(0), F.size(lines) - after * WORD))
    return F.concat(F.flatten(F.transform(keep, until)), rest)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, keep (the bitmap), kept (the text left).

    Lines are split at line feeds; a null or empty text has one empty line. A line's key is the
    line without white space at both ends, A-Z lower-cased. Keys of at least `min_key_chars` code
    points found in at least `min_docs` documents lose all their lines everywhere; repeats inside
    a document count once, and rows with the same id and text count as one document. A row that
    loses nothing has a null bitmap. Ids may be null or repeat; texts and lines may be of any length; an empty table gives no rows; other columns are ignored.
    """
    bitmaps = keep_bitmaps(docs, min_docs, min_key_chars, id_col, text_col)
    rows = docs.select(*_row_hashes(id_col, text_col), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    joined = rows.join(bitmaps, ["r1", "r2"], "left").withColumn("lines", _lines(F.col("text")))
    joined = joined.withColumn("kept_lines", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(_kept_lines(F.col("lines"), F.col("keep"))))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        "keep",
        F.array_join("kept_lines", "\n").alias("kept"),
    )
