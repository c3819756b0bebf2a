"""A file format for token ids with random access: directly addressable codes.

The ids of a segment are split into 8-bit chunks, lowest first. Level k holds chunk k of every id
that has one; a continuation bitmap says which ids of a level go on in the next, and a directory
holds the number of set bits before each block of the bitmap. The chunk of id i on the next level
is then at rank(i), so any id can be read without decoding those before it.

The files are Parquet tables that Spark writes and reads, one row per segment, uncompressed, and
each segment ends with a document. Segments of a shard, and shards of a folder, follow ascending
doc_id. `read_tokens` gives the ids at any positions of the whole folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import new_folder, shuffle_partitions
from behaviorlens.llm.tokens import encoder

CHUNK_BITS = 8
#: Bits of a bitmap between two entries of its rank directory.
BLOCK = 512
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 1 << 18

LEVEL = pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema(
    [("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))]
)
SEGMENT_DDL = "shard int, segment int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, levels array<struct<chunks: binary, bitmap: binary, ranks: binary>>"
DOCUMENT_DDL = "shard int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of an array of unsigned ids; an empty array has one empty level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & (2**CHUNK_BITS - 1)).astype(np.uint8)
        rest = rest >> CHUNK_BITS
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(_ONES[bitmap], np.arange(0, len(bitmap), BLOCK // 8), dtype=np.uint32) if len(bitmap) else np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)))[: max(1, len(ones))].astype("<u4")
        levels.append({"chunks": chunks.tobytes(), "bitmap": bitmap.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more]
        if not len(rest):
            return levels


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["bitmap"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i: a directory entry, and at most one block."""
        block = min(i // BLOCK, len(ranks) - 1)
        bits = np.unpackbits(bitmap[block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(bits[: i - block * BLOCK].sum())

    def read(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop]; touches only the chunks and bitmap bytes of that range."""
        out = np.zeros(stop - start, np.uint32)
        at = np.arange(stop - start)
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            if start >= stop:
                break
            out[at] |= chunks[start:stop].astype(np.uint32) << (CHUNK_BITS * k)
            more = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            at = at[more]
            start = self._rank(bitmap, ranks, start)
            stop = start + len(at)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


def _segments(path: str, keeps_space: bool, end_id: int, segment_ids: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        words = encoder(path, keeps_space)
        docs, lengths, held, size = [], [], [], 0

        def segment() -> pa.RecordBatch:
            levels = encode_levels(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": number, "first": first, "n_ids": size, "doc_ids": docs, "lengths": lengths, "levels": levels}], SEGMENT)

        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                    docs.append(doc_id)
                    held += (ids, end)
                    lengths.append(len(ids) // 4 + 1)
                    size += lengths[-1]
                    if size >= segment_ids:
                        yield segment()
                        number, first = number + 1, first + size
                        docs, lengths, held, size = [], [], [], 0
            if docs:
                yield segment()
        finally:
            words.forget()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, keeps_space: bool = False, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every text, appends `end_id`, and writes the ids to `folder` in ascending id order.

    Null texts are empty and have the end id alone. Null ids come first; rows with the same id
    follow a hash of their text. An empty table writes no segment; other columns are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(_segments(tokenizer, keeps_space, end_id, segment_ids), SEGMENT_DDL).write.option("compression", "uncompressed").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, lengths = Codes(row["levels"]), np.array(row["lengths"])
            stops = np.cumsum(lengths)
            crcs = [zlib.crc32(codes.read(b - n, b).astype("<u4").tobytes()) for b, n in zip(stops.tolist(), row["lengths"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(lengths), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + stops - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a folder: doc_id, start, n_tokens, ids_crc32.

    `start` is the number of ids before it: those of earlier shards, of which there are as many
    as there were partitions, and those of its own.
    """
    segments = spark.read.schema(SEGMENT_DDL).parquet(folder)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = segments.select("shard", "first", "doc_ids", "lengths", "levels").mapInArrow(_documents, DOCUMENT_DDL)
    return rows.join(shards.select("shard", before.alias("before")), "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one segment at a time
            codes = Codes(row["levels"])
            ids = [codes[i - row["start"]] for i in row["positions"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["positions"], pa.int64()), pa.array(ids, pa.int64())], ["position", "id"])


#: Segments that are named to the scan, at most; more are joined.
FEW = 1000


def read_tokens(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """(position, id) for each distinct position asked for, counted over all ids of the folder from 0; others are left out.

    A position finds its segment by the stretch of SEGMENT_IDS positions it lies in, and its id by
    one look at each level: no other id is decoded, and of few positions no other segment's levels
    are read. Null positions are left out.
    """
    segments = spark.read.schema(SEGMENT_DDL).parquet(folder)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = segments.join(shards.select("shard", before.alias("before")), "shard").select("shard", "segment", (F.col("before") + F.col("first")).alias("start"), "n_ids")
    stretch = lambda x: F.floor(x / SEGMENT_IDS)
    places = placed.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_ids") - 1))))
    asked = positions.select(F.col("position").cast("long")).where("position >= 0").distinct().withColumn("stretch", stretch(F.col("position")))
    met = asked.join(places, "stretch").where("position >= start and position < start + n_ids")
    wanted = met.groupBy("shard", "segment", "start").agg(F.collect_list("position").alias("positions"))  # as many as a segment has ids, at most
    levels, keys = segments.select("shard", "segment", "levels"), met.select("shard", "segment").distinct().limit(FEW + 1).collect()
    if len(keys) <= FEW:  # the scan then leaves out the row groups and pages of all others
        levels = levels.where(F.col("shard").isin({k.shard for k in keys}) & F.col("segment").isin({k.segment for k in keys}))
    return wanted.join(levels, ["shard", "segment"]).select("start", "positions", "levels").mapInArrow(_pick, "position bigint, id bigint")


def encode_and_read(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end_id: int = 1) -> DataFrame:
    """Writes the token files to a new folder beside the checkpoints and reads them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    write_token_files(docs, folder, tokenizer, keeps_space, end_id)
    return read_documents(spark, folder)
