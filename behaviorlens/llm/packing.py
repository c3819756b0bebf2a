"""Packing token ids into sequences with balanced attention cost.

The cost of a sequence is estimated as linear in its tokens plus quadratic in each piece, as
attention doesn't cross documents. Whole sequences are cut off each document first. What is left
of the documents of a bounded buffer is assigned in descending order, each to the sequence of
lowest cost that has room for it; where none has, it is cut to fill the room of the cheapest ones.
The buffer's sequences have together as many places as it has tokens: those that don't fill a
sequence go into sequences of a power of two, so no padding is left.

Each task packs the rows of its own partition, in order: nothing is shuffled, a task holds one
buffer at a time, and a task that is run again returns the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorlens.llm.tokens import encoder

MAX_TOKENS = 1024
#: Documents, and tokens, whose rests are packed together.
BUFFER_DOCS, BUFFER_TOKENS = 4096, 1 << 22
#: Cost of a token, and of a pair of tokens in one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 512

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECES = pa.schema([(n, pa.int64()) for n in NAMES])
PIECES_DDL = ", ".join(f"{n} bigint" for n in NAMES)


def capacities(total: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Room for exactly `total` tokens: full sequences, then falling powers of two."""
    full, rest = divmod(total, max_tokens)
    return [max_tokens] * full + [1 << b for b in range(max_tokens.bit_length(), -1, -1) if rest >> b & 1]


def assign(lengths: list[int], max_tokens: int = MAX_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) pieces of items of fewer than `max_tokens` tokens each.

    Equal lengths keep their order and equal costs take the first sequence, so the result is fixed.
    """
    room = np.array(capacities(sum(lengths), max_tokens), np.int64)
    size, cost, pieces = room.copy(), np.zeros(len(room)), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[item]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            to = int(fits.argmin())
            if fits[to] == np.inf:
                to = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[to]))
            pieces.append((item, start, n, to, int(size[to] - room[to])))
            room[to] -= n
            cost[to] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return pieces


def _pack(path: str, keeps_space: bool, end_id: int, max_tokens: int, buffer_docs: int, buffer_tokens: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = encoder(path, keeps_space), TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        held: list[tuple[int | None, int, bytes, int]] = []  # doc_id, tokens cut off, the rest, doc_tokens
        tokens = 0

        def piece(doc_id, start, ids, doc_tokens, seq, offset):
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, seq, offset))

        def flush():
            nonlocal sequence, tokens
            for item, start, n, to, offset in assign([len(x[2]) // 4 for x in held], max_tokens):
                doc_id, before, ids, doc_tokens = held[item]
                piece(doc_id, before + start, ids[4 * start : 4 * (start + n)], doc_tokens, sequence + to, offset)
            sequence += len(capacities(sum(len(x[2]) for x in held) // 4, max_tokens))
            held.clear()
            tokens = 0

        def drain() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(NAMES), schema=PIECES)
            out.clear()
            return batch

        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    whole = n - n % max_tokens
                    for start in range(0, whole, max_tokens):
                        piece(doc_id, start, ids[4 * start : 4 * (start + max_tokens)], n, sequence, 0)
                        sequence += 1
                    if n > whole:
                        held.append((doc_id, whole, ids[4 * whole :], n))
                        tokens += n - whole
                    if len(held) >= buffer_docs or tokens >= buffer_tokens:
                        flush()
                    if len(out) >= 10_000:
                        yield drain()
            flush()
            yield drain()
        finally:
            words.forget()

    return run


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = True, end_id: int = 0, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", buffer_docs: int = BUFFER_DOCS, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and then `end_id`; a null or empty text has that id alone.
    Every id lies in exactly one piece, and the offsets of a sequence have no gaps. A sequence has
    `max_tokens` tokens or a power of two of them. Repeated rows and null ids are documents of
    their own; an empty table gives no rows; other columns are ignored. The costs of sequences are
    balanced among the rests of `buffer_docs` documents or `buffer_tokens` tokens, whichever come
    first; a larger buffer balances better and takes more memory in the task. `max_tokens` is a power of two.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, keeps_space, end_id, max_tokens, buffer_docs, buffer_tokens), PIECES_DDL)
