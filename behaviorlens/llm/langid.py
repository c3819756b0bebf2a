"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of words holds the Bloom filters of all languages: bit l of a place belongs to the filter
of language l; a place has as many words as all languages need, WORD_BITS of them in each. The bitwise AND of the words at an n-gram's positions is the set of all languages
that contain the n-gram. Each language is given the count of its bits over the n-grams of a text,
corrected for its filter's rate of false positives, and the highest count decides.

The n-grams are counted over all training rows. A language contains an n-gram when it uses it at
no less than `share` of the rate of the language that uses it most, so words borrowed from another
language don't fill the filters.

The words follow the number of n-grams. Up to 2**`max_bits` words the filter is one table, and that
is what reaches the driver. A larger one stays a DataFrame of blocks: an n-gram's hash names its
block and its places in it, and the n-grams of the texts are joined to the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch, cut, hash_pair, text_of

N, HASHES, SHARE = 3, 3, 0.2
#: Log2 of the words of a filter that is broadcast, at most; words per n-gram at least.
MAX_BITS, SPARSE = 22, 16
#: Log2 of the words of a block of a filter that isn't broadcast.
BLOCK_BITS = 10
#: Languages of one word.
WORD_BITS = 62
#: N-grams that are looked at together, and n-grams that a task counts before it hands them on.
PART, HELD = 1 << 20, 1 << 20

_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
COUNTS_DDL = "lang string, gram bigint, n bigint"


def _folded(text: str) -> np.ndarray:
    """The code points of a text, lower-cased; a run of anything but letters is one blank, also at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter
    if not letter.any():
        return np.zeros(0, np.uint64)
    return np.concatenate((np.full(1, 32, np.uint64), np.where(letter, codes, 32)[keep].astype(np.uint64)))


def grams(text: str, n: int = N) -> np.ndarray:
    """Hashes of the n-grams of letters, lower-cased; runs of anything else are one blank."""
    return _hashed(_folded(text), n)


def _hashed(codes: np.ndarray, n: int = N) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x1F_FFFF_FFFF_FFE1) + codes[k : k + len(out)]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _parts(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, PART of them at a time: the parts of the folded text overlap by N - 1."""
    codes = _folded(text)
    for i in range(0, max(1, len(codes) - N + 1), PART):
        yield _hashed(codes[i : i + PART + N - 1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(held):
        for lang, parts in held.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _parts(text or ""):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
    yield from rows(held)


def positions(gram: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((gram >> np.uint64(21 * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def choose(languages: tuple[str, ...], fallback: str | None, total: int, hits: np.ndarray, false_positives: np.ndarray) -> tuple[str, float]:
    """The language of the highest count; one whose filter is full says nothing and counts as 0."""
    if not total:
        return "und", 0.0
    told = false_positives < 1
    hits = np.where(told, np.maximum(0.0, (hits - total * false_positives) / np.where(told, 1 - false_positives, 1.0)), 0.0)
    if not len(hits) or not hits.sum():
        return fallback or "und", 0.0
    best = int(hits.argmax())
    return languages[best], float(hits[best] / hits.sum())


def _words_for(languages: int) -> int:
    return max(1, -(-languages // WORD_BITS))


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    """Which of the masks, a row of words each, have a language."""
    return (masks[:, language // WORD_BITS] >> (language % WORD_BITS)) & 1


@dataclass(frozen=True)
class BlockFilters:
    """Filters as rows (block, words) of 2**BLOCK_BITS places each; blocks without n-grams have no row."""

    languages: tuple[str, ...]
    fallback: str | None
    blocks: DataFrame
    n_blocks: int
    false_positives: np.ndarray


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    fallback: str | None
    words: np.ndarray

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """The masks of all languages that contain each n-gram, with the filters' false positives."""
        bits, out = int(len(self.words)).bit_length() - 1, None
        for at in positions(gram, bits):
            out = self.words[at] if out is None else out & self.words[at]
        return out

    def false_positives(self) -> np.ndarray:
        return np.array([np.count_nonzero(_bit(self.words, l)) / len(self.words) for l in range(len(self.languages))]) ** HASHES

    def decide(self, text: str | None, false_positives: np.ndarray) -> tuple[str, float]:
        total, hits = 0, np.zeros(len(self.languages))
        for gram in _parts(text or ""):
            if not len(gram):
                continue
            masks = self.containing(gram)
            total += len(gram)
            hits += [np.count_nonzero(_bit(masks, l)) for l in range(len(self.languages))]
        return choose(self.languages, self.fallback, total, hits, false_positives)


def fit(rows: DataFrame, share: float = SHARE, max_bits: int = MAX_BITS) -> LanguageFilters | BlockFilters:
    """Filters from rows (lang, text); rows without a language are left out.

    Without rows there are no languages, and every text with a letter is `und`.
    """
    rows = rows.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = cut(rows.mapInArrow(_count, COUNTS_DDL).groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # as many as languages
    if not totals:
        return LanguageFilters((), None, np.zeros((1, 1), np.int64))
    languages = tuple(sorted(totals))
    n_words = _words_for(len(languages))
    facts = F.create_map(*[F.lit(x) if isinstance(x, str) else x for i, lang in enumerate(languages) for x in (lang, F.struct(F.lit(float(totals[lang])).alias("total"), F.lit(i).alias("l")))])
    known = counts.withColumn("of", facts[F.col("lang")])
    rates = known.groupBy("gram").agg(F.collect_list(F.struct((F.col("n") / F.col("of.total")).alias("rate"), F.col("of.l").alias("l"))).alias("of"))
    rates = rates.withColumn("high", F.array_max(F.transform("of", lambda x: x["rate"])))

    def word(k: int) -> Column:
        own = F.filter("of", lambda x: (x["rate"] >= share * F.col("high")) & (F.floor(x["l"] / WORD_BITS) == k))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["l"] - k * WORD_BITS)))

    names = [f"m{k}" for k in range(n_words)]
    masks = cut(rates.select("gram", *[word(k).alias(n) for k, n in enumerate(names)]))
    n_grams, fallback = masks.count(), max(languages, key=lambda x: (totals[x], x))
    bits = max(10, (SPARSE * n_grams).bit_length())
    if n_words << bits > 1 << max_bits:
        return _fit_blocks(masks, languages, fallback, -(-SPARSE * n_grams >> BLOCK_BITS))
    low = F.lit((1 << bits) - 1).cast("long")
    at = F.explode(F.array(*[F.shiftrightunsigned("gram", 21 * k).bitwiseAND(low) for k in range(HASHES)]))
    filled = masks.select(at.alias("at"), *names).groupBy("at").agg(*[F.bit_or(n).alias(n) for n in names]).toPandas()
    words = np.zeros((1 << bits, n_words), np.int64)
    words[filled["at"].to_numpy(np.int64)] = filled[names].to_numpy(np.int64)
    return LanguageFilters(languages, fallback, words)


def _block(n_blocks: int):
    return F.pmod(F.xxhash64("gram"), F.lit(n_blocks).cast("long"))


def _fill(n_languages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, None

        def drain():
            share = [np.count_nonzero(_bit(words, l)) / len(words) for l in range(n_languages)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([words.ravel()], pa.list_(pa.int64())), pa.array([share], pa.list_(pa.float64()))], ["block", "words", "share"])

        for batch in batches:
            block, gram, *mask = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            mask = np.stack(mask, axis=1)
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            for i, j in zip(starts, [*starts[1:], len(block)]):
                if at != block[i]:
                    if at is not None:
                        yield drain()
                    at, words = int(block[i]), np.zeros((1 << BLOCK_BITS, mask.shape[1]), np.int64)
                for p in positions(gram[i:j].astype(np.int64).view(np.uint64), BLOCK_BITS):
                    np.bitwise_or.at(words, p, mask[i:j])
        if at is not None:
            yield drain()

    return run


def _fit_blocks(masks: DataFrame, languages: tuple[str, ...], fallback: str, n_blocks: int) -> BlockFilters:
    rows = masks.select(_block(n_blocks).alias("block"), *masks.columns).repartition("block").sortWithinPartitions("block")
    blocks = cut(rows.mapInArrow(_fill(len(languages)), "block bigint, words array<bigint>, share array<double>"))
    rates = blocks.agg(*[F.sum(F.pow(F.col("share")[l], HASHES)).alias(f"l{l}") for l in range(len(languages))]).first()
    return BlockFilters(languages, fallback, blocks.select("block", "words"), n_blocks, np.array(rates) / n_blocks)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rate = model.false_positives()
        for batch in batches:
            found = [model.decide(t, rate) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["r1", "r2", "gram", "n"]
    for batch in batches:
        for r1, r2, text in zip(*(c.to_pylist() for c in batch.columns)):
            for part in _parts(text):
                values, counts = np.unique(part, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), r1)), pa.array(np.full(len(values), r2)), pa.array(values.view(np.int64)), pa.array(counts)], names)


def _choose_all(languages: tuple[str, ...], fallback: str | None, rate: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2, total, hits = batch.columns
            found = [choose(languages, fallback, t, np.array(h, float), rate) for t, h in zip(total.to_pylist(), hits.to_pylist())]
            yield pa.RecordBatch.from_arrays([r1, r2, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["r1", "r2", "lang_pred", "score"])

    return run


def _predict_by_blocks(rows: DataFrame, model: BlockFilters) -> DataFrame:
    """Texts are known by a hash of 128 bits. The rows of a repeated text multiply all its counts alike."""
    keyed = rows.select("doc_id", *[h.alias(x) for h, x in zip(hash_pair(8, text_of("text")), ("r1", "r2"))], text_of("text").alias("text"))
    grams = keyed.select("r1", "r2", "text").mapInArrow(_text_grams, "r1 bigint, r2 bigint, gram bigint, n bigint")
    met = grams.withColumn("block", _block(model.n_blocks)).join(model.blocks, "block", "left")
    n_words = _words_for(len(model.languages))

    def mask(k: int) -> Column:
        places = [F.shiftrightunsigned("gram", 21 * h).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int") for h in range(HASHES)]
        words = [F.get("words", p * n_words + k) for p in places]
        return F.coalesce(words[0].bitwiseAND(words[1]).bitwiseAND(words[2]), F.lit(0).cast("long"))

    each = [F.sum(F.col("n") * F.shiftright(f"m{l // WORD_BITS}", l % WORD_BITS).bitwiseAND(F.lit(1).cast("long"))) for l in range(len(model.languages))]
    counted = met.select("r1", "r2", "n", *[mask(k).alias(f"m{k}") for k in range(n_words)]).groupBy("r1", "r2").agg(F.sum("n").alias("total"), F.array(*each).alias("hits"))
    found = counted.mapInArrow(_choose_all(model.languages, model.fallback, model.false_positives), "r1 bigint, r2 bigint, lang_pred string, score double")
    out = keyed.select("doc_id", "r1", "r2").join(found, ["r1", "r2"], "left")
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def predict(docs: DataFrame, model: LanguageFilters | BlockFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    Null, empty and letterless texts are `und` with score 0; a text none of whose n-grams is known
    has the most frequent language, also with score 0; of equal counts the first language in
    alphabetical order wins. Repeated rows are decided alike; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(model, BlockFilters):
        return _predict_by_blocks(rows, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**max_bits words
    return rows.mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned only from rows that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = fit(docs.where(F.coalesce(fold != held, F.lit(False))).select("lang", "text"))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
