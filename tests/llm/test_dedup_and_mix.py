import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from behaviorlens.llm import exact, lines, mixing, queries, sketch
from behaviorlens.llm.common import Scratch

SPACE = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, i int, h1 string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1, "clash") for d, t in rows], SCHEMA)


LONG = "abcdefgh ijklmnop " * 40
ROWS = [(5, "a b"), (3, "ab"), (9, "a  b"), (2, None), (4, ""), (8, " \t\n"), (None, "ab"), (7, "unique"), (7, "unique"), (6, LONG), (1, LONG.replace(" ", "")), (10, LONG + "x"), (11, "x" + LONG), (12, "é" * 70), (13, "é " * 70)]


@pytest.mark.parametrize("block, bits", [(4096, None), (16, None), (7, None), (16, 3)])
def test_exact_groups_equal_brute_force(spark, block, bits):
    from behaviorlens.llm.common import hash_pair

    calls = []

    def weak(seed, x):
        """A digest that collides until it is drawn anew."""
        calls.append(seed)
        return [h if seed >= 2 else F.pmod(h, F.lit(1 << bits)) for h in hash_pair(seed, x)]

    docs = table(spark, ROWS)
    got = exact.exact_groups(docs, block_bytes=block, **({"digest": weak} if bits else {})).collect()
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d))
    want = Counter()
    for d, t in ROWS:
        key = SPACE.sub("", t or "")
        want[d, min(groups[key])[2], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert not bits or max(calls) >= 1
    left = exact.drop_exact_copies(docs, block_bytes=block)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_lines_equal_brute_force(spark):
    rows = [(1, "Common line\nown\ncommon line  \nx\n"), (2, " COMMON LINE\nÉtude"), (3, "étude\ncommon line"), (4, None), (5, ""), (None, "common line\n\nz"), (6, "solo"), (7, "\n".join(f"l{i}" for i in range(200)) + "\ncommon line"), (8, "x\nx\nx"), (9, "x\n\n\n")]
    docs = table(spark, rows + [rows[0]])
    strip, fold = " \t\n\x0b\x0c\r", str.maketrans(lines.ascii_lower.__globals__["UPPER"], lines.ascii_lower.__globals__["LOWER"])
    key = lambda x: x.strip(strip).translate(fold)
    seen = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                seen[key(x)].add((d, t))
    hot = {k for k, v in seen.items() if len(v) >= 3}
    assert {"common line", "x"} <= hot
    got = lines.drop_frequent_lines(docs, min_docs=3)
    for r in got.collect():
        text = next(t for d, t in rows if d == r.doc_id) or ""
        left = [x for x in text.split("\n") if key(x) not in hot]
        assert (r.n_lines, r.n_dropped, r.kept) == (len(text.split("\n")), len(text.split("\n")) - len(left), "\n".join(left))
        assert (r.keep is None) == (r.n_dropped == 0)
    far = [(20, "\n".join(f"u{i}" if i % 150 else "common line" for i in range(1000))), (21, "common line"), (22, "common line\n" * 64 + "own")]
    got2 = {r.doc_id: r for r in lines.drop_frequent_lines(table(spark, far), min_docs=3).collect()}
    assert got2[20].kept == "\n".join(f"u{i}" for i in range(1000) if i % 150) and len(got2[20].keep) == 7  # words, not lines
    assert got2[21].kept == "" and got2[22].kept == "own" and got2[22].n_dropped == 64
    assert got.count() == len(rows) + 1 and lines.drop_frequent_lines(docs.limit(0)).count() == 0
    assert lines.drop_frequent_lines(docs, min_docs=3, min_key_chars=2).where("doc_id = 8").first().n_dropped == 0


def pieces(text):
    return set(re.findall(r"[^\n]{256}[^\n ]*|[^\n]+", text))


def test_sketches_equal_sets(spark):
    rows = [(1, "one\ntwo\nthree\nfour"), (2, None), (3, ""), (4, "\n".join(f"line {i}" for i in range(300))), (5, "\n".join(f"line {i}" for i in range(5, 310))), (6, "one\ntwo\nthree\nfour"), (7, "word " * 400), (None, "no id"), (8, "é" * 1000)]
    got = {r.doc_id: r for r in sketch.compare_with_edits(table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (d, t) in enumerate(order):
        t, x = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + x[:n]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[d].near_edited == pytest.approx(like(pieces(t), pieces(edited))) and got[d].near_next == pytest.approx(like(pieces(t), pieces(x)))
        assert got[d].n_edits == len(pieces(t) ^ pieces(edited))
    assert got[1].fingerprint == got[6].fingerprint != got[5].fingerprint
    repeated = sketch.compare_with_edits(table(spark, [*rows, rows[0]]))
    assert repeated.count() == len(rows) + 1 and repeated.where("doc_id = 1").distinct().count() == 1
    assert sketch.compare_with_edits(table(spark, rows[:1])).first().near_next == 1.0
    assert sketch.compare_with_edits(table(spark, rows).limit(0)).count() == 0


def test_edited_texts_share_shingles(spark):
    rng = np.random.default_rng(0)
    sizes = [9, 12, 15, 20, 24, 30, 40, 48, 60, 96, 100, 150, 512, 800, 1100, 2000]
    words = [[f"w{x}" for x in rng.integers(0, 10**6, n)] for n in sizes]
    texts = [" ".join(x) for x in words] + ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 60))]
    docs = table(spark, list(enumerate(texts)))
    got = sketch.compare_with_edits(docs, digests=sketch.word_shingles).collect()
    assert len(got) == len(texts) and all(r.near_edited > 0.1 and r.near_edited > r.near_next for r in got), [(r.doc_id, r.near_edited, r.near_next) for r in got]
    late = spark.createDataFrame([(t, "inserted " + t) for t in texts], "a string, b string").select(sketch.word_shingles(F.col("a")).alias("a"), sketch.word_shingles(F.col("b")).alias("b")).collect()
    assert all(len(set(r.a) & set(r.b)) >= len(r.a) / 2 for r in late)
    assert spark.range(1).select(sketch.word_shingles(F.lit("")).alias("d")).first().d == []


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def twin_shingles(text, full=None):
    """The set of `word_shingles` below the bound of the text's length, one word at a time, and the bound."""
    hash_of = lambda values, seed=42: seed if not values else hash_of(values[1:], xxhash.xxh64_intdigest(struct.pack("<q", signed(values[0])), seed))
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in regex.findall(sketch.WORD.replace("\\x{20000}-\\x{3FFFF}", "\U00020000-\U0003FFFF"), text)]
    below = 1 << 20 if full is None or len(text) <= full else max(1, int(float(full << 20) / len(text)))
    out = set()
    for i in range(len(words)):
        rank = hash_of([words[i], words[i - 1]] if i else [words[i]])
        if rank >> 44 < below:
            key = rank >> 44 << 44 | hash_of(words[max(0, i - 3) : i + 1]) & 0xFFFFF << 24
            out.add(key | xxhash.xxh64_intdigest(struct.pack("<q", signed(key)), xxhash.xxh64_intdigest(struct.pack("<i", 9), 42)) & 0xFFFFFF)
    return out, below


def test_word_shingles_against_plain_python(spark):
    """The registered query's rows, odd ones included, as sets of Python make them."""
    rng = np.random.default_rng(4)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 300, n)) for n in (3, 40, 120, 900, 4000, 60_000)]
    rows = [(1, None), (2, ""), (3, " \n"), *enumerate(prose, 4), (20, prose[3]), (21, prose[3]), (None, "no id here"), (22, "é " * 300), (23, "漢字仮名" * 50), (24, "x" * 5000), (25, prose[4][:-40]), (26, prose[4])]
    got = {r.doc_id: r for r in sketch.compare_with_edits(table(spark, rows), digests=sketch.word_shingles, full=sketch.FULL).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))

    def like(x, y):
        (a, p), (b, q) = twin_shingles(x, sketch.FULL), twin_shingles(y, sketch.FULL)
        a, b = ({d for d in s if d >> 44 < min(p, q)} for s in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (d, t) in enumerate(order):
        t, x = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        assert got[d].peeled and got[d].near_edited == pytest.approx(like(t, edited)) and got[d].near_next == pytest.approx(like(t, x)), d
        assert int(got[d].fingerprint[:8], 16) == len(twin_shingles(t, sketch.FULL)[0])
    assert got[20].fingerprint == got[21].fingerprint


def test_likeness_has_no_jump_at_any_length(spark):
    rng = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in rng.integers(0, 3000, 2500))
    lengths = [(120, 140), (145, 155), (300, 310), (590, 610), (1190, 1210), (3190, 3210), (6300, 6380), (6380, 6420), (6420, 6460), (12000, 12040)]
    rows = [(2 * i + k, text[:n]) for i, pair in enumerate(lengths) for k, n in enumerate(pair)]
    got = {r.doc_id: r.near_next for r in sketch.compare_with_edits(table(spark, rows), digests=sketch.word_shingles, full=sketch.FULL).collect()}
    found = [got[2 * i + 1] for i in range(len(lengths))]  # of the longer one to the shorter one
    assert min(found[3:]) > 0.9 and min(found) > 0.6, found


def twin_pieces(text, below):
    """The set of `word_pieces` below a bound, as digests."""
    hash_of = lambda values, seed=42: seed if not values else hash_of(values[1:], xxhash.xxh64_intdigest(struct.pack("<q", signed(values[0])), seed))
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
    out, total = set(), 0
    for i in range(len(words)):
        rank = hash_of(words[i : max(0, i - 2) - len(words) - 1 : -1][:2]) >> 44
        total += hash_of(words[max(0, i - 3) : i + 1][::-1]) >> 24 & 0xFFFFF
        if rank < below or i + 1 == len(words):
            key = rank << 44 | (total & 0xFFFFF) << 24
            out.add(key | xxhash.xxh64_intdigest(struct.pack("<q", signed(key)), xxhash.xxh64_intdigest(struct.pack("<i", 9), 42)) & 0xFFFFFF)
            total = 0
    return out


def test_every_word_of_a_long_text_is_in_its_fingerprint(spark, tmp_path):
    """The registered query: no word of a long text can change, go or change places unseen, and likeness is that of whole sets of pieces."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 3000, 1500)]
    texts = [words] + [[*words[:i], "other", *words[i + 1 :]] for i in range(0, 1500, 37)] + [words[:700] + words[701:], [*words[:50], *words[54:58], *words[50:54], *words[58:]], words[:900], words[:30], ["same"] * 3000, ["same"] * 3001]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, None), (101, "")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, str(tmp_path)).collect()}
    assert len({got[i].fingerprint for i in range(len(texts))}) == len(texts)
    assert got[100].fingerprint == got[101].fingerprint
    bound = lambda t: 1 << 20 if len(t) <= sketch.FULL else int(float(sketch.FULL << 20) / len(t))
    order = sorted(rows, reverse=True)
    for k, (d, t) in enumerate(order):
        t, x = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        assert got[d].peeled and int(got[d].fingerprint[:8], 16) == len(twin_pieces(t, bound(t))), d
        for y, near in ((edited, got[d].near_edited), (x, got[d].near_next)):
            a, b = (twin_pieces(z, min(bound(t), bound(y))) for z in (t, y))
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0), d


def test_a_filter_on_the_result_is_a_filter_on_a_table(spark):
    docs = table(spark, [(i, f"some words of {i} and more {i * i}") for i in range(20)])
    found = sketch.compare_with_edits(docs, digests=sketch.word_shingles, full=sketch.FULL).where("near_edited < 0.5")
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line for line in plan if "Filter" in line] and not [line for line in plan if "Filter" in line and "transform" in line]


def test_peeling_recovers_digests(spark):
    a, b = "\n".join(f"p{i}" for i in range(40)), "\n".join(f"p{i}" for i in range(6, 43))
    row = spark.range(1).select(sketch.digests(F.lit(a)).alias("a"), sketch.digests(F.lit(b)).alias("b"))
    row = row.select("a", "b", F.array_sort("a").alias("c"))
    for size in (8, 32):
        places = sketch._cells(size)
        tables = [sketch.table(F.col(x), places) for x in "ab"]
        found = row.select("a", "b", sketch.peel(sketch.subtract(*tables), places).alias("d")).first()
        assert found.d.left or sorted(found.d.found) == sorted(set(found.a) ^ set(found.b))
    assert not found.d.left
    # The digests of all blocks are those of the set, each in one block.
    blocks = row.select("a", sketch.dealt(F.col("a"), sketch.blocks_of(F.col("a"))).alias("g")).first()
    assert len(blocks.g) == 8 and sorted(d for g in blocks.g for d in g if d) == sorted(blocks.a)


def test_work_is_in_proportion_to_the_pieces(spark):
    """Two wholly different texts of 20,000 lines each: every block has twice its load, and many are sketched again."""
    rows = [(1, "\n".join(f"x{i}" for i in range(20_000))), (2, "\n".join(f"y{i}" for i in range(20_000)))]
    got = sketch.compare_with_edits(table(spark, rows)).collect()
    assert [r.near_next for r in got] == [0.0, 0.0]
    for r in got:
        t, x = (rows[0][1], rows[1][1]) if r.doc_id == 1 else (rows[1][1], rows[0][1])
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        assert r.n_edits == len(pieces(t) ^ pieces(edited))


def test_raking_reaches_its_targets(spark):
    rows = [(s, g, t, float(n)) for k, s in enumerate("ABC") for j, g in enumerate(("en", "fr")) for i, t in enumerate(("short", "long")) for n in [10 + 97 * k + 31 * j * i + 7 * i]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    targets = {"source": {"A": 0.5, "B": 0.3, "C": 0.2}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"short": 0.25, "long": 0.75}}
    frames = {d: spark.createDataFrame(list(t.items()), "key string, share double") for d, t in targets.items()}
    scratch = Scratch(spark)
    raked, residual, rounds = mixing.rake(cells, frames, scratch)
    assert residual <= mixing.TOLERANCE and rounds < mixing.ROUNDS
    # The tables know their size, so the planner's estimate doesn't grow from round to round.
    assert len(str(raked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 9
    plain = {(r.source, r.lang, r.topic): r.rate for r in raked.collect()}
    mixing_small = mixing.SMALL
    try:
        mixing.SMALL = 0  # every step a table of its own
        other, _, n = mixing.rake(cells, frames, scratch)
        assert n == rounds and {(r.source, r.lang, r.topic): pytest.approx(r.rate) for r in other.collect()} == plain
    finally:
        mixing.SMALL = mixing_small
    wrong = {**frames, "lang": spark.createDataFrame([("en", 0.6), ("xx", 0.4)], "key string, share double")}
    assert mixing.rake(cells, wrong, scratch, rounds=2)[1] > 0.1
    total = sum(r[3] for r in rows)
    for d, target in targets.items():
        for r in raked.groupBy(d).agg(F.sum(F.col("tokens") * F.col("rate")).alias("w")).collect():
            assert r.w == pytest.approx(target[r[d]] * total, rel=1e-6)
    kept = mixing.calibrate(raked, 0.5).agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert kept == pytest.approx(0.5 * total, rel=1e-6)


def test_mix_of_odd_rows(spark):
    rows = [(i, "word " * (i % 7 + 1), None if i % 5 == 0 else "en", None if i % 3 == 0 else "hot") for i in range(600)] + [(None, None, None, None), (5, "again", "en", "hot")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, rate double")
    got = mixing.mix(docs, keep=0.5).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 and r.row.rate == 1.0 for r in got)
    tokens = sum(r.tokens for r in got)
    assert sum(r.tokens for r in got if r.selected) == pytest.approx(0.5 * tokens, rel=0.15)
    assert len({r.selected for r in got if r.row.doc_id == 5 and r.probability == 1}) <= 1
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000, "en", "s", "x")], "doc_id long, text string, lang string, source string, topic string")
    only = mixing.mix(long, keep=1.0).first()
    assert (only.tokens, only.topic, only.row.topic) == (300_000, "long", "x")
    assert {r.topic for r in mixing.mix(long, topic=lambda text, tokens: F.lit("any")).collect()} == {"any"}


def test_the_budget_is_met_or_the_gap_is_told(spark):
    # Twenty cells whose rates fill one after another, so that the budget takes many steps.
    cells = spark.createDataFrame([(f"s{k}", 100.0 * 1.5**k, 3.0 / 1.5**k) for k in range(20)], "source string, tokens double, rate double")
    total = sum(r.tokens for r in cells.collect())
    got = mixing.calibrate(cells, 0.97).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.97 * total) and abs(got[0].budget_gap) < 1e-9
    short = mixing.calibrate(cells.withColumn("rate", F.when(F.col("source") == "s19", 0.0).otherwise(F.col("rate"))), 0.97).collect()
    assert short[0].budget_gap == pytest.approx(1 - (total - 100.0 * 1.5**19) / (0.97 * total))
    assert mixing.calibrate(cells.limit(0)).count() == 0
