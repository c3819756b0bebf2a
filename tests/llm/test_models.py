import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import langid, quality

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@needs_data
def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.95 and held.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (3, "THIS!! IS!! LOUD!! " * 50, "d"), (3, "THIS!! IS!! LOUD!! " * 50, "d")], "doc_id long, text string, log_chars string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, one.select("doc_id", F.col("quality").alias("label"))).rules == ()
    scored = quality.score(docs, quality.RuleEnsemble(0.0, (quality.Rule(-3.0, (("shouts", False, 0.01),)),)))
    assert {r.row.doc_id: r.score < 0.3 for r in scored.collect()} == {1: False, 2: False, None: False, 3: True}
    assert quality.classify(docs.limit(0), none).count() == 0


@needs_data
def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.97


def test_language_edges(spark):
    rows = [(i, "the quick brown fox and the lazy dog", "en") for i in range(6)] + [(i + 6, "der schnelle braune fuchs und der faule hund", "de") for i in range(6)]
    docs = spark.createDataFrame([*rows, (20, None, None), (21, "123 !?", "en"), (22, "", "de"), (23, "ЖЖЖЖ", None), (None, "the dog", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("lang", "text"))
    assert model.languages == ("de", "en")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[20] == got[21] == got[22] == ("und", 0.0) and got[None][0] == "en" and got[0][0] == "en" and got[8][0] == "de"
    assert got[23][0] in ("de", "en") and got[23][1] <= 1
    gram = langid.grams("the quick")
    assert (model.containing(gram) & 2 == 2).all()
    empty = langid.fit(docs.limit(0).select("lang", "text"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_languages_with_more_ngrams_than_the_broadcast_filter_holds(spark):
    rng = np.random.default_rng(0)
    letters = {"a": [chr(c) for c in range(0x4E00, 0x5200)], "b": [chr(c) for c in range(0x4F00, 0x5300)], "c": [chr(c) for c in range(0x20000, 0x20400)]}
    rows = [(i, "".join(rng.choice(letters[x], 400)), x) for i, x in enumerate("abc" * 20)]
    rows += [(i + 100, text, None) for i, text, _ in rows[:30]] + [(200, None, None), (200, "12 !", None), (None, rows[1][1], None), (201, rows[1][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.fit(docs.select("lang", "text"))
    blocks = langid.fit(docs.select("lang", "text"), max_bits=10)
    assert isinstance(blocks, langid.BlockFilters) and (blocks.false_positives < 0.05).all()
    want = sorted(map(str, [(r.doc_id, r.lang_pred) for r in langid.predict(docs, whole).collect()]))
    got = langid.predict(docs, blocks).collect()
    assert sorted(map(str, [(r.doc_id, r.lang_pred) for r in got])) == want
    truth = {i: x for i, _, x in rows[:60]}
    assert all(r.lang_pred == truth[r.doc_id] and r.score > 0.8 for r in got if r.doc_id in truth)


def test_seventy_languages_take_two_words(spark):
    names = [f"l{k:02}" for k in range(70)]
    rows = [(i, f"{''.join(chr(97 + (k * 7 + j * (k + 3) + i) % 23) for j in range(40))} {chr(0x400 + k)}{chr(0x430 + k % 30)}{chr(0x4E00 + k)}" * 3, n) for k, n in enumerate(names) for i in range(k * 10, k * 10 + 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bits in (langid.MAX_BITS, 10):
        model = langid.fit(docs.select("lang", "text"), max_bits=bits)
        assert isinstance(model, langid.BlockFilters) == (bits == 10) and len(model.languages) == 70
        got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
        assert sum(got[i] == n for i, _, n in rows) >= 0.98 * len(rows)


def test_full_filters_say_nothing_and_symbols_are_no_letters():
    full = langid.LanguageFilters(("a", "b"), "b", np.full((1024, 1), 3, np.int64))
    assert full.decide("some text", full.false_positives()) == ("b", 0.0)
    half = langid.LanguageFilters(("a", "b"), "b", np.where(np.arange(1024) < 512, 3, 1)[:, None])
    assert half.decide("some text with words", half.false_positives())[0] == "b"
    assert len(langid.grams("\U0001F600\U0001F601")) == 0 and len(langid.grams("\U00020000\U00020001")) == 2


def test_long_texts_have_the_same_ngrams_in_parts(monkeypatch):
    text = "Straße, und der  Fuchs-Bau! 12 " * 20
    whole = langid.grams(text)
    for part in (1, 7, 64):
        monkeypatch.setattr(langid, "PART", part)
        assert np.array_equal(np.concatenate(list(langid._parts(text))), whole)


def test_exact_sets_agree_with_the_filters(spark):
    """A twin with a set of n-grams for each language instead of bits."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh" if i % 2 else "efghijkl"), 5)) for _ in range(12)), "xy"[i % 2], "clash") for i in range(60)]
    rows += [(100, rows[0][1], None, "clash"), (100, rows[0][1], None, "clash"), (101, "\U0001F600\U0001F601", "x", ""), (102, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    counts = {}
    for _, text, lang, _ in rows:
        for g in langid.grams(text or "") if lang else ():
            counts[int(g), lang] = counts.get((int(g), lang), 0) + 1
    totals = {x: sum(n for (_, y), n in counts.items() if x == y) for x in "xy"}
    high = {}
    for (g, x), n in counts.items():
        high[g] = max(high.get(g, 0), n / totals[x])
    has = {x: {g for (g, y), n in counts.items() if x == y and n / totals[x] >= langid.SHARE * high[g]} for x in "xy"}
    for r in langid.predict(docs, langid.fit(docs.select("lang", "text"))).collect():
        found = langid.grams(next(t for d, t, *_ in rows if d == r.doc_id) or "")
        hits = {x: sum(int(g) in has[x] for g in found) for x in "xy"}
        if not len(found):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif hits["x"] != hits["y"]:
            assert r.lang_pred == max(hits, key=hits.get) and abs(r.score - max(hits.values()) / sum(hits.values())) < 0.02


def test_rules_agree_with_plain_python(spark):
    """The compiled column against the same statistics and rules one text at a time."""
    texts = ["Plain words in a line. And more words here.", "LOUD!! LOUD!! LOUD!!", "a a b b c c d d", "x | y | z |\nx | y | z |", "", "one", "é ü 12% & more\n\n", "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = docs.select("text", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).collect()
    for r in stats:
        words, lines = r.text.strip(" \t\n\x0b\x0c\r").split(), r.text.split("\n")
        words = words or [""]
        n = len(r.text)
        pairs = list(zip([None, *words[:-1]], words))
        assert r.stutter == pytest.approx(sum(a == b for a, b in pairs) / len(words)) and r.distinct_words == pytest.approx(len(set(words)) / len(words))
        assert r.distinct_pairs == pytest.approx(len(set(pairs)) / len(words)) and r.distinct_lines == pytest.approx(len(set(lines)) / len(lines))
        assert r.shouts == pytest.approx(r.text.count("!") / n if n else 0) and r.bars == pytest.approx(r.text.count("|") / n if n else 0)
    rules = (quality.Rule(1.5, (("stutter", True, 0.2), ("shouts", True, 0.01))), quality.Rule(-2.0, (("bars", False, 0.05),)), quality.Rule(-0.5, (("distinct_words", True, 0.5),)))
    got = {r.row.doc_id: r.score for r in quality.score(docs, quality.RuleEnsemble(0.25, rules)).collect()}
    for i, r in zip(range(len(texts)), sorted(stats, key=lambda r: texts.index(r.text))):
        total = 0.25 + sum(rule.weight for rule in rules if all((r[s] <= t) if low else (r[s] > t) for s, low, t in rule.conditions))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)))
