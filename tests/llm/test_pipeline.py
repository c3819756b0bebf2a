"""The five stages against plain Python, on planted rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from behaviorlens.llm import mixing, quality
from behaviorlens.llm.queries import vocabulary

from .test_neardup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, tokens string"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def fixture():
    rng = np.random.default_rng(0)
    vocabulary_ = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary_, n)) + "."
    rows = [(i, prose(int(rng.integers(30, 200)))) for i in range(60)]
    junk = [(100 + i, " ".join(x.upper() + "!!" for x in rng.choice(vocabulary_, 60))) for i in range(20)]
    exact = [(200 + i, rows[i][1].replace(" ", "  ")) for i in range(5)] + [rows[5], rows[5]]
    near = [(300 + i, rows[10 + i][1] + " one more") for i in range(5)]
    rows = rows + junk + exact + near + [(400, None), (401, ""), (None, rows[20][1] + " changed")]
    return [(d, t, "en" if k % 3 else None, "hot" if k % 4 else "cold", len(t or ""), "clash", 1, "clash") for k, (d, t) in enumerate(rows)]


def statistics(text):
    words, lines, n = text.strip(" \t\n\x0b\x0c\r").split(), text.split("\n"), len(text)
    words = words or [""]
    pairs = list(zip([None, *words[:-1]], words))
    share = lambda a, b=n: a / b if b else 0.0
    of = lambda pattern: share(len(re.findall(pattern, text)))
    return {
        "log_chars": np.log1p(n), "word_length": share(n, len(words)), "distinct_words": share(len(set(words)), len(words)), "distinct_pairs": share(len(set(pairs)), len(words)),
        "stutter": share(sum(a == b for a, b in pairs), len(words)), "distinct_lines": share(len(set(lines)), len(lines)), "upper": of("[A-Z]"), "marks": of(r"[*$%&#@^~<>{}=_\\]"),
        "shouts": of("!"), "bars": of(r"\|"), "digits": of("[0-9]"), "stops": of("[.,;:?]"), "wide": share(len(text.encode()) - n), "line_length": share(n, len(lines)),
    }


def rake(cells, targets):
    weight, total = dict(cells), sum(cells.values())
    for _ in range(200):
        for d, target in enumerate(targets):
            sums = defaultdict(float)
            for k, w in weight.items():
                sums[k[d]] += w
            weight = {k: w * target[k[d]] * total / sums[k[d]] for k, w in weight.items()}
    return {k: w / cells[k] for k, w in weight.items()}


def plain_mix(rows):
    import hashlib

    keyed = []
    for r in rows:
        text = r[1] or ""
        n = max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text)))
        keyed.append((r, (r[3] or mixing.NONE, r[2] or mixing.NONE, "table" if " | " in text else "short" if n < 100 else "medium" if n < 1000 else "long"), float(n)))
    cells = defaultdict(float)
    for _, k, n in keyed:
        cells[k] += n
    targets = []
    for d in range(3):
        sums = defaultdict(float)
        for k, n in cells.items():
            sums[k[d]] += n
        powers = {k: n**corpus_pipeline.TEMPERATURE for k, n in sums.items()}
        targets.append({k: p / sum(powers.values()) for k, p in powers.items()})
    rate, total = rake(cells, targets), sum(cells.values())
    c = corpus_pipeline.KEEP
    for _ in range(50):
        full = sum(n for k, n in cells.items() if rate[k] * c >= 1)
        rest = sum(n * rate[k] for k, n in cells.items() if rate[k] * c < 1)
        if not rest:
            break
        c = max(c, (corpus_pipeline.KEEP * total - full) / rest)
    dice = lambda d: int(hashlib.md5(f"{'null' if d is None else d}:0".encode()).hexdigest()[:12], 16) / 2**48
    return [r for r, k, _ in keyed if dice(r[0]) < min(1.0, rate[k] * c)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 0 if 100 <= r[0] < 200 else 1, 0) for r in rows if r[0] is not None and r[0] not in (400, 401)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_each_stage_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = [tuple(r) for r in docs.collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model, key = quality.fit(docs, labels), lambda r: (r[0] is None, r[0] or 0, r[1] or "")

    def stage(k):
        return sorted((tuple(r) for r in corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(now, SCHEMA), folder).collect()), key=key)

    def passes(text):
        s = statistics(text or "")
        total = model.intercept + sum(r.weight for r in model.rules if all((s[n] <= t) if low else (s[n] > t) for n, low, t in r.conditions))
        return 1 / (1 + np.exp(-total)) >= quality.THRESHOLD

    want = sorted((r for r in now if passes(r[1])), key=key)
    assert 0 < len(want) < len(now) and not any(100 <= (r[0] or 0) < 200 for r in want)
    assert stage(0) == want
    now, groups = want, defaultdict(list)
    for r in now:
        groups[SPACE.sub("", r[1] or "")].append(r)
    want = sorted((min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0])) for g in groups.values()), key=key)
    assert len(want) < len(now)
    assert stage(1) == want
    now = want
    ids = brute([(r[0], r[1]) for r in now])
    want, seen = [], set()
    for r, (_, n, component) in sorted(zip(now, ids), key=lambda x: key(x[0])):
        if not n or component not in seen:
            want.append(r)
            seen |= {component} if n else set()
    assert len(want) < len(now)
    assert stage(2) == want
    now = want
    want = plain_mix(now)
    assert 0 < len(want) < len(now)
    assert stage(3) == sorted(want, key=key)
    now = want
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces, rooms = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(now, SCHEMA), folder).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        rooms[r.sequence_id] += r.length
    assert set(pieces) == {r[0] for r in now} and all(n == 1024 or n & (n - 1) == 0 for n in rooms.values())
    for r in now:
        ids, at = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for start, length, crc, n in sorted(pieces[r[0]]):
            assert (start, n, crc) == (at, len(ids), zlib.crc32(ids[start : start + length].tobytes()))
            at += length
        assert at == len(ids)


def test_run_chains_the_stages_and_takes_an_empty_table(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids and not any(100 <= (d or 0) < 200 for d in ids) and len(ids & {0, 200}) <= 1
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, folder).columns == empty.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0
