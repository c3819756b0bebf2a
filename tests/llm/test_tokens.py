import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from behaviorlens.llm import dac, packing
from behaviorlens.llm import tokens as T
from behaviorlens.llm.queries import vocabulary

TEXTS = [
    None, "", " ", "a  b", " a b ", "\n\nx y\n\n z", "tab\there you go", "x\x00y \x00 z", "<|endoftext|> a", "it's we'll 12345 a_b",
    "Σίσυφος ΣΑΣ á e ́x", "  x", "a\x1cb \x1c c", "x\n", "İstanbul DŽ ǅ", "a\r\nb", "THE!! End*** of,%%% it.", "one two\nThree four. five " * 40,
]


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("long, known", [(500_000, 1000), (30, 1000), (500_000, 2)])
def test_word_encoder_equals_library(name, keeps, long, known, monkeypatch):
    monkeypatch.setattr(T, "LONG", long)
    encoder = T.WordEncoder(vocabulary(name), keeps, known)
    for _ in range(2):
        got = list(encoder.encode(TEXTS))
        assert got == [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("long", [500_000, 30])
def test_added_tokens_have_the_ids_of_the_plain_call(name, keeps, long, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "LONG", long)
    plain = Tokenizer.from_file(vocabulary(name))
    texts = [
        "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", "<|ENDOFTEXT|> b", "a\n<|endoftext|>\n b  c", "one <|endoftext|> two " * 20,
        "<|endoftext|", "<|<|endoftext|>|>", " <|startoftext|> it's", None, "no token here",
    ]
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert plain.token_to_id("<|endoftext|>") in expected[0]
    assert [np.frombuffer(x, "<u4").tolist() for x in T.WordEncoder(vocabulary(name), keeps).encode(texts)] == expected


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.zeros(5), rng.integers(0, 50_000, 3000), rng.integers(0, 2**32, 1500), np.arange(250, 260)):
        ids = ids.astype(np.uint32)
        codes = dac.Codes(dac.encode_levels(ids))
        assert (codes.read(0, len(ids)) == ids).all()
        for i in rng.integers(0, max(1, len(ids)), 50) if len(ids) else ():
            assert codes[i] == ids[i]
            j = int(rng.integers(i, len(ids)))
            assert (codes.read(int(i), j) == ids[i:j]).all()


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(None if i == 3 else 7 * i % 19, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, start string, h int")


def reference(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    docs = rows(spark)
    dac.write_token_files(docs, str(tmp_path / "ids"), path, segment_ids=50)
    got = {r.doc_id: r for r in dac.read_documents(spark, str(tmp_path / "ids")).collect()}
    tokenizer, start = T.WordEncoder(path, False).tokenizer, 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = reference(tokenizer, r.text, 1)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert dac.encode_and_read(docs.limit(0), path).count() == 0
    twice = dac.encode_and_read(docs.where("doc_id = 7").union(docs.where("doc_id = 7")), path).collect()
    assert sorted(r.start for r in twice) == [0, twice[0].n_tokens]


def test_packing(spark):
    path = vocabulary("byte_bpe_50k.json")
    docs = rows(spark, [*TEXTS, "word and more words " * 2000])
    got = packing.pack(docs, path, max_tokens=64).toPandas()
    tokenizer = T.WordEncoder(path, True).tokenizer
    for r in docs.collect():
        ids = reference(tokenizer, r.text, 0)
        own = got[got.doc_id.isna() if r.doc_id is None else got.doc_id == r.doc_id].sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
        total = s.length.sum()
        assert total <= 64 and total & (total - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0
    repeated = packing.pack(docs.where("doc_id = 7").union(docs.where("doc_id = 7")), path)
    assert repeated.agg(F.sum("length")).first()[0] == 2 * repeated.first().doc_tokens


def test_assign_balances_cost():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 1024, 300)]
    pieces = packing.assign(lengths)
    assert sum(p[2] for p in pieces) == sum(lengths)
    cost, size = np.zeros(400), np.zeros(400)
    for _, _, n, to, _ in pieces:
        cost[to] += n + n * n / 512
        size[to] += n
    full = cost[size == 1024]
    assert len(full) == sum(lengths) // 1024 and full.std() < 0.4 * full.mean()


def test_any_token_is_read_without_its_neighbours(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, n))) for i, n in enumerate([0, 3, 400, 20, 700, 1])] + [(9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder, path = str(tmp_path / "ids"), vocabulary("word_bpe_49k.json")
    dac.write_token_files(docs, folder, path, end_id=1, segment_ids=256)
    plain = Tokenizer.from_file(path)
    ids = [x for _, t in rows for x in [*plain.encode(t or "", add_special_tokens=False).ids, 1]]
    asked = spark.createDataFrame([(0,), (1,), (1,), (255,), (256,), (len(ids) - 1,), (len(ids),), (-1,), (None,), (777,)], "position long")
    got = {r.position: r.id for r in dac.read_tokens(spark, folder, asked).collect()}
    assert got == {i: ids[i] for i in (0, 1, 255, 256, 777, len(ids) - 1)}
    assert dac.read_tokens(spark, folder, asked.limit(0)).count() == 0
    # One position: the scan of the levels names its segment and gives out no more than a few.
    found = dac.read_tokens(spark, folder, asked.where("position is not null").limit(1))
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(shard), IsNotNull(segment)" in plan and "EqualTo(shard," in plan.replace("In(shard, [", "EqualTo(shard,")


def test_a_worker_keeps_no_words_after_a_task(monkeypatch):
    import pyarrow as pa

    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words here", "and some more"]})
    for module, path, keeps_space, run in (
        (packing, vocabulary("byte_bpe_50k.json"), True, lambda: packing._pack(vocabulary("byte_bpe_50k.json"), True, 0, 1024, 100, 100_000)),
        (dac, vocabulary("word_bpe_49k.json"), False, lambda: dac._segments(vocabulary("word_bpe_49k.json"), False, 1, 1000)),
    ):
        monkeypatch.setattr(module, "TaskContext", Task)
        assert sum(b.num_rows for b in run()(iter([rows]))) > 0
        known = T.encoder(path, keeps_space)
        assert not known.bare and not known.spaced and known.bases == {"": {"": b""}, " ": {}}
