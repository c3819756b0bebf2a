"""One query per operator, over the whole of its table, and its SQL twin where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm import chat, codes, dac, exact, langid, lines, mixing, neardup, packing, quality, simhash, sketch, trie
from behaviorlens.llm.common import read


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {}
ORACLES = {}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op1_quality"] = op1_quality


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], turns.schema)
    return chat.read_conversations(chat.format_conversations(turns.union(extra)))


QUERIES["op2_chat_format"] = op2_chat_format
ORACLES["op2_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
f AS (
  -- A turn has its header, the text and, where it conflicts with the grammar, its escapes.
  SELECT *, length(CASE role WHEN 'assistant' THEN '[OUT][/OUT]' ELSE '[INST][/INST]' END) + length(role) + 1
            + length(CASE WHEN contains(text, '\') THEN regexp_replace(text, '[\\<\[\n]', '..', 'g')
                          ELSE regexp_replace(text, '(<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|\[/OUT\])', '.\1', 'g') END) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + 7)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_frequent_lines(read(spark, sf_dir, "documents"), min_docs=10, min_key_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES["op3_line_dedup"] = op3_line_dedup
ORACLES["op3_line_dedup"] = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM s),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY doc_id
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents")).drop("n_chars")


QUERIES["op4_exact_dedup"] = op4_exact_dedup
ORACLES["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).drop("r1", "r2")


QUERIES["op5_minhash"] = op5_minhash


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_edits(read(spark, sf_dir, "documents"), digests=sketch.word_pieces, full=sketch.FULL, pieces=True)


QUERIES["op6_fingerprints"] = op6_fingerprints


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


QUERIES["op7_language_id"] = op7_language_id


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = mixing.mix(docs, keep=mixing.KEEP, temperature=mixing.TEMPERATURE, seed=0)
    return found.select(
        "row.doc_id", "source", "lang", "topic", F.col("tokens").cast("long").alias("n_tokens"), F.round("rate", 6).alias("rate"), F.round("probability", 6).alias("probability"), "selected"
    )


#: Rounds of raking, and steps towards the budget, that the SQL unrolls; the query stops where nothing changes any more.
SQL_ROUNDS, SQL_STEPS = 24, 12


def _mixing_sql() -> str:
    """The same raking unrolled: a factor table for each step, then the steps towards the budget."""
    dims, power = mixing.DIMENSIONS, mixing.TEMPERATURE
    parts = [
        """d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::DOUBLE AS tokens
  FROM documents
)""",
        "t AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN tokens < 100 THEN 'short' WHEN tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM d)",
        "cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM t GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS n FROM cells)",
    ]
    factor = {}
    for d in dims:
        parts.append(f"p_{d} AS (SELECT {d}, pow(sum(tokens), {power}::DOUBLE) AS p FROM cells GROUP BY {d})")
        parts.append(f"s_{d} AS MATERIALIZED (SELECT {d}, p / (SELECT sum(p) FROM p_{d}) AS share FROM p_{d})")
        parts.append(f"f_{d}_0 AS (SELECT {d}, 1.0::DOUBLE AS f FROM s_{d})")
        factor[d] = f"f_{d}_0"
    for k in range(1, SQL_ROUNDS + 1):
        for d in dims:
            a, b = (o for o in dims if o != d)
            parts.append(
                f"f_{d}_{k} AS MATERIALIZED (SELECT c.{d}, any_value(s.share) * (SELECT n FROM total) / sum(c.tokens * x.f * y.f) AS f FROM cells c "
                f"JOIN {factor[a]} x ON x.{a} = c.{a} JOIN {factor[b]} y ON y.{b} = c.{b} JOIN s_{d} s ON s.{d} = c.{d} GROUP BY c.{d})"
            )
            factor[d] = f"f_{d}_{k}"
    joins = " ".join(f"JOIN {factor[d]} r_{d} ON r_{d}.{d} = c.{d}" for d in dims)
    parts.append(f"raked AS MATERIALIZED (SELECT c.*, {' * '.join(f'r_{d}.f' for d in dims)} AS rate FROM cells c {joins})")
    parts.append(f"c_0 AS (SELECT {mixing.KEEP}::DOUBLE AS c)")
    for k in range(1, SQL_STEPS + 1):
        parts.append(
            f"c_{k} AS MATERIALIZED (SELECT greatest(any_value(c), ({mixing.KEEP}::DOUBLE * (SELECT n FROM total) - coalesce(sum(tokens) FILTER (WHERE rate * c >= 1), 0)) "
            f"/ nullif(sum(tokens * rate) FILTER (WHERE rate * c < 1), 0)) AS c FROM raked, c_{k - 1})"
        )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, t.source, t.lang, t.topic, t.tokens::BIGINT AS n_tokens, round(rate, 6) AS rate, round(least(1.0, rate * c), 6) AS probability,
       ('0x' || substr(md5(doc_id::VARCHAR || ':0'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < least(1.0, rate * c) AS selected
FROM t JOIN raked USING (source, lang, topic), c_{SQL_STEPS}
"""
    )


QUERIES["op8_mixing"] = op8_mixing
ORACLES["op8_mixing"] = _mixing_sql()


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.encode_and_read(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keeps_space=False, end_id=1)


QUERIES["op9_token_ids"] = op9_token_ids


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keeps_space=True, end_id=0, max_tokens=1024)


QUERIES["op10_packing"] = op10_packing


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """All distances in each round; a distance and an index in one number, so that ties go to the lower index."""
    near = "SELECT v.vec_id, v.part, min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.entry) AS best FROM v JOIN {c} c ON c.part = v.part GROUP BY ALL"
    parts = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS ints FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS MATERIALIZED (SELECT vec_id, part, ints[part * len(ints) // 4 + 1 : (part + 1) * len(ints) // 4] AS x FROM kept, range(4) p(part))",
        "c_0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY entry < 256)",
    ]
    for k in range(1, codes.ROUNDS + 1):
        parts.append(f"a_{k} AS MATERIALIZED ({near.format(c=f'c_{k - 1}')})")
        parts.append(f"u_{k} AS (SELECT v.part, best % 256 AS entry, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS place FROM v JOIN a_{k} a ON a.vec_id = v.vec_id AND a.part = v.part)")
        parts.append(f"m_{k} AS (SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM u_{k} GROUP BY ALL)")
        parts.append(f"n_{k} AS (SELECT part, entry, list(x ORDER BY place) AS x FROM m_{k} GROUP BY ALL)")
        parts.append(f"c_{k} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c_{k - 1} c LEFT JOIN n_{k} n ON n.part = c.part AND n.entry = c.entry)")
    last = f"c_{codes.ROUNDS}"
    parts.append(f"a AS MATERIALIZED ({near.format(c=last)})")
    parts.append(f"d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM {last})")
    parts.append("r AS (SELECT vec_id, string_agg(lower(printf('%02x', (best % 256)::INT)), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a GROUP BY vec_id)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM r JOIN kept USING (vec_id), d
"""


QUERIES["op11_vector_codes"] = op11_vector_codes
ORACLES["op11_vector_codes"] = _codes_sql()


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES["op12_prefix_trie"] = op12_prefix_trie
ORACLES["op12_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (  -- CRC-32 of the decimal id, a bit at a time
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                            lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::UBIGINT)), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))),
                4294967295::UBIGINT) % 4 AS h
  FROM own
),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.s[1:h], []), o.s[h + 1:]) AS s FROM h o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
),
pre AS (SELECT conv_id, d, s[1:d] AS p, d = len(s) AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM rebuilt, LATERAL (SELECT unnest(range(len(s) + 1)) AS d)),
nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM pre GROUP BY p, d
),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own_kids AS (SELECT nodes.p, nodes.d, saved, coalesce(kids.n, 0) AS n FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
subtrees AS (SELECT p[1:e] AS p, sum(saved)::BIGINT AS saved, count(*) FILTER (WHERE n = 0) AS leaves FROM own_kids, LATERAL (SELECT unnest(range(d + 1)) AS e) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, u.conv_id AS parent_conv_id, a.n_convs, k.n AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, a.ends_sha256
FROM nodes a JOIN own_kids k ON k.p = a.p JOIN subtrees t ON t.p = a.p LEFT JOIN nodes u ON a.d > 0 AND u.p = a.p[1:a.d - 1]
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES["op13_simhash"] = op13_simhash
