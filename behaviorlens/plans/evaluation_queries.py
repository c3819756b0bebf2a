"""Metrics, look-alikes and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.functions import predicates as P
from behaviorlens.operators import evaluation as E
from behaviorlens.operators import similarity as S
from behaviorlens.plans import daily_queries as DQ
from behaviorlens.plans import testviews as V
from behaviorlens.sources.store import written

QUERIES, ORACLES = {}, {}

_SCORED = """scored AS (
  SELECT l.doc_id AS id, toxic AS label, round(((d.n_chars * 7919 + l.doc_id % 7) % 997) / 997.0::DOUBLE * 0.7::DOUBLE + toxic * 0.25::DOUBLE, 2) AS prob, CASE WHEN toxic = 1 THEN 1 + l.doc_id % 3 ELSE 0 END AS scenario
  FROM labels l JOIN documents d USING (doc_id)
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic score for each labelled document."""
    rows = V.read(spark, sf_dir, "labels").join(V.read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    prob = F.round(((F.col("n_chars") * 7919 + F.col("doc_id") % 7) % 997) / 997.0 * 0.7 + F.col("toxic") * 0.25, 2)
    return rows.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), prob.alias("prob"), F.when(F.col("toxic") == 1, 1 + F.col("doc_id") % 3).otherwise(0).alias("scenario"))


def _metrics_sql(source: str, by: str) -> str:
    g, comma = (f"{by}", f"{by}, ") if by else ("1::INT", "")
    part = f"PARTITION BY {by}" if by else ""
    return f"""
c AS (SELECT {comma}prob, sum(label)::BIGINT AS pos, count(*) - sum(label)::BIGINT AS neg FROM {source} GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER ({part} ORDER BY prob DESC) AS tp, sum(neg) OVER ({part} ORDER BY prob DESC) AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM c),
m AS (SELECT *, 2.0::DOUBLE * tp / (tp + fp + p) AS f1 FROM t),
r AS (SELECT {comma}sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p) AS auprc, sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(p) * max(n)::DOUBLE) AS auroc, max(f1) AS best_f1,
             arg_max(prob, round(f1, 12) - prob * 1e-14) AS best_threshold FROM m {'GROUP BY ' + by if by else ''})"""


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("auprc", "auroc", "best_f1", "best_threshold")])


_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in ("auprc", "auroc", "best_f1", "best_threshold"))
QUERIES["binary_metrics"] = lambda s, d: _rounded(E.ranking_metrics(scored(s, d).withColumn("model", F.lit("m")), ["model"]), "model")
ORACLES["binary_metrics"] = f"WITH {_SCORED},\n{_metrics_sql('scored', '')}\nSELECT 'm' AS model, {_OUT} FROM r"
QUERIES["per_scenario_metrics"] = lambda s, d: _rounded(E.ranking_metrics(E.by_scenario(scored(s, d)), ["for_scenario"]), "for_scenario")
_BY = """by_sc AS (
  SELECT scenario AS for_scenario, prob, label FROM scored WHERE scenario <> 0 AND label = 1
  UNION ALL SELECT for_scenario, prob, label FROM scored, (SELECT DISTINCT scenario AS for_scenario FROM scored WHERE scenario <> 0) WHERE label = 0
)"""
ORACLES["per_scenario_metrics"] = f"WITH {_SCORED},\n{_BY},\n{_metrics_sql('by_sc', 'for_scenario')}\nSELECT for_scenario, {_OUT} FROM r"
QUERIES["precision_at_k"] = lambda s, d: E.precision_at(scored(s, d).withColumn("model", F.lit("m")), ["model"])
ORACLES["precision_at_k"] = f"""WITH {_SCORED}, k AS (SELECT label, row_number() OVER (ORDER BY prob DESC, id) AS r FROM scored)
SELECT 'm' AS model, avg(label) FILTER (r <= 10) AS p_at_10, avg(label) FILTER (r <= 20) AS p_at_20, avg(label) FILTER (r <= 50) AS p_at_50 FROM k"""
QUERIES["best_threshold"] = lambda s, d: E.ranking_metrics(scored(s, d).withColumn("model", F.lit("m")), ["model"]).select("best_threshold")
ORACLES["best_threshold"] = f"WITH {_SCORED},\n{_metrics_sql('scored', '')}\nSELECT best_threshold FROM r"
QUERIES["confusion_matrix"] = lambda s, d: E.confusion(scored(s, d)).select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
ORACLES["confusion_matrix"] = f"""WITH {_SCORED},
c AS (SELECT count(*) FILTER (prob < 0.5 AND label = 0) AS tn, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp, count(*) FILTER (prob < 0.5 AND label = 1) AS fn, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp FROM scored),
q AS (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM c)
SELECT tn, fp, fn, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-8), 6) AS f1 FROM q"""


def flagged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with their mean |z| as the score."""
    f = written(DQ.features(spark, sf_dir))
    mean = DQ.z_windows(spark, sf_dir, f).groupBy("user", "start").agg(F.round(F.avg(F.abs("z")), 5).alias("prob"))
    return DQ.labelled_windows(spark, sf_dir, f).join(mean, ["user", "start"])


_FLAGGED_SQL = f"{DQ.WITH},\n{DQ.ZW_SQL},\nfl AS (SELECT l.\"user\", l.window_start, round(avg(abs(z)), 5) AS prob FROM labelled l JOIN zw ON zw.\"user\" = l.\"user\" AND zw.start = l.start GROUP BY l.\"user\", l.start, l.window_start)"
_LATENCY_SQL = 'lat AS (SELECT user_id AS "user", floor(date_diff(\'second\', attack_start, f::TIMESTAMP) / 86400.0::DOUBLE)::INT AS days FROM insiders LEFT JOIN (SELECT "user", min(window_start) AS f FROM fl WHERE prob > 0.3 GROUP BY "user") x ON x."user" = user_id)'
QUERIES["detection_latency"] = lambda s, d: E.detection_latency(flagged_windows(s, d), V.insiders(s, d), 0.3).where("days is not null")
ORACLES["detection_latency"] = f"{_FLAGGED_SQL},\n{_LATENCY_SQL}\nSELECT \"user\", days::INT AS days FROM lat WHERE days IS NOT NULL"
QUERIES["latency_summary"] = lambda s, d: E.latency_summary(E.detection_latency(flagged_windows(s, d), V.insiders(s, d), 0.3))
ORACLES["latency_summary"] = f"{_FLAGGED_SQL},\n{_LATENCY_SQL}\nSELECT count(days) AS detected, count(*) AS total, median(days)::DOUBLE AS median_days, quantile_cont(days, 0.9)::DOUBLE AS p90_days FROM lat"
QUERIES["stratified_folds"] = lambda s, d: E.folds(DQ.features(s, d).select("user").distinct().join(V.insiders(s, d).select(F.col("user_id").alias("user"), F.lit(1).alias("pos")), "user", "left"), 5, 42, F.coalesce("pos", F.lit(0)))

_points = lambda s, d: V.read(s, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").alias("version"), F.col("embedding").alias("vector"))
QUERIES["knn_cosine"] = lambda s, d: S.find_similar(_points(s, d), _points(s, d).where("point_id % 100 = 0"), 5).select("query_id", "point_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))
ORACLES["knn_cosine"] = """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS point_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point_id) AS rank FROM p)
SELECT query_id, point_id, round(s, 5) AS score, rank FROM r WHERE rank <= 5"""
QUERIES["mean_embedding"] = lambda s, d: S.mean_embedding(_points(s, d), "version").select("version", F.posexplode("vector").alias("i", "x")).select("version", "i", F.round("x", 5).alias("x"))
ORACLES["mean_embedding"] = "WITH c AS (SELECT label AS version, generate_subscripts(embedding, 1)::INT - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT version, i, round(avg(x), 5) AS x FROM c GROUP BY ALL"

QUERIES["domain_extract"] = lambda s, d: V.read(s, d, "pages").groupBy(P.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
ORACLES["domain_extract"] = "SELECT lower(coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ''), url)) AS domain, count(*) AS n FROM pages GROUP BY 1"
QUERIES["content_keywords"] = lambda s, d: V.read(s, d, "documents").select("doc_id", P.content_words(F.col("text")).cast("long").alias("n_words"))
ORACLES["content_keywords"] = "SELECT doc_id, (" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in C.CONTENT_WORDS) + ")::BIGINT AS n_words FROM documents"
QUERIES["file_type_codes"] = lambda s, d: V.logs(s, d)["file"].groupBy(P.file_type(F.col("filename")).alias("code")).agg(F.count("*").alias("n"))
ORACLES["file_type_codes"] = f"{DQ.WITH}\nSELECT CASE regexp_extract(lower(filename), '(\\.[^./]+)$', 1) WHEN '.doc' THEN 1 WHEN '.pdf' THEN 2 WHEN '.exe' THEN 3 WHEN '.zip' THEN 4 ELSE 0 END AS code, count(*) AS n FROM file GROUP BY 1"
