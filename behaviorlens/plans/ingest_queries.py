"""Features from a stream of files, and stores that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.operators import graph_assembly as GA
from behaviorlens.operators import scoring as S
from behaviorlens.plans import daily_queries as DQ
from behaviorlens.plans import graph_queries as GQ
from behaviorlens.plans import serving_queries as SQ
from behaviorlens.plans import testviews as V
from behaviorlens.sources.graph_cache import GraphCache, content_key
from behaviorlens.sources.points import PointStore
from behaviorlens.sources.snapshots import AlertStore
from behaviorlens.sources.store import FeatureStore, new_folder, written
from behaviorlens.streaming.ingest import LogSink, ingest

QUERIES, ORACLES = {}, {}


def streamed_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features of the events as a stream brings them into the feature store, file by file."""
    folder = new_folder(spark, "ingest")
    files = f"{sf_dir}/events.parque[t]"  # a stream reads a folder or a pattern, and this may be a single file
    stream = spark.readStream.schema(V.read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(files)
    sink = LogSink(FeatureStore(spark, f"{folder}/store"), "r0", lambda rows: V.logs_of(V.numbered(rows)))
    ingest(stream, sink, f"{folder}/checkpoint")
    found = sink.features(spark)
    return DQ.features(spark, sf_dir).limit(0) if found is None else found


QUERIES["streamed_user_days"] = streamed_user_days
ORACLES["streamed_user_days"] = DQ.ORACLES["user_day_features"]


def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored alerts after they came in twice and the two highest were blocked and muted."""
    found = SQ.alerts(spark, sf_dir).withColumns({"id": S.alert_id(F.col("user"), F.col("date"), "demo"), "created_at": F.current_timestamp()})
    found = written(found.withColumn("top_features", F.transform("top_features", lambda x: x["feature"])))  # made once, though they come in twice
    store = AlertStore(spark, new_folder(spark, "alerts"))
    for _ in range(2):
        store.add(found)
    top = store.load().orderBy(F.desc("score"), "user", "date").limit(2).collect()
    for alert, step in zip(top, (store.block, store.mute)):
        step(alert.id)
    return store.alerts.read().select("id", "user", "date", "score", "status")


QUERIES["alert_lifecycle"] = alert_lifecycle
ORACLES["alert_lifecycle"] = f"""{SQ._ALERTS_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, "user", date) AS k FROM al)
SELECT substr(sha256("user" || '|' || date::VARCHAR || '|demo'), 1, 32) AS id, "user", date, score, CASE k WHEN 1 THEN 'blocked' WHEN 2 THEN 'muted' ELSE 'open' END AS status FROM placed"""


def indexed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored points of one version and two departments from a score on, by their indexes."""
    points = V.read(spark, sf_dir, "embeddings").where("embedding is not null").select(
        F.concat(F.lit("v"), F.col("vec_id") % 3).alias("version"), F.concat(F.lit("u"), "vec_id").alias("user_id"), F.concat(F.lit("d"), F.coalesce("label", F.lit(-1))).alias("department"),
        (F.col("vec_id") % 5).cast("int").alias("scenario"), (F.col("vec_id") % 100 / 100).alias("score"), F.col("embedding").alias("vector"),
    )
    store = PointStore(spark, new_folder(spark, "points"), 64)
    store.write(points)
    return store.where(F.col("score") >= 0.25, version="v1", department=["d2", "d7"]).select("user_id", "version", "department", "scenario", F.round("score", 2).alias("score"))


QUERIES["indexed_points"] = indexed_points
ORACLES["indexed_points"] = """SELECT 'u' || vec_id AS user_id, 'v1' AS version, 'd' || label AS department, (vec_id % 5)::INT AS scenario, round(vec_id % 100 / 100.0::DOUBLE, 2) AS score
FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 = 1 AND label IN (2, 7) AND vec_id % 100 >= 25"""


def numbered_window_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the window graphs by kind, both ways, with the sums of their ends' numbers; from a cache that first holds one window, then all."""
    logs, cache, starts = {k: written(x) for k, x in V.logs(spark, sf_dir).items()}, GraphCache(spark, new_folder(spark, "graphs")), ["2024-01-01", "2024-01-08", "2024-01-15"]
    key = content_key([], max_url_nodes=None, max_file_nodes=None, prior_days=GQ.PRIOR, **GQ.WINDOWS)

    def build(missing: list[str]) -> dict[str, DataFrame]:
        return GA.numbered_windows(GA.windowed_graph(logs, GA.reaching(GQ.WINDOWS, missing), GQ.PRIOR, once=True)).edges

    cache.tables(key, starts[:1], build)
    parts = [
        table.groupBy("window_start", F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))
        for kind, table in cache.tables(key, starts, build).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_ends = lambda t, u: f"JOIN un a ON a.window_start = e.window_start AND a.k = e.{t[0]} JOIN {u} b ON b.window_start = e.window_start AND b.k = e.{t[1]}"
_place = lambda sql: f"(SELECT window_start, k, row_number() OVER (PARTITION BY window_start ORDER BY k) - 1 AS i FROM ({sql}))"
_WINDOW_USERS = f"""SELECT ws AS window_start, "user" AS k FROM ({GQ._ALL}) JOIN wins ON date >= ws AND date <= ws + 13
  UNION SELECT window_start, string_split(addr, '@')[1] FROM wm WHERE ends_with(addr, '@dtaa.com')"""
QUERIES["numbered_window_graph"] = numbered_window_graph
ORACLES["numbered_window_graph"] = f"""{DQ.WITH}, {GQ._WIN}, {GQ._win('logon')}, {GQ._win('device')}, {GQ._win('file')}, {GQ._win('http', extra=f', {GQ._DOM} AS domain')},{GQ._EMAIL},
wm AS (SELECT ws AS window_start, mail.* FROM mail JOIN wins ON date >= ws AND date <= ws + 13), wx AS (SELECT ws AS window_start, pairs.* FROM pairs JOIN wins ON date >= ws AND date <= ws + 13),
un AS {_place(_WINDOW_USERS)},
pn AS {_place("SELECT window_start, pc AS k FROM w_logon UNION SELECT window_start, pc FROM w_device")}, dn AS {_place("SELECT DISTINCT window_start, domain AS k FROM w_http")}, fn AS {_place("SELECT DISTINCT window_start, filename AS k FROM w_file")},
o AS (
  SELECT 'logon' AS kind, e.window_start, a.i AS s, b.i AS t FROM (SELECT DISTINCT window_start, "user" AS x, pc AS y FROM w_logon WHERE lower(activity) = 'logon') e {_ends('xy', 'pn')}
  UNION ALL SELECT 'usb', e.window_start, a.i, b.i FROM (SELECT DISTINCT window_start, "user" AS x, pc AS y FROM w_device WHERE lower(activity) = 'connect') e {_ends('xy', 'pn')}
  UNION ALL SELECT 'file', e.window_start, a.i, b.i FROM (SELECT DISTINCT window_start, "user" AS x, filename AS y FROM w_file) e {_ends('xy', 'fn')}
  UNION ALL SELECT 'http', e.window_start, a.i, b.i FROM (SELECT DISTINCT window_start, "user" AS x, domain AS y FROM w_http) e {_ends('xy', 'dn')}
  UNION ALL SELECT 'email', e.window_start, a.i, b.i FROM (SELECT DISTINCT window_start, src AS x, dst AS y FROM wx) e {_ends('xy', 'un')}
), both_ways AS (SELECT * FROM o UNION ALL SELECT 'rev_' || kind, window_start, t, s FROM o)
SELECT window_start, kind, count(*) AS n, sum(s)::BIGINT AS src, sum(t)::BIGINT AS dst FROM both_ways GROUP BY ALL"""


def graph_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed of the edges of a graph without the insiders' nodes: all, skipped ones, and the largest numbers of their ends."""
    graph = GA.hetero_graph(V.logs(spark, sf_dir), V.insiders(spark, sf_dir), "2024-01-05", "2024-01-20", excluded=V.insiders(spark, sf_dir).select(F.col("user_id").alias("user")))
    measured = GA.measure(graph)
    wrong = GA.problems(measured)
    if wrong:
        raise ValueError("; ".join(wrong))
    rows = [(k, *(measured[f"edges/{k}"][c] for c in ("n_edges", "n_skipped", "max_src", "max_dst"))) for k in GA.ENDS]
    return spark.createDataFrame(rows, "kind string, n_edges bigint, n_skipped bigint, max_src bigint, max_dst bigint")


_T = "date >= TIMESTAMP '2024-01-05' AND date <= TIMESTAMP '2024-01-20'"
_number = lambda sql: f"(SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM ({sql}))"
QUERIES["graph_measures"] = graph_measures
ORACLES["graph_measures"] = f"""{DQ.WITH},{GQ._EMAIL}, us AS (SELECT DISTINCT "user" AS k FROM ({GQ._ALL}) WHERE {_T}),
un AS {_number("SELECT k FROM us WHERE k NOT IN (SELECT user_id FROM insiders)")}, pn AS {_number(f"SELECT pc AS k FROM logon WHERE {_T} UNION SELECT pc FROM device WHERE {_T}")},
dn AS {_number(f"SELECT DISTINCT {GQ._DOM} AS k FROM http WHERE {_T}")}, fn AS {_number(f"SELECT DISTINCT filename AS k FROM file WHERE {_T}")},
e AS (SELECT 'logon' AS kind, "user" AS s, pc AS t FROM logon WHERE lower(activity) = 'logon' AND {_T} UNION ALL SELECT 'usb', "user", pc FROM device WHERE lower(activity) = 'connect' AND {_T}
  UNION ALL SELECT 'file', "user", filename FROM file WHERE {GQ._REM} AND {_T} UNION ALL SELECT 'email', src, dst FROM pairs WHERE dst IN (SELECT k FROM us) AND {_T}
  UNION ALL SELECT DISTINCT 'http', "user", {GQ._DOM} FROM http WHERE {_T}),
n AS (SELECT 'pc' AS c, * FROM pn UNION ALL SELECT 'url', * FROM dn UNION ALL SELECT 'file', * FROM fn UNION ALL SELECT 'user', * FROM un),
j AS (SELECT kind, un.i AS a, n.i AS b FROM e LEFT JOIN un ON un.k = e.s LEFT JOIN n ON n.k = e.t AND n.c = CASE kind WHEN 'file' THEN 'file' WHEN 'http' THEN 'url' WHEN 'email' THEN 'user' ELSE 'pc' END)
SELECT kind, count(*) AS n_edges, count(*) FILTER (a IS NULL OR b IS NULL) AS n_skipped, max(a) FILTER (b IS NOT NULL) AS max_src, max(b) FILTER (a IS NOT NULL) AS max_dst FROM j GROUP BY kind"""
