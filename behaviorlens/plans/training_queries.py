"""Splits, cross-validation, ablations, one day's alerts and assembled graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.operators import daily as D
from behaviorlens.operators import graph_assembly as GA
from behaviorlens.operators import scoring as S
from behaviorlens.operators import similarity as SIM
from behaviorlens.operators import training as T
from behaviorlens.plans import daily_queries as DQ
from behaviorlens.plans import evaluation_queries as EQ
from behaviorlens.plans import graph_queries as GQ
from behaviorlens.plans import testviews as V
from behaviorlens.sources.store import written

QUERIES, ORACLES = {}, {}
TRAIN_END, VALIDATION_END, DAY = "2024-01-18", "2024-01-24", "2024-01-15"


def _register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_IN_ATTACK = 'EXISTS (SELECT 1 FROM insiders WHERE user_id = k."user" AND k.day BETWEEN attack_start::DATE AND attack_end::DATE)'
_SPLIT = f"CASE WHEN date <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN date <= TIMESTAMP '{VALIDATION_END}' THEN 'val' ELSE 'test' END"
_EVENTS = " UNION ALL ".join(f'SELECT "user", date FROM {k}' for k in ("logon", "device", "file", "email", "http"))
_register(
    "split_summary",
    lambda s, d: T.split_summary(T.split_features(V.logs(s, d), V.insiders(s, d), TRAIN_END, VALIDATION_END)).withColumn("ratio", F.round("ratio", 6)),
    f"""{DQ.WITH}, k AS (SELECT DISTINCT "user", date::DATE AS day, {_SPLIT} AS split FROM ({_EVENTS})),
m AS (SELECT *, CASE WHEN {_IN_ATTACK} THEN 1 ELSE 0 END AS bad FROM k)
SELECT split, count(*) AS rows, count(DISTINCT "user") AS users, sum(bad)::BIGINT AS malicious, round(sum(bad) / count(*)::DOUBLE, 6) AS ratio FROM m GROUP BY split""",
)
_NAMES = C.FEATURES


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.split_features(V.logs(spark, sf_dir), V.insiders(spark, sf_dir), TRAIN_END, VALIDATION_END, inclusive_end_day=True)
    return T.training_set(rows, _NAMES).select("user", "day", "split", *[F.round(n, 5).alias(n) for n in _NAMES])


_register(
    "training_set",
    _scaled,
    f"{DQ.WITH},\n{DQ._FEATURES_SQL}, sp AS (SELECT *, CASE WHEN day <= DATE '{TRAIN_END}' THEN 'train' WHEN day <= DATE '{VALIDATION_END}' THEN 'val' ELSE 'test' END AS split FROM features),\n"
    + "st AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}" for n in _NAMES) + " FROM sp WHERE split = 'train')\n"
    + 'SELECT "user", day, split, ' + ", ".join(f"round(({n} - m_{n}) / (s_{n} + 1e-8), 5) AS {n}" for n in _NAMES) + " FROM sp, st",
)
_register(
    "class_imbalance",
    lambda s, d: T.imbalance(DQ.labelled_windows(s, d)).withColumn("share", F.round("share", 6)),
    f"{DQ.WITH},\n{DQ._FEATURES_SQL},\n{DQ.WINDOWS_SQL}\nSELECT count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(label), 6) AS share FROM labelled",
)
_register("max_history", lambda s, d: T.max_history(DQ.features(s, d)), f"{DQ.WITH}, k AS (SELECT \"user\", count(DISTINCT date::DATE) AS n FROM ({_EVENTS}) GROUP BY 1) SELECT max(n) AS max_days FROM k")
_register("latest_days", lambda s, d: S.latest_days(V.logs(s, d)), f'{DQ.WITH} SELECT "user", max(date)::DATE AS last_day FROM ({_EVENTS}) GROUP BY 1')


def _ablation_sql(size: int) -> str:
    return f"""
s{size} AS (SELECT DISTINCT "user", unnest(range(0, n - {size} + 1, 7)) AS start FROM days WHERE n >= {size}),
o{size} AS (SELECT w."user", start, avg(CASE WHEN day BETWEEN attack_start::DATE AND attack_end::DATE THEN 1 ELSE 0 END) AS overlap FROM days w JOIN s{size} USING ("user") LEFT JOIN insiders ON user_id = w."user" WHERE rn >= start AND rn < start + {size} GROUP BY w."user", start),
c{size} AS (SELECT {size} AS size, count(*) AS n_windows, coalesce(sum((overlap >= 0.5)::INT), 0)::BIGINT AS positives FROM o{size} WHERE overlap >= 0.5 OR overlap = 0)"""


_register(
    "window_ablation",
    lambda s, d: T.window_ablation(DQ.features(s, d), V.insiders(s, d)),
    f'{DQ.WITH}, days AS (SELECT "user", day, row_number() OVER (PARTITION BY "user" ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY "user") AS n FROM (SELECT DISTINCT "user", date::DATE AS day FROM ({_EVENTS}))),'
    + ",".join(_ablation_sql(n) for n in T.ABLATION_SIZES)
    + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM c{n}" for n in T.ABLATION_SIZES) + ")\n"
    "SELECT size, n_windows, positives, CASE WHEN (SELECT max(n) FROM days) < size THEN 'skipped_insufficient_history' WHEN positives = 0 THEN 'skipped_no_positive_windows' ELSE 'ok' END AS status FROM a",
)


def _ablation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window size with the area under precision and recall of the windows' mean |z|."""
    z = written(DQ.bootstrap_z(spark, sf_dir))

    def score(rows: DataFrame, labelled: DataFrame) -> DataFrame:
        means = rows.join(z, ["user", "day"]).groupBy("user", "start").agg(F.round(F.avg(F.abs("z")), 5).alias("prob"))
        return labelled.select("user", "start", "label").join(means, ["user", "start"])

    found = T.window_ablation(z.select("user", "day").distinct(), V.insiders(spark, sf_dir), score=score)
    return found.withColumn("auprc", F.round("auprc", 6))


_SCORE_SQL = "p{n} AS (SELECT {n} AS size, o.\"user\", o.start, any_value(overlap) AS overlap, round(avg(abs(z)), 5) AS prob FROM o{n} o JOIN days d ON d.\"user\" = o.\"user\" AND rn >= o.start AND rn < o.start + {n} JOIN z ON z.\"user\" = d.\"user\" AND z.day = d.day GROUP BY ALL)"
_register(
    "ablation_auprc",
    _ablation_scores,
    f'{DQ.WITH},\n{DQ.Z_SQL}, days AS (SELECT "user", day, row_number() OVER (PARTITION BY "user" ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY "user") AS n FROM (SELECT DISTINCT "user", day FROM features)),'
    + ",".join(f"{_ablation_sql(n)},\n{_SCORE_SQL.format(n=n)}" for n in T.ABLATION_SIZES)
    + ", ab AS (" + " UNION ALL ".join(f"SELECT * FROM c{n}" for n in T.ABLATION_SIZES) + "), ps AS (" + " UNION ALL ".join(f"SELECT * FROM p{n} WHERE overlap >= 0.5 OR overlap = 0" for n in T.ABLATION_SIZES) + """),
ct AS (SELECT size, prob, count(*) FILTER (overlap >= 0.5) AS pos, count(*) FILTER (overlap = 0) AS neg FROM ps GROUP BY ALL),
tt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY size) AS p, sum(neg) OVER (PARTITION BY size) AS n FROM ct WINDOW w AS (PARTITION BY size ORDER BY prob DESC)),
au AS (SELECT size, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p) ELSE 0 END AS auprc FROM tt GROUP BY size),
st AS (SELECT ab.*, CASE WHEN (SELECT max(n) FROM days) < size THEN 'skipped_insufficient_history' WHEN positives = 0 THEN 'skipped_no_positive_windows' ELSE 'ok' END AS status FROM ab)
SELECT st.*, CASE WHEN status = 'ok' THEN round(auprc, 6) END AS auprc, coalesce(size = (SELECT arg_max(size, auprc) FROM au JOIN st USING (size) WHERE status = 'ok'), FALSE) AS is_best FROM st LEFT JOIN au USING (size)""",
)


def _fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows with their mean |z| as the score, in five folds and two seeds that a user's number names."""
    rows = EQ.flagged_windows(spark, sf_dir).withColumn("_u", F.substring("user", 2, 9).cast("int"))
    return rows.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("fold", F.pmod(F.col("_u") + F.col("seed") * F.floor(F.col("_u") / 7), F.lit(3)).cast("int"))


_FOLD_SQL = f"""{DQ.WITH},\n{DQ.ZW_SQL},
fl AS (SELECT l."user", l.window_start, l.label, round(avg(abs(z)), 5) AS prob FROM labelled l JOIN zw ON zw."user" = l."user" AND zw.start = l.start GROUP BY l."user", l.start, l.window_start, l.label),
sc AS (SELECT f.*, seed, ((substr("user", 2)::INT + seed * (substr("user", 2)::INT // 7)) % 3)::INT AS fold FROM fl f, (SELECT unnest([0, 1])::INT AS seed)),
ct AS (SELECT seed, fold, prob, sum(label)::BIGINT AS pos, count(*) - sum(label)::BIGINT AS neg FROM sc GROUP BY ALL),
tt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY seed, fold) AS p, sum(neg) OVER (PARTITION BY seed, fold) AS n FROM ct WINDOW w AS (PARTITION BY seed, fold ORDER BY prob DESC)),
rk AS (SELECT seed, fold, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p) ELSE 0 END AS auprc, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(p) * max(n)::DOUBLE) ELSE 0 END AS auroc,
             CASE WHEN max(p) > 0 AND max(n) > 0 THEN max(2.0::DOUBLE * tp / (tp + fp + p)) ELSE 0 END AS best_f1 FROM tt GROUP BY seed, fold),
dd AS (SELECT seed, fold, floor(date_diff('second', attack_start, f::TIMESTAMP) / 86400.0::DOUBLE) AS days FROM (SELECT seed, fold, "user", min(window_start) AS f FROM sc WHERE prob > 0.3 GROUP BY ALL) JOIN insiders ON user_id = "user"),
fm AS (SELECT rk.*, md AS median_days FROM rk LEFT JOIN (SELECT seed, fold, median(days)::DOUBLE AS md FROM dd GROUP BY ALL) USING (seed, fold))"""
_register(
    "fold_metrics",
    lambda s, d: T.fold_metrics(_fold_scores(s, d), V.insiders(s, d), 0.3).select("seed", "fold", *[F.round(m, 6).alias(m) for m in T.METRICS]),
    f"{_FOLD_SQL}\nSELECT seed, fold, " + ", ".join(f"round({m}, 6) AS {m}" for m in T.METRICS) + " FROM fm",
)
_register(
    "cross_validation_summary",
    lambda s, d: T.cross_validation_summary(T.fold_metrics(_fold_scores(s, d), V.insiders(s, d), 0.3)).select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")),
    f"{_FOLD_SQL}, lg AS (" + " UNION ALL ".join(f"SELECT seed, '{m}' AS metric, {m} AS value FROM fm" for m in T.METRICS) + "), se AS (SELECT metric, seed, avg(value) AS mean, stddev_pop(value) AS std FROM lg GROUP BY ALL)\n"
    "SELECT metric, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM se GROUP BY metric",
)
_register(
    "focal_loss",
    lambda s, d: EQ.scored(s, d).groupBy("label").agg(F.round(F.avg(T.focal_loss(F.col("prob"), F.col("label"))), 6).alias("loss")),
    f"WITH {EQ._SCORED}, q AS (SELECT label, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM scored), t AS (SELECT label, CASE WHEN label = 1 THEN p ELSE 1 - p END AS r FROM q)\n"
    "SELECT label, round(avg(-(CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END) * pow(1 - r, 2.0::DOUBLE) * ln(r)), 6) AS loss FROM t GROUP BY label",
)
_register(
    "confusion_shares",
    lambda s, d: T.confusion_shares(EQ.E.confusion(EQ.scored(s, d))).select(*[F.round(f"{c}_share", 6).alias(f"{c}_share") for c in ("tn", "fp", "fn", "tp")]),
    f"""WITH {EQ._SCORED}, c AS (SELECT sum((prob < 0.5)::INT) FILTER (label = 0) / count(*) FILTER (label = 0)::DOUBLE AS tn, sum((prob >= 0.5)::INT) FILTER (label = 0) / count(*) FILTER (label = 0)::DOUBLE AS fp,
  sum((prob < 0.5)::INT) FILTER (label = 1) / count(*) FILTER (label = 1)::DOUBLE AS fn, sum((prob >= 0.5)::INT) FILTER (label = 1) / count(*) FILTER (label = 1)::DOUBLE AS tp FROM scored)
SELECT round(tn, 6) AS tn_share, round(fp, 6) AS fp_share, round(fn, 6) AS fn_share, round(tp, 6) AS tp_share FROM c""",
)


def _day_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of one day with a logistic score of the mean z."""
    rows = D.long_form(DQ.features(spark, sf_dir), ["user", "day"])
    score = lambda z: z.groupBy("user", "day").agg((1 / (1 + F.exp(-4 * F.avg("z")))).alias("prob"))
    found = S.score_day(V.logs(spark, sf_dir), DAY, S.feature_statistics(rows), score, threshold=0.5)
    return found.select("user", "date", "score", "status", F.array_join("top_features", ",").alias("top_features"))


def _all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all days with the same score."""
    features = DQ.features(spark, sf_dir)
    score = lambda z: z.groupBy("user", "day").agg((1 / (1 + F.exp(-4 * F.avg("z")))).alias("prob"))
    found = S.score_days(features, S.feature_statistics(D.long_form(features, ["user", "day"])), score, threshold=0.5, model="mean")
    return found.select("id", "user", "date", "score", "status", F.array_join("top_features", ",").alias("top_features"))


def _alerts_sql(day: str) -> str:
    return f"""{DQ.WITH},\n{DQ._FEATURES_SQL}, st AS (SELECT feature, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY feature),
q AS (SELECT "user", day, feature, (x - m) / (s + 1e-8) AS z FROM long JOIN st USING (feature) {day}),
r AS (SELECT *, row_number() OVER (PARTITION BY "user", day ORDER BY round(z, 9) DESC, feature) AS k FROM q),
p AS (SELECT "user", day, 1 / (1 + exp(-4 * avg(z))) AS prob, string_agg(feature, ',' ORDER BY k) FILTER (k <= 3) AS top_features FROM r GROUP BY ALL)"""


_register("score_day", _day_alerts, f"{_alerts_sql(f'WHERE day = DATE {chr(39)}{DAY}{chr(39)}')}\nSELECT \"user\", day AS date, round(prob, 4) AS score, 'open' AS status, top_features FROM p WHERE prob > 0.5")
_register(
    "score_days",
    _all_alerts,
    f"{_alerts_sql('')}\nSELECT substr(sha256(\"user\" || '|' || day::VARCHAR || '|mean'), 1, 32) AS id, \"user\", day AS date, round(prob, 4) AS score, 'open' AS status, top_features FROM p WHERE prob > 0.5",
)
_register(
    "correction_features",
    lambda s, d: S.day_features(V.logs(s, d), DAY),
    f"{DQ.WITH},\n{DQ._FEATURES_SQL}\nSELECT * FROM features WHERE day = DATE '{DAY}'",
)
_register(
    "department_summary",
    lambda s, d: S.by_department(S.directory(S.demo_alerts(DQ.bootstrap_z(s, d)), V.ldap(s, d))).select("department", "n", F.round("mean_score", 4).alias("mean_score"), "top_score"),
    f"""{DQ.WITH},\n{DQ.Z_SQL},\n{DQ.MAGNITUDE_SQL}, al AS (SELECT "user", max(round(least(1.0, mean_abs_z / 3), 4)) AS score FROM mag WHERE mean_abs_z / 3 >= 0.3 GROUP BY "user"),
e AS (SELECT coalesce(department, 'Unknown') AS department, score FROM al LEFT JOIN ldap ON user_id = "user") SELECT department, count(*) AS n, round(avg(score), 4) AS mean_score, max(score) AS top_score FROM e GROUP BY 1""",
)
_register(
    "attack_days",
    lambda s, d: S.attack_days(DQ.labelled_windows(s, d), V.insiders(s, d), 14).select("user", "start", F.size("days_in_attack").cast("long").alias("n"), F.coalesce(F.array_min("days_in_attack"), F.lit(-1)).cast("long").alias("first")),
    f"""{DQ.WITH},\n{DQ._FEATURES_SQL},\n{DQ.WINDOWS_SQL}, g AS (SELECT l."user", start, i, (window_start + i::INT) BETWEEN attack_start::DATE AND attack_end::DATE AS inside FROM labelled l CROSS JOIN range(0, 14) t(i) LEFT JOIN insiders ON user_id = l."user")
SELECT "user", start::INT AS start, coalesce(sum(inside::INT), 0)::BIGINT AS n, coalesce(min(i) FILTER (inside), -1)::BIGINT AS first FROM g GROUP BY ALL""",
)


def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, users = V.ldap(spark, sf_dir), DQ.features(spark, sf_dir).select("user").distinct()
    known = people.where("user_id < 'u5'")  # the version that the vocabularies come from
    found = T.static_features(users, V.ocean(spark, sf_dir), S.vocabulary(known, "role", "user_id"), S.vocabulary(known, "department", "user_id"), people)
    return found.select("user", *[F.round(n, 5).alias(n) for n in "OCEAN"], "role", "department")


_vocabulary = lambda c: f"(SELECT {c}, row_number() OVER (ORDER BY o, {c}) AS idx FROM (SELECT {c}, min(user_id) AS o FROM ldap WHERE user_id < 'u5' GROUP BY {c}))"
_register(
    "static_features",
    _static,
    f"{DQ.WITH}, us AS (SELECT DISTINCT \"user\" FROM ({_EVENTS})), st AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in "OCEAN") + " FROM ocean)\n"
    'SELECT us."user", ' + ", ".join(f"round(coalesce(({n} - m_{n}) / (s_{n} + 1e-8), 0), 5) AS {n}" for n in "OCEAN")
    + f", coalesce(r.idx, 0)::BIGINT AS role, coalesce(p.idx, 0)::BIGINT AS department FROM us LEFT JOIN ocean ON ocean.user_id = us.\"user\" LEFT JOIN ldap l ON l.user_id = us.\"user\" LEFT JOIN {_vocabulary('role')} r ON r.role = l.role LEFT JOIN {_vocabulary('department')} p ON p.department = l.department, st",
)
_register(
    "window_user_nodes",
    lambda s, d: GA.window_users(V.logs(s, d), GQ.WINDOWS),
    f"""{DQ.WITH}, {GQ._WIN},{GQ._EMAIL}, u AS (SELECT "user", date, TRUE AS l FROM ({_EVENTS}) UNION ALL SELECT string_split(addr, '@')[1], date, FALSE FROM mail WHERE ends_with(addr, '@dtaa.com'))
SELECT ws AS window_start, "user", bool_or(l) AS in_logs FROM u JOIN wins ON date >= ws AND date <= ws + 13 GROUP BY 1, 2""",
)
_register(
    "window_graph_edges",
    lambda s, d: GA.windowed_graph(V.logs(s, d), GQ.WINDOWS, max_url_nodes=4, max_file_nodes=5).edges["file"].groupBy("window_start", "filename").agg(F.sum("n").alias("n"), F.count("*").alias("edges")),
    f"""{DQ.WITH}, {GQ._WIN}, {GQ._win('file')}, k AS (SELECT window_start, filename, count(*) AS n, count(DISTINCT "user") AS edges FROM w_file GROUP BY ALL)
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, filename) <= 5""",
)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph of some days by kind, with the sums of their ends' numbers."""
    graph = GA.hetero_graph(V.logs(spark, sf_dir), V.insiders(spark, sf_dir), "2024-01-05", "2024-01-20")
    out = None
    for kind in ("logon", "http", "email"):
        part = graph.edges[kind].groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out


_T = "date >= TIMESTAMP '2024-01-05' AND date <= TIMESTAMP '2024-01-20'"
_register(
    "hetero_graph",
    _graph,
    f"""{DQ.WITH}, un AS (SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS i FROM (SELECT DISTINCT "user" FROM ({_EVENTS}) WHERE {_T})),
pn AS (SELECT pc, row_number() OVER (ORDER BY pc) - 1 AS i FROM (SELECT DISTINCT pc FROM (SELECT pc, date FROM logon UNION ALL SELECT pc, date FROM device) WHERE {_T})),
hh AS (SELECT DISTINCT "user", {GQ._DOM} AS domain FROM http WHERE {_T}), dn AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS i FROM (SELECT DISTINCT domain FROM hh)),{GQ._EMAIL},
e AS (SELECT 'logon' AS kind, un.i AS s, pn.i AS t FROM logon JOIN un USING ("user") JOIN pn USING (pc) WHERE lower(activity) = 'logon' AND {_T}
  UNION ALL SELECT 'http', un.i, dn.i FROM hh JOIN un USING ("user") JOIN dn USING (domain) UNION ALL SELECT 'email', a.i, b.i FROM pairs JOIN un a ON a."user" = src JOIN un b ON b."user" = dst WHERE {_T})
SELECT kind, count(*) AS n, sum(s)::BIGINT AS src, sum(t)::BIGINT AS dst FROM e GROUP BY kind""",
)
_register(
    "graph_statistics",
    lambda s, d: GA.graph_statistics(DQ.features(s, d), C.FEATURES).select("name", "n", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "nonzero")]),
    f"{DQ.WITH},\n{DQ._FEATURES_SQL}\nSELECT feature AS name, count(*) AS n, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean, round(avg((x <> 0)::INT), 4) AS nonzero FROM long GROUP BY feature",
)
_register(
    "lsh_neighbours",
    lambda s, d: SIM.lsh_neighbours(EQ._points(s, d), EQ._points(s, d).where("point_id % 100 = 0"), SIM.random_planes(64, 4, 12), 5).select("query_id", "point_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank")),
)
_register(
    "code_neighbours",
    lambda s, d: SIM.code_neighbours(EQ._points(s, d), EQ._points(s, d).where("point_id % 100 = 0"), 64, 5).select("query_id", "point_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank")),
)
