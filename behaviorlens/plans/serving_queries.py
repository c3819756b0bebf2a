"""Alerts, investigations, dimension encodings and detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.functions import predicates as P
from behaviorlens.operators import baseline as B
from behaviorlens.operators import daily as D
from behaviorlens.operators import models as M
from behaviorlens.operators import network as N
from behaviorlens.operators import scoring as S
from behaviorlens.operators import similarity as SIM
from behaviorlens.operators import windows as W
from behaviorlens.plans import daily_queries as DQ
from behaviorlens.plans import testviews as V
from behaviorlens.sources.store import written

QUERIES, ORACLES = {}, {}
#: Alerts of the test tables start at a lower score, so that there are some.
FLOOR = 0.2


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.demo_alerts(DQ.bootstrap_z(spark, sf_dir), FLOOR)


_ALERTS_SQL = f"{DQ.WITH},\n{DQ.Z_SQL},\n{DQ.MAGNITUDE_SQL},\nal AS (SELECT \"user\", day AS date, mean_abs_z, round(least(1.0, mean_abs_z / 3), 4) AS score FROM mag WHERE mean_abs_z / 3 >= {FLOOR})"
QUERIES["demo_alerts"] = lambda s, d: alerts(s, d).select("user", "date", "score", "status", F.transform("top_features", lambda x: x["feature"]).alias("t")).select("user", "date", "score", "status", F.array_join("t", ",").alias("top_features"))
ORACLES["demo_alerts"] = f"""{_ALERTS_SQL},
rk AS (SELECT "user", day, feature, row_number() OVER (PARTITION BY "user", day ORDER BY round(abs(z), 9) DESC, feature) AS r FROM z),
tf AS (SELECT "user", day, string_agg(feature, ',' ORDER BY r) AS t FROM rk WHERE r <= 3 GROUP BY ALL)
SELECT al."user", date, score, 'open' AS status, t AS top_features FROM al JOIN tf ON tf."user" = al."user" AND tf.day = al.date"""
QUERIES["employee_directory"] = lambda s, d: S.directory(alerts(s, d), V.ldap(s, d))
ORACLES["employee_directory"] = f"""{_ALERTS_SQL}
SELECT al."user", max(score) AS latest_score, 'open' AS status, count(*) AS alert_count, coalesce(any_value(department), 'Unknown') AS department FROM al LEFT JOIN ldap ON user_id = al."user" GROUP BY 1"""
QUERIES["risk_bands"] = lambda s, d: S.directory(alerts(s, d), V.ldap(s, d)).groupBy(P.risk_band(F.col("latest_score")).alias("band"), "department").agg(F.count("*").alias("n"))
ORACLES["risk_bands"] = f"""{_ALERTS_SQL}, dir AS (SELECT al."user", max(score) AS s, coalesce(any_value(department), 'Unknown') AS department FROM al LEFT JOIN ldap ON user_id = al."user" GROUP BY 1)
SELECT CASE WHEN s < 0.4 THEN 'low' WHEN s < 0.7 THEN 'medium' ELSE 'high' END AS band, department, count(*) AS n FROM dir GROUP BY ALL"""


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.long_form(DQ.features(spark, sf_dir), ["user", "day"])


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feature_rows(spark, sf_dir)
    return S.top_features(rows, S.feature_statistics(rows)).select("user", "day", F.col("rank").cast("long").alias("rank"), "feature", F.round("z", 4).alias("z"))


QUERIES["top_features"] = _top
ORACLES["top_features"] = f"""{DQ.WITH},\n{DQ._FEATURES_SQL}, st AS (SELECT feature, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY feature),
q AS (SELECT "user", day, feature, (x - m) / (s + 1e-8) AS z FROM long JOIN st USING (feature)), r AS (SELECT *, row_number() OVER (PARTITION BY "user", day ORDER BY round(z, 9) DESC, feature) AS rank FROM q)
SELECT "user", day, rank, feature, round(z, 4) AS z FROM r WHERE rank <= 3"""
QUERIES["peak_features"] = lambda s, d: S.peak_features(DQ.bootstrap_z(s, d)).withColumn("z", F.round("z", 4))
ORACLES["peak_features"] = f"""{DQ.WITH},\n{DQ.Z_SQL}, pk AS (SELECT "user", feature, z FROM z QUALIFY row_number() OVER (PARTITION BY "user", feature ORDER BY abs(z) DESC, z DESC) = 1)
SELECT "user", feature, round(z, 4) AS z FROM pk QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY round(abs(z), 9) DESC, feature) <= 5"""
QUERIES["activity_timeline"] = lambda s, d: S.timeline(V.logs(s, d), F.lit(True))
ORACLES["activity_timeline"] = f"""{DQ.WITH},
ev_all AS (
  SELECT "user", id, date, 'logon' AS kind, CASE WHEN lower(activity) = 'logon' THEN 'Logged on at ' ELSE 'Logged off at ' END || pc AS text FROM logon
  UNION ALL SELECT "user", id, date, 'usb', 'USB ' || lower(activity) || ' at ' || pc FROM device
  UNION ALL SELECT "user", id, date, 'file', 'File access: ' || filename || CASE WHEN to_removable_media = 'True' THEN ' → removable drive' ELSE '' END FROM file
  UNION ALL SELECT "user", id, date, 'email', 'Email to ' || substr(coalesce("to", ''), 1, 60) || ' (' || floor(size / 1024)::BIGINT || ' KB)' FROM email
  UNION ALL SELECT "user", id, date, 'http', 'Visited ' || substr(url, 1, 80) FROM http
) SELECT * FROM ev_all"""
QUERIES["score_history"] = lambda s, d: S.score_history(B.daily_magnitude(DQ.bootstrap_z(s, d)).select("user", "day", F.least(F.lit(1.0), F.col("mean_abs_z") / 3).alias("score")), 14)
ORACLES["score_history"] = f"""{DQ.WITH},\n{DQ.Z_SQL},\n{DQ.MAGNITUDE_SQL}, cal AS (SELECT unnest(generate_series(hi - INTERVAL 13 DAY, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT max(day)::TIMESTAMP AS hi FROM mag))
SELECT u."user", cal.day, round(CASE WHEN mean_abs_z IS NULL THEN 0 ELSE least(1.0, mean_abs_z / 3) END, 4) AS score FROM (SELECT DISTINCT "user" FROM mag) u CROSS JOIN cal LEFT JOIN mag ON mag."user" = u."user" AND mag.day = cal.day"""
_NAMES = C.FEATURES
QUERIES["standardized_features"] = lambda s, d: S.standardised(DQ.features(s, d).select("user", "day", *_NAMES), F.col("day") <= F.lit("2024-01-18").cast("date"), _NAMES).select("user", "day", *[F.round(n, 5).alias(n) for n in _NAMES])
ORACLES["standardized_features"] = (
    f"{DQ.WITH},\n{DQ._FEATURES_SQL}, st AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}" for n in _NAMES) + " FROM features WHERE day <= DATE '2024-01-18')\n"
    'SELECT "user", day, ' + ", ".join(f"round(({n} - m_{n}) / (s_{n} + 1e-8), 5) AS {n}" for n in _NAMES) + " FROM features, st"
)
QUERIES["ocean_zscore"] = lambda s, d: S.traits(V.ocean(s, d), DQ.features(s, d).select("user").distinct()).select("user", *[F.round(n, 5).alias(n) for n in "OCEAN"])
ORACLES["ocean_zscore"] = (
    f"{DQ.WITH},\n{DQ._FEATURES_SQL}, st AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in "OCEAN") + " FROM ocean)\n"
    'SELECT u."user", ' + ", ".join(f"round(coalesce(({n} - m_{n}) / (s_{n} + 1e-8), 0), 5) AS {n}" for n in "OCEAN") + ' FROM (SELECT DISTINCT "user" FROM features) u LEFT JOIN ocean ON user_id = u."user", st'
)
QUERIES["category_vocab"] = lambda s, d: S.vocabulary(V.ldap(s, d), "role", "user_id").select("role", F.col("idx").cast("long").alias("idx"))
ORACLES["category_vocab"] = f"{DQ.WITH}, f AS (SELECT role, min(user_id) AS o FROM ldap GROUP BY role) SELECT role, row_number() OVER (ORDER BY o, role) AS idx FROM f"
QUERIES["z_bands"] = lambda s, d: DQ.bootstrap_z(s, d).groupBy("feature", P.z_band(F.round("z", 5)).alias("band")).agg(F.count("*").alias("n"))
ORACLES["z_bands"] = f"{DQ.WITH},\n{DQ.Z_SQL}\nSELECT feature, CASE WHEN abs(round(z, 5)) < 2 THEN 'normal' WHEN abs(round(z, 5)) < 3 THEN 'elevated' ELSE 'extreme' END AS band, count(*) AS n FROM z GROUP BY ALL"
QUERIES["window_vectors"] = lambda s, d: W.flattened(DQ.z_windows(s, d), C.FEATURES).select("user", "start", F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"))
ORACLES["window_vectors"] = f"{DQ.WITH},\n{DQ.ZW_SQL}\nSELECT \"user\", start::INT AS start, count(*) AS n, round(sum(abs(z)), 3) AS total FROM zw GROUP BY ALL"


def mlp_user_day_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a perceptron on daily features, of every day by a model that hasn't seen its user."""
    rows = D.label_days(DQ.features(spark, sf_dir), D.malicious_days(V.insiders(spark, sf_dir))).withColumnRenamed("is_malicious", "label")

    def fit(rows: DataFrame, held: Column) -> DataFrame:
        scaled = M.assemble(S.standardised(rows, ~held))
        return M.scores(M.perceptron(scaled.where(~held), len(C.FEATURES)), scaled.where(held), "user", "day", "label")

    return M.out_of_fold(rows, fit)


def window_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[str, ...]]:
    """(user, start, label) and the 129 statistics of each labelled window, and their names."""
    f = written(DQ.features(spark, sf_dir))
    zw = written(DQ.z_windows(spark, sf_dir, f))
    kinds = ("max_dev", "mean_dev", "std_dev", "days_2s", "days_3s", "trend", "max_burst")
    stats = W.window_statistics(zw).groupBy("user", "start").pivot("feature", list(C.FEATURES)).agg(*[F.first(k).alias(k) for k in kinds])
    rows = stats.join(W.cross_statistics(zw), ["user", "start"])
    names = tuple(c for c in rows.columns if c not in ("user", "start"))
    return rows.join(DQ.labelled_windows(spark, sf_dir, f).select("user", "start", "label"), ["user", "start"]), names


def gbt_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of boosted trees on window statistics, of every window by a model that hasn't seen its user."""
    rows, names = window_features(spark, sf_dir)

    def fit(rows: DataFrame, held: Column) -> DataFrame:
        return M.scores(M.boosted_trees(rows.where(~held), rounds=300), rows.where(held), "user", "start", "label")

    return M.out_of_fold(M.assemble(rows, names), fit)


def _network_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled windows as inputs of a network: z of all days and features, and the user's traits; with folds."""
    f = written(DQ.features(spark, sf_dir))
    windows = written(W.flattened(DQ.z_windows(spark, sf_dir, f), C.FEATURES))
    windows = W.with_traits(windows, S.traits(V.ocean(spark, sf_dir), windows.select("user").distinct()))
    rows = M.dealt(windows.join(DQ.labelled_windows(spark, sf_dir, f).select("user", "start", "label"), ["user", "start"]))
    return N.keyed(rows, F.col("values"), "user", "start", fold=F.col("fold"))


def network_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a network under focal loss, of every window, with its user's traits, by one that hasn't seen the user."""
    rows = _network_windows(spark, sf_dir)
    return N.scores(rows, N.fit(rows), "user", "start", "label")


def user_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, vector): the mean over a user's windows of the last hidden layer of one network for all."""
    rows = _network_windows(spark, sf_dir).withColumn("_fold", F.lit(-1))
    return SIM.mean_embedding(N.hidden(rows, N.fit(rows, N.Training(epochs=10)), "user"), "user")


def corrected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, day, before, after, is_correction): a network's scores of all days, and those after the day with the highest score was corrected to normal."""
    days = D.label_days(DQ.features(spark, sf_dir), D.malicious_days(V.insiders(spark, sf_dir))).withColumnRenamed("is_malicious", "label")
    rows = M.compact(written(N.keyed(days, F.array(*[F.col(n) for n in C.FEATURES]), "user", "day")))
    net = N.fit(rows, N.Training(epochs=20))[-1]
    before = N.scores(rows, {-1: net}, "user", "day").withColumnRenamed("prob", "before")
    highest = before.orderBy(F.desc("before"), "user", "day").limit(1).select("user", "day", F.lit(True).alias("is_correction"))
    marked = written(rows.join(highest, ["user", "day"], "left").withColumn("is_correction", F.coalesce("is_correction", F.lit(False))))
    after = N.corrected(net, marked.where("is_correction").withColumn("label", F.lit(0)))
    found = N.scores(marked, {-1: net}, "user", "day", "is_correction").withColumnRenamed("prob", "before")
    return found.join(N.scores(marked, {-1: after}, "user", "day").withColumnRenamed("prob", "after"), ["user", "day"])


QUERIES["network_window_scores"] = network_window_scores
QUERIES["corrected_scores"] = corrected_scores
QUERIES["user_embeddings"] = user_embeddings
QUERIES["mlp_user_day_scores"] = mlp_user_day_scores
QUERIES["gbt_window_scores"] = gbt_window_scores
