"""Daily features, baselines and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.config import WindowConfig
from behaviorlens.operators import baseline as B
from behaviorlens.operators import daily as D
from behaviorlens.operators import windows as W
from behaviorlens.plans import testviews as V
from behaviorlens.sources.store import written

QUERIES, ORACLES = {}, {}
WITH = "WITH RECURSIVE " + V.logs_sql()
#: Cohorts of the test tables, and windows that fit into their 30 days.
MIN_COHORT, WINDOWS = 30, WindowConfig(size=14, stride=7)

_AFTER = "(hour(date) < 7 OR hour(date) >= 19)"
_FEATURE_SQL = {
    "logon": {
        "logon_count": "count(*) FILTER (lower(activity) = 'logon')",
        "logoff_count": "count(*) FILTER (lower(activity) = 'logoff')",
        "after_hours_logons": f"count(*) FILTER (lower(activity) = 'logon' AND {_AFTER})",
        "weekend_logons": "count(*) FILTER (lower(activity) = 'logon' AND isodow(date) >= 6)",
        "unique_pcs_used": "count(DISTINCT pc)",
    },
    "device": {
        "usb_connect_count": "count(*) FILTER (lower(activity) = 'connect')",
        "usb_disconnect_count": "count(*) FILTER (lower(activity) = 'disconnect')",
        "after_hours_usb": f"count(*) FILTER ({_AFTER})",
    },
    "file": {
        "file_count": "count(filename)",
        "file_to_removable_count": "count(*) FILTER (lower(trim(to_removable_media)) = 'true')",
        "unique_filenames": "count(DISTINCT filename)",
    },
    "email": {
        "email_sent_count": "count(id)",
        "email_to_external_count": "count(*) FILTER (len(list_filter(string_split(\"to\", ';'), lambda x: NOT contains(x, 'dtaa.com'))) > 0)",
        "large_attachment_count": "count(*) FILTER (size > 1048576)",
        "total_email_size": "coalesce(sum(size), 0)",
    },
    "http": {
        "http_request_count": "count(url)",
        "job_search_visits": "count(*) FILTER (regexp_matches(lower(url), 'job|career|linkedin|indeed'))",
        "cloud_upload_visits": "count(*) FILTER (regexp_matches(lower(url), 'dropbox|wikileaks|pastebin'))",
    },
}


def _block_sql(kind: str) -> str:
    return f"SELECT \"user\", date::DATE AS day, {', '.join(f'{e} AS {n}' for n, e in _FEATURE_SQL[kind].items())} FROM {kind} GROUP BY ALL"


_FEATURES_SQL = (
    ",\n".join(f"b_{k} AS ({_block_sql(k)})" for k in _FEATURE_SQL)
    + ",\nkeys AS ("
    + " UNION ".join(f'SELECT "user", day FROM b_{k}' for k in _FEATURE_SQL)
    + "),\nfeatures AS (SELECT \"user\", day, "
    + ", ".join(f"coalesce({n}, 0) AS {n}" for n in C.FEATURES)
    + " FROM keys "
    + " ".join(f'LEFT JOIN b_{k} USING ("user", day)' for k in _FEATURE_SQL)
    + "),\nlong AS ("
    + " UNION ALL ".join(f"SELECT \"user\", day, '{n}' AS feature, {n}::DOUBLE AS x FROM features" for n in C.FEATURES)
    + ")"
)
_FLOOR_SQL = (
    "userstd AS (SELECT \"user\", feature, stddev_samp(x) AS s FROM long GROUP BY ALL),\n"
    "floors AS (SELECT feature, coalesce(nullif(median(s), 0), 1.0)::DOUBLE AS median_std FROM userstd GROUP BY feature)"
)
_COHORT_SQL = f"""
people AS (SELECT "user", role, department FROM (SELECT DISTINCT "user" FROM features) f LEFT JOIN ldap ON user_id = "user"),
assigned AS (
  SELECT "user", CASE WHEN count(role) OVER (PARTITION BY role) >= {MIN_COHORT} THEN 'role' WHEN count(department) OVER (PARTITION BY department) >= {MIN_COHORT} THEN 'department' ELSE 'global' END AS level,
         CASE WHEN count(role) OVER (PARTITION BY role) >= {MIN_COHORT} THEN role WHEN count(department) OVER (PARTITION BY department) >= {MIN_COHORT} THEN department ELSE 'all' END AS cohort
  FROM people
),
cohorts AS (
  SELECT 'role' AS level, role AS cohort, feature, count(DISTINCT "user") AS users, avg(x) AS mean, var_pop(x) AS var FROM long JOIN people USING ("user") WHERE role IS NOT NULL GROUP BY ALL HAVING count(DISTINCT "user") >= {MIN_COHORT}
  UNION ALL SELECT 'department', department, feature, count(DISTINCT "user"), avg(x), var_pop(x) FROM long JOIN people USING ("user") WHERE department IS NOT NULL GROUP BY ALL HAVING count(DISTINCT "user") >= {MIN_COHORT}
  UNION ALL SELECT 'global', 'all', feature, count(DISTINCT "user"), avg(x), var_pop(x) FROM long GROUP BY feature
)"""


def _ema_sql(prior: str) -> str:
    """z by (user, day, feature); `prior` gives m0, v0 of a (user, feature), null where there is none."""
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY "user", feature ORDER BY day) AS rn, count(*) OVER (PARTITION BY "user", feature) AS n FROM long),
h AS (SELECT "user", feature, any_value(n) AS n, avg(x) FILTER (rn <= 14) AS hm, var_pop(x) FILTER (rn <= 14) AS hv FROM r GROUP BY ALL),
prior AS ({prior}),
seed AS (
  SELECT h."user", h.feature, f.median_std * 0.1::DOUBLE AS flo, CASE WHEN p.m IS NOT NULL THEN p.m WHEN n >= 14 THEN hm ELSE 0.0 END AS m,
         CASE WHEN p.m IS NOT NULL THEN p.v WHEN n >= 14 THEN hv ELSE 0.0 END AS v, CASE WHEN p.m IS NOT NULL THEN 0 WHEN n >= 14 THEN 14 ELSE n END AS start
  FROM h JOIN floors f USING (feature) LEFT JOIN prior p USING ("user", feature)
),
ema AS (
  SELECT "user", feature, 0::BIGINT AS rn, NULL::DATE AS day, m, v, 0.0::DOUBLE AS z, start, flo FROM seed
  UNION ALL
  SELECT r."user", r.feature, r.rn, r.day,
         CASE WHEN r.rn <= e.start THEN e.m ELSE 0.95::DOUBLE * e.m + 0.05::DOUBLE * r.x END,
         CASE WHEN r.rn <= e.start THEN e.v ELSE 0.95::DOUBLE * e.v + 0.05::DOUBLE * pow(r.x - (0.95::DOUBLE * e.m + 0.05::DOUBLE * r.x), 2) END,
         CASE WHEN r.rn <= e.start THEN 0.0 ELSE (r.x - e.m) / greatest(sqrt(e.v + 1e-6), e.flo) END, e.start, e.flo
  FROM ema e JOIN r ON r."user" = e."user" AND r.feature = e.feature AND r.rn = e.rn + 1
),
z AS (SELECT "user", day, feature, z FROM ema WHERE rn > 0)"""


Z_SQL = ",\n".join([_FEATURES_SQL, _FLOOR_SQL, _ema_sql('SELECT NULL::VARCHAR AS "user", NULL::VARCHAR AS feature, NULL::DOUBLE AS m, NULL::DOUBLE AS v')])
_Z_COHORT_SQL = ",\n".join([_FEATURES_SQL, _FLOOR_SQL, _COHORT_SQL, _ema_sql('SELECT "user", feature, mean AS m, var AS v FROM assigned JOIN cohorts USING (level, cohort)')])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.daily_features(V.logs(spark, sf_dir))


def bootstrap_z(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """Deviations of the features `f`, which are made and written once if they aren't given."""
    f = written(features(spark, sf_dir)) if f is None else f
    return B.deviations(f, floors=B.median_user_std(f))


def _register(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


for _kind in _FEATURE_SQL:
    _register(f"user_day_{_kind}", lambda s, d, k=_kind: D.log_features(V.logs(s, d)[k], k), f"{WITH}\n{_block_sql(_kind)}")
_register("user_day_features", features, f"{WITH},\n{_FEATURES_SQL}\nSELECT * FROM features")
_register("malicious_days", lambda s, d: D.malicious_days(V.insiders(s, d)), f"{WITH}\nSELECT DISTINCT user_id AS \"user\", unnest(generate_series(attack_start, attack_end, INTERVAL 1 DAY))::DATE AS day FROM insiders")
_register(
    "labelled_user_days",
    lambda s, d: D.label_days(features(s, d), D.malicious_days(V.insiders(s, d))).select("user", "day", "logon_count", "is_malicious"),
    f"{WITH},\n{_FEATURES_SQL}\nSELECT f.\"user\", day, logon_count, CASE WHEN EXISTS (SELECT 1 FROM insiders WHERE user_id = f.\"user\" AND day BETWEEN attack_start::DATE AND attack_end::DATE) THEN 1 ELSE 0 END AS is_malicious FROM features f",
)
_register(
    "time_split_counts",
    lambda s, d: V.logs(s, d)["http"].select(D.time_split(F.col("date"), "2024-01-18", "2024-01-24").alias("split")).groupBy("split").agg(F.count("*").alias("n")),
    f"{WITH}\nSELECT CASE WHEN date <= TIMESTAMP '2024-01-18' THEN 'train' WHEN date <= TIMESTAMP '2024-01-24' THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM http GROUP BY 1",
)
_register(
    "median_user_std",
    lambda s, d: B.median_user_std(features(s, d)).select("feature", F.round("median_std", 6).alias("median_std")),
    f"{WITH},\n{_FEATURES_SQL},\n{_FLOOR_SQL}\nSELECT feature, round(median_std, 6) AS median_std FROM floors",
)
_register(
    "cohort_stats",
    lambda s, d: B.cohort_statistics(features(s, d), V.ldap(s, d), MIN_COHORT).select("level", "cohort", "feature", "users", F.round("mean", 4).alias("mean"), F.round(F.col("var") / (1 + F.col("mean") * F.col("mean")), 6).alias("rel_var")),
    f"{WITH},\n{_FEATURES_SQL},\n{_COHORT_SQL}\nSELECT level, cohort, feature, users, round(mean, 4) AS mean, round(var / (1 + mean * mean), 6) AS rel_var FROM cohorts",
)
_register("cohort_assignment", lambda s, d: B.assign_cohorts(features(s, d), V.ldap(s, d), MIN_COHORT), f"{WITH},\n{_FEATURES_SQL},\n{_COHORT_SQL}\nSELECT * FROM assigned")


def cohort_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, directory = written(features(spark, sf_dir)), V.ldap(spark, sf_dir)
    priors = B.assign_cohorts(f, directory, MIN_COHORT).join(B.cohort_statistics(f, directory, MIN_COHORT), ["level", "cohort"])
    return B.deviations(f, priors, B.median_user_std(f))


_round_z = lambda z: z.select("user", "day", "feature", F.round("z", 5).alias("z"))
_register("ema_deviation_bootstrap", lambda s, d: _round_z(bootstrap_z(s, d)), f"{WITH},\n{Z_SQL}\nSELECT \"user\", day, feature, round(z, 5) AS z FROM z")
_register("ema_deviation_cohort", lambda s, d: _round_z(cohort_z(s, d)), f"{WITH},\n{_Z_COHORT_SQL}\nSELECT \"user\", day, feature, round(z, 5) AS z FROM z")
_register(
    "baseline_gate",
    lambda s, d: B.validate(bootstrap_z(s, d), V.insiders(s, d)).select("user", *[F.round(c, 5).alias(c) for c in ("attack", "pre", "max_attack", "lift")], "passed"),
    f"""{WITH},\n{Z_SQL},
g AS (SELECT "user", avg(abs(z)) FILTER (day BETWEEN attack_start::DATE AND attack_end::DATE) AS attack, avg(abs(z)) FILTER (day < attack_start::DATE) AS pre,
             max(abs(z)) FILTER (day BETWEEN attack_start::DATE AND attack_end::DATE) AS max_attack FROM z JOIN insiders ON user_id = "user" GROUP BY "user")
SELECT "user", round(attack, 5) AS attack, round(pre, 5) AS pre, round(max_attack, 5) AS max_attack, round(attack / nullif(pre, 0), 5) AS lift, attack > 2.0 AS passed FROM g WHERE attack IS NOT NULL""",
)
_register(
    "deviation_summary",
    lambda s, d: bootstrap_z(s, d).groupBy("feature").agg(F.round(F.avg(F.abs("z")), 5).alias("mean_abs_z"), F.countDistinct("user").alias("users")),
    f"{WITH},\n{Z_SQL}\nSELECT feature, round(avg(abs(z)), 5) AS mean_abs_z, count(DISTINCT \"user\") AS users FROM z GROUP BY feature",
)

WINDOWS_SQL = f"""
days AS (SELECT "user", day, row_number() OVER (PARTITION BY "user" ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY "user") AS n FROM (SELECT DISTINCT "user", day FROM features)),
starts AS (SELECT DISTINCT "user", unnest(range(0, n - {WINDOWS.size} + 1, {WINDOWS.stride})) AS start FROM days WHERE n >= {WINDOWS.size}),
wrows AS (SELECT "user", day, start, rn - start AS idx FROM days JOIN starts USING ("user") WHERE rn >= start AND rn < start + {WINDOWS.size}),
ovl AS (
  SELECT w."user", start, min(day) AS window_start, max(day) AS window_end, avg(CASE WHEN day BETWEEN attack_start::DATE AND attack_end::DATE THEN 1 ELSE 0 END) AS overlap, max(scenario) AS sc
  FROM wrows w LEFT JOIN insiders ON user_id = w."user" GROUP BY w."user", start
),
labelled AS (
  SELECT "user", start, window_start, window_end, overlap, CASE WHEN overlap >= 0.5 THEN 1 ELSE 0 END AS label, CASE WHEN overlap >= 0.5 THEN sc ELSE 0 END AS scenario
  FROM ovl WHERE overlap >= 0.5 OR overlap = 0
)"""


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows_of(features(spark, sf_dir))


def _windows_of(f: DataFrame) -> DataFrame:
    return W.window_rows(f.select("user", "day"), WINDOWS)


def labelled_windows(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    return W.label_windows(day_windows(spark, sf_dir) if f is None else _windows_of(f), V.insiders(spark, sf_dir), WINDOWS)


def z_windows(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """(user, start, idx, feature, z): the windows are cut once per day, and meet the deviations by (user, day).

    Both come from the same features, written once.
    """
    f = written(features(spark, sf_dir)) if f is None else f
    return bootstrap_z(spark, sf_dir, f).join(_windows_of(f), ["user", "day"])


_register(
    "sliding_windows",
    lambda s, d: labelled_windows(s, d).withColumn("overlap", F.round("overlap", 6)),
    f"{WITH},\n{_FEATURES_SQL},\n{WINDOWS_SQL}\nSELECT \"user\", start::INT AS start, window_start, window_end, round(overlap, 6) AS overlap, label, scenario FROM labelled",
)
ZW_SQL = f'{Z_SQL},\n{WINDOWS_SQL},\nzw AS (SELECT w."user", w.start, w.idx, z.day, feature, z FROM wrows w JOIN z ON z."user" = w."user" AND z.day = w.day)'
_BURST_SQL = """
islands AS (SELECT "user", start, feature, abs(z) AS a, idx - row_number() OVER (PARTITION BY "user", start, feature ORDER BY idx) AS island FROM zw WHERE abs(z) > 2),
bursts AS (SELECT "user", start, feature, max(s) AS max_burst FROM (SELECT "user", start, feature, island, sum(a) AS s FROM islands GROUP BY ALL) GROUP BY "user", start, feature)"""
_register("max_burst", lambda s, d: W.max_bursts(z_windows(s, d)).withColumn("max_burst", F.round("max_burst", 4)), f"{WITH},\n{ZW_SQL},\n{_BURST_SQL}\nSELECT \"user\", start::INT AS start, feature, round(max_burst, 4) AS max_burst FROM bursts")
_register(
    "window_stats",
    lambda s, d: W.window_statistics(written(z_windows(s, d))).select("user", "start", "feature", *[F.round(c, 4).alias(c) for c in ("max_dev", "mean_dev", "std_dev", "trend", "max_burst")], "days_2s", "days_3s"),
    f"""{WITH},\n{ZW_SQL},\n{_BURST_SQL},
st AS (SELECT "user", start, feature, max(abs(z)) AS max_dev, avg(abs(z)) AS mean_dev, stddev_pop(z) AS std_dev, coalesce(regr_slope(z, idx), 0) AS trend,
       count(*) FILTER (abs(z) > 2) AS days_2s, count(*) FILTER (abs(z) > 3) AS days_3s FROM zw GROUP BY ALL)
SELECT "user", start::INT AS start, feature, round(max_dev, 4) AS max_dev, round(mean_dev, 4) AS mean_dev, round(std_dev, 4) AS std_dev, round(trend, 4) AS trend,
       round(coalesce(max_burst, 0), 4) AS max_burst, days_2s, days_3s FROM st LEFT JOIN bursts USING ("user", start, feature)""",
)
_register(
    "cross_feature_stats",
    lambda s, d: W.cross_statistics(z_windows(s, d)).withColumn("mean_total", F.round("mean_total", 4)),
    f"""{WITH},\n{ZW_SQL},
pd AS (SELECT "user", start, idx, count(*) FILTER (abs(z) > 2) AS hits, sum(abs(z)) AS s, count(*) AS n FROM zw GROUP BY ALL)
SELECT "user", start::INT AS start, count(*) FILTER (hits > 0) AS anomalous_days, max(hits) AS max_features, round(sum(s) / sum(n), 4) AS mean_total FROM pd GROUP BY "user", start""",
)
_register(
    "supplier_windows",
    lambda s, d: W.window_rows(
        V.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("user"), F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity")), WindowConfig()
    ).groupBy("user", "start").agg(F.min("day").alias("window_start"), F.max("day").alias("window_end"), F.sum("n_lines").alias("n_lines"), F.round(F.sum("quantity"), 4).alias("quantity")),
    """WITH d AS (SELECT l_suppkey AS "user", l_shipdate::DATE AS day, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY "user") AS n FROM d),
s AS (SELECT DISTINCT "user", unnest(range(0, n - 27, 7)) AS start FROM r WHERE n >= 28)
SELECT "user", start::INT AS start, min(day) AS window_start, max(day) AS window_end, sum(n_lines)::BIGINT AS n_lines, round(sum(quantity), 4) AS quantity
FROM r JOIN s USING ("user") WHERE rn >= start AND rn < start + 28 GROUP BY "user", start""",
)
_magnitude = lambda s, d: B.daily_magnitude(bootstrap_z(s, d))
MAGNITUDE_SQL = 'mag AS (SELECT "user", day, avg(abs(z)) AS mean_abs_z, max(abs(z)) AS max_abs_z FROM z GROUP BY ALL)'
_register(
    "deviation_tail",
    lambda s, d: W.tail(_magnitude(s, d), 7).select("user", "day", F.round("mean_abs_z", 5).alias("mean_abs_z")),
    f"{WITH},\n{Z_SQL},\n{MAGNITUDE_SQL}\nSELECT \"user\", day, round(mean_abs_z, 5) AS mean_abs_z FROM mag QUALIFY row_number() OVER (PARTITION BY \"user\" ORDER BY day DESC) <= 7",
)
_register(
    "attention_weights",
    lambda s, d: W.attention(W.tail(_magnitude(s, d), 14)).select("user", "day", F.round("weight", 6).alias("weight")),
    f"""{WITH},\n{Z_SQL},\n{MAGNITUDE_SQL},
t AS (SELECT * FROM mag QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY day DESC) <= 14),
e AS (SELECT "user", day, exp(mean_abs_z - max(mean_abs_z) OVER (PARTITION BY "user")) AS e FROM t)
SELECT "user", day, round(e / sum(e) OVER (PARTITION BY "user"), 6) AS weight FROM e""",
)
_register(
    "graph_windows",
    lambda s, d: V.read(s, d, "events").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")).select(F.explode(W.calendar_windows(F.col("lo"), F.col("hi"), 14, 7)).alias("window_start")).withColumn("window_end", F.date_add("window_start", 13)),
    "WITH b AS (SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events) SELECT w::DATE AS window_start, (w + INTERVAL 13 DAY)::DATE AS window_end FROM (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 7 DAY)) AS w, hi FROM b) WHERE w + INTERVAL 13 DAY <= hi",
)
