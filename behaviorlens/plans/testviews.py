"""The five activity logs and their dimensions, derived from the star-schema test tables.

Spark and the SQL twins derive them from the same expressions, kept side by side here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Plain SQL that both engines read alike; k is the number in an event's properties.
_LOG_SQL = {
    "logon": ("signup", "concat('PC-', k % 7) AS pc, CASE WHEN k % 2 = 0 THEN 'Logon' ELSE 'Logoff' END AS activity"),
    "device": ("error", "concat('PC-', k % 7) AS pc, CASE WHEN k % 3 = 0 THEN 'Disconnect' ELSE 'Connect' END AS activity"),
    "file": (
        "view",
        "concat('PC-', k % 7) AS pc, concat('f', k % 20, CASE k % 4 WHEN 0 THEN '.doc' WHEN 1 THEN '.pdf' WHEN 2 THEN '.exe' ELSE '.zip' END) AS filename, "
        "CASE WHEN k % 2 = 1 THEN 'True' ELSE 'False' END AS to_removable_media, "
        "CASE k % 5 WHEN 0 THEN 'Job offer and SALARY' WHEN 1 THEN 'confidential resume' WHEN 2 THEN NULL ELSE 'notes' END AS content",
    ),
    "email": (
        "purchase",
        "concat('PC-', k % 7) AS pc, value * 20000 AS size, cast(k % 12 AS varchar(9)) AS attachments, concat('u', user_id, '@dtaa.com') AS \"from\", "
        "CASE k % 4 WHEN 0 THEN concat('u', user_id + k % 9, '@dtaa.com') WHEN 1 THEN concat('x', k, '@gmail.com') "
        "WHEN 2 THEN concat('U', user_id + 3, '@DTAA.com;y', k, '@mail.org; u', user_id + 2, '@dtaa.com') ELSE NULL END AS \"to\", "
        "CASE WHEN k % 5 = 0 THEN concat('u', user_id + 1, '@dtaa.com') ELSE NULL END AS cc, cast(NULL AS varchar(9)) AS bcc",
    ),
    "http": (
        "click",
        "concat('PC-', k % 7) AS pc, CASE k % 7 WHEN 0 THEN 'http://monster.com/jobs' WHEN 1 THEN 'http://dropbox.com/u' WHEN 2 THEN 'http://LinkedIn.com/in' "
        "WHEN 3 THEN 'https://refog.com:8080/k?x=1' ELSE concat('http://news', k % 9, '.com/x') END AS url",
    ),
}
_BASE = "concat('u', user_id) AS \"user\", cast(event_id AS varchar(20)) AS id, ts AS date"
_K = "cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS int)"

_INSIDERS = (
    "SELECT DISTINCT concat('u', user_id) AS user_id, cast(1 + user_id % 5 AS int) AS scenario, "
    "{start} AS attack_start, {end} AS attack_end FROM events WHERE user_id % 4 = 1"
)
_LDAP = (
    "SELECT concat('u', c_custkey) AS user_id, c_name AS employee_name, c_mktsegment AS role, r_name AS department, concat('u', c_custkey, '@dtaa.com') AS email "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
_PERSONALITY = "SELECT concat('u', c_custkey) AS user_id, " + ", ".join(f"cast(c_custkey * {m} % 50 AS int) AS {n}" for n, m in zip("OCEAN", (7, 11, 13, 17, 19))) + " FROM customer"


def logs_sql() -> str:
    """Common table expressions for DuckDB: ev, the five logs, insiders, ldap, ocean."""
    parts = [f"ev AS (SELECT *, {_K} AS k FROM events)"]
    parts += [f"{name} AS (SELECT {_BASE}, {columns} FROM ev WHERE event_type = '{kind}')" for name, (kind, columns) in _LOG_SQL.items()]
    start = "TIMESTAMP '2024-01-08' + to_days(cast(user_id % 5 AS int))"
    parts.append("insiders AS (" + _INSIDERS.format(start=start, end=f"{start} + INTERVAL 9 DAY") + ")")
    parts += [f"ldap AS ({_LDAP})", f"ocean AS ({_PERSONALITY})"]
    return ",\n".join(parts)


def _spark(sql: str) -> str:
    return sql.replace('"', "`").replace("varchar(9)", "string").replace("varchar(20)", "string")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(read(spark, sf_dir, "events"))


def numbered(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int"))


def logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return logs_of(events(spark, sf_dir))


def logs_of(ev: DataFrame) -> dict[str, DataFrame]:
    """The five logs of numbered events."""
    spark = ev.sparkSession
    return {name: spark.sql(f"SELECT {_spark(_BASE)}, {_spark(columns)} FROM {{ev}} WHERE event_type = '{kind}'", ev=ev) for name, (kind, columns) in _LOG_SQL.items()}


def insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "timestamp_ntz'2024-01-08' + make_dt_interval(cast(user_id % 5 AS int))"
    sql = _INSIDERS.format(start=start, end=f"{start} + make_dt_interval(9)").replace("FROM events", "FROM {ev}")
    return spark.sql(sql, ev=read(spark, sf_dir, "events"))


def ldap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _LDAP
    for t in ("customer", "nation", "region"):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in ("customer", "nation", "region")})


def ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PERSONALITY.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer"))
