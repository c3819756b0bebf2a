"""Graph nodes and edges, over all of the log and by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.operators import graph as G
from behaviorlens.plans import daily_queries as DQ
from behaviorlens.plans import testviews as V

QUERIES, ORACLES = {}, {}
#: Windows of the test tables: 14 days every 7, from the first day to the last.
WINDOWS = {"first": "2024-01-01", "last": "2024-01-30", "size": 14, "stride": 7}
PRIOR = 60


def _register(name: str, query, keys: tuple[str, ...], columns: tuple[str, ...], sql: str) -> None:
    """A query whose measures are rounded alike on both sides; `sql` selects keys and measures by name."""

    def run(spark, sf_dir) -> DataFrame:
        return query(V.logs(spark, sf_dir)).select(*keys, *[F.round(F.col(c).cast("double"), 5).alias(c) for c in columns])

    QUERIES[name] = run
    names = ", ".join([*(f'"{k}"' for k in keys), *(f"round({c}::DOUBLE, 5) AS {c}" for c in columns)])
    ORACLES[name] = f"{DQ.WITH}{sql.replace('SELECT *OUT*', f'SELECT {names}')}"


_A = "(hour(date) < 7 OR hour(date) >= 19)::INT"
_W = "(isodow(date) >= 6)::INT"
_DOM = "lower(coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ''), url))"
_REM = "lower(trim(coalesce(to_removable_media, ''))) = 'true'"
_EXT = "len(list_filter(string_split(\"to\", ';'), lambda x: NOT contains(x, 'dtaa.com'))) > 0"
_TYPE = "CASE regexp_extract(lower(filename), '(\\.[^./]+)$', 1) WHEN '.doc' THEN 1 WHEN '.pdf' THEN 2 WHEN '.exe' THEN 3 WHEN '.zip' THEN 4 ELSE 0 END"
_WORDS = "(" + " + ".join(f"contains(lower(coalesce(content, '')), '{w}')::INT" for w in C.CONTENT_WORDS) + ")"


def _daily(name: str, source: str, key: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT {key}, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS sd, count(*) AS days, sum(n) AS total FROM (SELECT {key}, date::DATE AS d, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL) GROUP BY {key})"


_ALL = " UNION ALL ".join(f'SELECT "user", date FROM {k}' for k in ("logon", "device", "file", "email", "http"))
_register(
    "user_nodes",
    G.user_nodes,
    ("user",),
    G.USER_COLUMNS,
    f""",
allev AS ({_ALL}), roster AS (SELECT DISTINCT "user" FROM allev), act AS (SELECT "user", count(DISTINCT date::DATE) AS active_days FROM allev GROUP BY 1),
{_daily('dl', 'logon', '"user"', "lower(activity) = 'logon'")}, {_daily('dd', 'device', '"user"', "lower(activity) = 'connect'")}, {_daily('de', 'email', '"user"')}, {_daily('dh', 'http', '"user"')}, {_daily('df', 'file', '"user"', _REM)},
lg AS (SELECT "user", count(DISTINCT pc) AS pcs, avg({_A}) AS a, avg({_W}) AS w FROM logon WHERE lower(activity) = 'logon' GROUP BY 1),
em AS (SELECT "user", avg(coalesce(size, 0)) AS size, avg(coalesce(({_EXT})::INT, 0)) AS ext FROM email GROUP BY 1),
ht AS (SELECT "user", avg(regexp_matches(lower(url), 'job|career|linkedin|indeed')::INT) AS j, avg(regexp_matches(lower(url), 'dropbox|wikileaks|pastebin')::INT) AS c FROM http GROUP BY 1),
o AS (SELECT roster."user", coalesce(dl.mean, 0) AS mean_daily_logons, coalesce(dl.sd, 0) AS std_daily_logons, coalesce(pcs, 0) AS total_unique_pcs, coalesce(a, 0) AS after_hours_logon_ratio, coalesce(w, 0) AS weekend_logon_ratio,
  coalesce(dd.mean, 0) AS mean_daily_usb, coalesce(dd.days, 0) AS total_usb_days, coalesce(de.mean, 0) AS mean_daily_emails_sent, coalesce(em.size, 0) AS mean_email_size, coalesce(ext, 0) AS external_email_ratio,
  coalesce(dh.mean, 0) AS mean_daily_http, coalesce(j, 0) AS job_search_ratio, coalesce(c, 0) AS cloud_upload_ratio, coalesce(df.mean, 0) AS mean_daily_file_copies, coalesce(df.total, 0) AS total_file_copies, active_days
  FROM roster LEFT JOIN dl USING ("user") LEFT JOIN dd USING ("user") LEFT JOIN de USING ("user") LEFT JOIN dh USING ("user") LEFT JOIN df USING ("user") LEFT JOIN lg USING ("user") LEFT JOIN em USING ("user") LEFT JOIN ht USING ("user") LEFT JOIN act USING ("user"))
SELECT *OUT* FROM o""",
)
_register(
    "pc_nodes",
    G.pc_nodes,
    ("pc",),
    G.PC_COLUMNS,
    f""",
l AS (SELECT * FROM logon WHERE lower(activity) = 'logon'), c AS (SELECT * FROM device WHERE lower(activity) = 'connect'), {_daily('dl', 'l', 'pc')},
k AS (SELECT pc FROM logon UNION SELECT pc FROM device), dy AS (SELECT pc, count(DISTINCT d) AS days FROM (SELECT pc, date::DATE AS d FROM l UNION SELECT pc, date::DATE FROM c) GROUP BY pc),
a AS (SELECT pc, count(DISTINCT "user") AS users, count(*) AS n, avg({_A}) AS a, avg({_W}) AS w FROM l GROUP BY pc), u AS (SELECT pc, count(*) AS n FROM c GROUP BY pc),
o AS (SELECT pc, coalesce(users, 0) AS num_distinct_users, coalesce(a.n, 0) AS total_logon_events, (coalesce(users, 0) > 5)::INT AS is_shared, coalesce(a, 0) AS after_hours_usage_ratio, coalesce(u.n, 0) AS usb_event_count,
  coalesce(dl.mean, 0) AS mean_session_count, coalesce(w, 0) AS weekend_usage_ratio, coalesce(dy.days, 0) AS unique_days_active FROM k LEFT JOIN a USING (pc) LEFT JOIN u USING (pc) LEFT JOIN dl USING (pc) LEFT JOIN dy USING (pc))
SELECT *OUT* FROM o""",
)
_register(
    "url_nodes",
    lambda x: G.url_nodes(x["http"]),
    ("domain",),
    G.URL_COLUMNS,
    f""",
h AS (SELECT *, {_DOM} AS domain FROM http), {_daily('dd', 'h', 'domain')}, pu AS (SELECT domain, count(*) AS visitors, max(n) / sum(n)::DOUBLE AS conc FROM (SELECT domain, "user", count(*) AS n FROM h GROUP BY ALL) GROUP BY domain),
o AS (SELECT domain, count(*) AS total_visits, any_value(visitors) AS unique_visitors, regexp_matches(domain, 'job|career|linkedin|indeed')::INT AS is_job_related, regexp_matches(domain, 'dropbox|wikileaks|pastebin')::INT AS is_cloud_related,
  any_value(mean) AS mean_daily_visits, any_value(conc) AS visitor_concentration, avg({_W}) AS weekend_visit_ratio, avg({_A}) AS after_hours_visit_ratio FROM h JOIN pu USING (domain) JOIN dd USING (domain) GROUP BY domain)
SELECT *OUT* FROM o""",
)
_register(
    "file_nodes",
    lambda x: G.file_nodes(x["file"]),
    ("filename",),
    G.FILE_COLUMNS,
    f""",
o AS (SELECT filename, count(*) FILTER ({_REM}) AS total_copies, count(DISTINCT "user") FILTER ({_REM}) AS unique_users, any_value({_TYPE}) AS file_type_code, coalesce(avg(hour(date)) FILTER ({_REM}), 0) AS avg_copy_hour,
  coalesce(avg({_A}) FILTER ({_REM}), 0) AS is_after_hours_copy, sum({_WORDS}) AS content_topic_count FROM file GROUP BY filename)
SELECT *OUT* FROM o""",
)
_TIME = f"hour(date) / 24.0::DOUBLE AS hour, {_W} AS is_weekend, {_A} AS is_after_hours"
_TC = ("hour", "is_weekend", "is_after_hours")
_register("logon_edges", lambda x: G.logon_edges(x["logon"]), ("src", "dst"), (*_TC, "dow"), f", o AS (SELECT \"user\" AS src, pc AS dst, {_TIME}, (isodow(date) - 1) / 7.0::DOUBLE AS dow FROM logon WHERE lower(activity) = 'logon') SELECT *OUT* FROM o")
_register("usb_edges", lambda x: G.usb_edges(x["device"]), ("src", "dst"), _TC, f", o AS (SELECT \"user\" AS src, pc AS dst, {_TIME} FROM device WHERE lower(activity) = 'connect') SELECT *OUT* FROM o")
_register("file_edges", lambda x: G.file_edges(x["file"]), ("src", "dst"), (*_TC, "file_type_code"), f', o AS (SELECT "user" AS src, filename AS dst, {_TIME}, {_TYPE} AS file_type_code FROM file WHERE {_REM}) SELECT *OUT* FROM o')
_register("http_edges", lambda x: G.http_edges(x["http"]), ("src", "dst"), _TC, f', o AS (SELECT "user" AS src, {_DOM} AS dst, avg(hour(date)) / 24 AS hour, avg({_W}) AS is_weekend, avg({_A}) AS is_after_hours FROM http GROUP BY ALL) SELECT *OUT* FROM o')
_ADDR = "concat_ws(';', \"to\", cc, bcc)"
_EMAIL = f"""
mail AS (SELECT "user" AS src, lower(trim(unnest(string_split({_ADDR}, ';')))) AS addr, coalesce(size, 0) AS size, least(greatest(coalesce(try_cast(attachments AS DOUBLE), 0), 0), 10) AS att, date,
  (len(list_filter(string_split({_ADDR}, ';'), lambda x: contains(x, '@') AND NOT contains(x, 'dtaa.com'))) > 0)::INT AS ext FROM email),
pairs AS (SELECT *, string_split(addr, '@')[1] AS dst FROM mail WHERE ends_with(addr, '@dtaa.com') AND string_split(addr, '@')[1] <> src)"""
_register(
    "email_edges",
    lambda x: G.email_edges(x["email"], x["logon"].select("user")),
    ("src", "dst"),
    ("size_mb", "attachments", "is_external", "hour", "is_after_hours"),
    f",{_EMAIL},\no AS (SELECT src, dst, size / 1e6 AS size_mb, att / 10 AS attachments, ext AS is_external, hour(date) / 24.0::DOUBLE AS hour, {_A} AS is_after_hours FROM pairs WHERE dst IN (SELECT \"user\" FROM logon)) SELECT *OUT* FROM o",
)
_register("active_days", G.active_days, ("user",), ("active_days",), f', a AS ({_ALL}), o AS (SELECT "user", count(DISTINCT date::DATE) AS active_days FROM a GROUP BY 1) SELECT *OUT* FROM o')
_register(
    "exclude_users",
    lambda x: G.excluding({"http": x["http"]}, x["device"].where("pc = 'PC-1'"))["http"].groupBy("user").agg(F.count("*").alias("n")),
    ("user",),
    ("n",),
    ", o AS (SELECT \"user\", count(*) AS n FROM http h WHERE NOT EXISTS (SELECT 1 FROM device d WHERE d.\"user\" = h.\"user\" AND pc = 'PC-1') GROUP BY 1) SELECT *OUT* FROM o",
)
_register(
    "topk_domains_keep_flagged",
    lambda x: G.top_keys(G.derived(x["http"], "http"), "_domain", 3, F.col("_domain").rlike("refog|softactivity|keylogger")).withColumnRenamed("_domain", "domain"),
    ("domain",),
    ("n",),
    f", c AS (SELECT {_DOM} AS domain, count(*) AS n FROM http GROUP BY 1), o AS (SELECT * FROM c QUALIFY row_number() OVER (ORDER BY n DESC, domain) <= 3 OR regexp_matches(domain, 'refog|softactivity|keylogger')) SELECT *OUT* FROM o",
)
_register(
    "ego_network",
    lambda x: G.ego_networks(x).withColumn("colour", F.coalesce("colour", F.lit("none"))),
    ("user", "kind", "dst", "colour"),
    ("weight",),
    f""",
col AS (SELECT "user", 'pc' AS kind, pc AS dst, count(*) AS weight, avg({_A}) AS a FROM logon GROUP BY "user", pc UNION ALL SELECT "user", 'url', {_DOM}, count(*), avg({_A}) FROM http GROUP BY 1, 3
  UNION ALL SELECT "user", 'user', string_split(addr, '@')[1], 1, NULL FROM (SELECT "user", lower(trim(unnest(string_split({_ADDR}, ';')))) AS addr FROM email) WHERE ends_with(addr, '@dtaa.com')),
o AS (SELECT "user", kind, dst, weight, CASE WHEN a IS NULL THEN 'none' WHEN a < 0.34 THEN 'green' WHEN a < 0.67 THEN 'amber' ELSE 'red' END AS colour FROM col) SELECT *OUT* FROM o""",
)

_WIN = "wins AS (SELECT (DATE '2024-01-01' + 7 * i::INT)::DATE AS ws FROM range(0, 3) t(i))"


def _win(kind: str, where: str = "TRUE", extra: str = "") -> str:
    return f"w_{kind} AS (SELECT ws AS window_start, {kind}.*, date::DATE AS d{extra} FROM {kind} JOIN wins ON date >= ws AND date <= ws + 13 WHERE {where})"


def _novel(keys: str, source: str) -> str:
    on = " AND ".join(f"p.{k} = g.{k}" for k in keys.split(", "))
    return f"CASE WHEN EXISTS (SELECT 1 FROM {source} p WHERE {on} AND p.date < g.window_start AND p.date >= g.window_start - {PRIOR}) THEN 0 ELSE 1 END"


def _burst(kind: str, keys: str) -> str:
    return f"bm AS (SELECT window_start, {keys}, max(n) AS max_day FROM (SELECT window_start, {keys}, d, count(*) AS n FROM w_{kind} GROUP BY ALL) GROUP BY ALL)"


_register(
    "win_pc_nodes",
    lambda x: G.window_pc_nodes(x, WINDOWS),
    ("window_start", "pc"),
    ("num_users", "frac_after", "is_shared", "total_logons", "total_usb", "weekend_ratio", "mean_hour", "std_hour"),
    f""", {_WIN}, {_win('logon')}, {_win('device')},
b AS (SELECT window_start, "user", pc, date, (lower(activity) = 'logon')::INT AS lg, 0 AS us FROM w_logon UNION ALL SELECT window_start, "user", pc, date, 0, (lower(activity) = 'connect')::INT FROM w_device),
o AS (SELECT window_start, pc, count(DISTINCT "user") AS num_users, avg({_A}) AS frac_after, (count(DISTINCT "user") > 1)::INT AS is_shared, sum(lg) AS total_logons, sum(us) AS total_usb, avg({_W}) AS weekend_ratio, avg(hour(date)) AS mean_hour, coalesce(stddev_samp(hour(date)), 0) AS std_hour FROM b GROUP BY ALL)
SELECT *OUT* FROM o""",
)
_register(
    "win_url_nodes",
    lambda x: G.window_url_nodes(x["http"], WINDOWS),
    ("window_start", "domain"),
    ("n", "visitors", "is_job", "is_cloud", "is_keylogger", "frac_after", "mean_hour", "concentration"),
    f""", {_WIN}, {_win('http', extra=f', {_DOM} AS domain')}, pu AS (SELECT window_start, domain, count(*) AS visitors, max(n) / sum(n)::DOUBLE AS concentration FROM (SELECT window_start, domain, "user", count(*) AS n FROM w_http GROUP BY ALL) GROUP BY ALL),
g AS (SELECT window_start, domain, count(*) AS n, avg({_A}) AS frac_after, avg(hour(date)) AS mean_hour FROM w_http GROUP BY ALL),
o AS (SELECT *, regexp_matches(domain, 'monster\\.com|careerbuilder\\.com|craigslist\\.org|jobhuntersbible\\.com|job|career|linkedin|indeed')::INT AS is_job, regexp_matches(domain, 'wikileaks\\.org|dropbox')::INT AS is_cloud,
  regexp_matches(domain, 'refog\\.com|softactivity\\.com|keylogger')::INT AS is_keylogger FROM g JOIN pu USING (window_start, domain))
SELECT *OUT* FROM o""",
)
_register(
    "win_file_nodes",
    lambda x: G.window_file_nodes(x["file"], WINDOWS),
    ("window_start", "filename"),
    ("n", "copiers", "is_decoy", "to_removable", "frac_after", "is_new"),
    f""", {_WIN}, {_win('file')}, g AS (SELECT window_start, filename, count(*) AS n, count(DISTINCT "user") AS copiers, 0 AS is_decoy, count(*) FILTER ({_REM}) AS to_removable, avg({_A}) AS frac_after FROM w_file GROUP BY ALL),
o AS (SELECT *, {_novel('filename', 'file')} AS is_new FROM g) SELECT *OUT* FROM o""",
)
_K = '"user", pc'
_register(
    "win_logon_edges",
    lambda x: G.window_logon_edges(x["logon"], WINDOWS),
    ("window_start", "user", "pc"),
    ("n", "frac_after", "frac_weekend", "mean_hour", "max_day"),
    f""", {_WIN}, {_win('logon', "lower(activity) = 'logon'")}, {_burst('logon', _K)},
g AS (SELECT window_start, {_K}, count(*) AS n, avg({_A}) AS frac_after, avg({_W}) AS frac_weekend, avg(hour(date)) AS mean_hour FROM w_logon GROUP BY ALL), o AS (SELECT * FROM g JOIN bm USING (window_start, {_K})) SELECT *OUT* FROM o""",
)
_register(
    "win_usb_edges_novelty",
    lambda x: G.window_usb_edges(x, WINDOWS),
    ("window_start", "user", "pc"),
    ("n", "frac_after", "max_day", "is_new_pc"),
    f""", {_WIN}, {_win('device', "lower(activity) = 'connect'")}, {_burst('device', _K)}, both_logs AS (SELECT {_K}, date FROM logon UNION ALL SELECT {_K}, date FROM device),
g AS (SELECT window_start, {_K}, count(*) AS n, avg({_A}) AS frac_after FROM w_device GROUP BY ALL), o AS (SELECT g.*, max_day, {_novel(_K, 'both_logs')} AS is_new_pc FROM g JOIN bm USING (window_start, {_K})) SELECT *OUT* FROM o""",
)
_register(
    "win_email_edges",
    lambda x: G.window_email_edges(x["email"], WINDOWS),
    ("window_start", "src", "dst"),
    ("n", "mean_size", "max_attachments", "frac_after", "is_external"),
    f""", {_WIN},{_EMAIL}, o AS (SELECT ws AS window_start, src, dst, count(*) AS n, avg(size) AS mean_size, max(att) AS max_attachments, avg({_A}) AS frac_after, avg(ext) AS is_external FROM pairs JOIN wins ON date >= ws AND date <= ws + 13 GROUP BY ALL) SELECT *OUT* FROM o""",
)
_register(
    "win_http_edges",
    lambda x: G.window_http_edges(x["http"], WINDOWS),
    ("window_start", "user", "domain"),
    ("n", "frac_after", "is_new_domain", "concentration"),
    f""", {_WIN}, hh AS (SELECT *, {_DOM} AS domain FROM http), {_win('http', extra=f', {_DOM} AS domain')}, {_burst('http', '"user", domain')},
g AS (SELECT window_start, "user", domain, count(*) AS n, avg({_A}) AS frac_after FROM w_http GROUP BY ALL),
o AS (SELECT g.*, max_day / n::DOUBLE AS concentration, {_novel('"user", domain', 'hh')} AS is_new_domain FROM g JOIN bm USING (window_start, "user", domain)) SELECT *OUT* FROM o""",
)
_register(
    "win_file_edges",
    lambda x: G.window_file_edges(x["file"], WINDOWS),
    ("window_start", "user", "filename"),
    ("n", "frac_after", "frac_removable", "is_new_file"),
    f""", {_WIN}, {_win('file')}, g AS (SELECT window_start, "user", filename, count(*) AS n, avg({_A}) AS frac_after, avg(({_REM})::INT) AS frac_removable FROM w_file GROUP BY ALL),
o AS (SELECT *, {_novel('"user", filename', 'file')} AS is_new_file FROM g) SELECT *OUT* FROM o""",
)
QUERIES["node_ids"] = lambda s, d: G.dense_ids(V.logs(s, d)["http"], "user")
ORACLES["node_ids"] = f'{DQ.WITH}, u AS (SELECT DISTINCT "user" FROM http) SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS idx FROM u'
QUERIES["known_edges"] = lambda s, d: G.known_edges(G.usb_edges(V.logs(s, d)["device"]), V.logs(s, d)["http"].select("user"), V.logs(s, d)["logon"].select("pc")).groupBy("src").agg(F.count("*").alias("n"))
ORACLES["known_edges"] = f"{DQ.WITH} SELECT \"user\" AS src, count(*) AS n FROM device WHERE lower(activity) = 'connect' AND \"user\" IN (SELECT \"user\" FROM http) AND pc IN (SELECT pc FROM logon) GROUP BY 1"
