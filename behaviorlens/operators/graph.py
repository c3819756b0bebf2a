"""Heterogeneous graphs of users, machines, domains and files.

Nodes and edges are tables keyed by their natural keys. The windowed builders work on all windows
at once: each event goes to the few calendar windows that hold it, so there is no range join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.functions import predicates as P
from behaviorlens.sources.store import written

RECIPIENTS = ("to", "cc", "bcc")


def derived(log: DataFrame, kind: str) -> DataFrame:
    """A log with _hour, _after, _weekend, _day, and _domain or _torem where it has them."""
    ts = F.col("date")
    log = log.withColumns({"_hour": F.hour(ts), "_after": P.after_hours(ts).cast("int"), "_weekend": P.weekend(ts).cast("int"), "_day": F.to_date(ts)})
    if kind == "http":
        log = log.withColumn("_domain", P.domain_of(F.col("url")))
    if kind == "file":
        log = log.withColumn("_torem", P.removable(F.col("to_removable_media"), ("true", "1")) if "to_removable_media" in log.columns else F.lit(True))
    return log


def _joined(nodes: DataFrame, key: str, blocks: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    out = reduce(lambda a, b: a.join(b, key, "left"), blocks, nodes)
    return out.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def _per_day(rows: DataFrame, key: str, name: str, spread: str | None = None, days: str | None = None, total: str | None = None) -> DataFrame:
    """Mean events per active day of each key, and what else is asked for of the daily counts."""
    daily = rows.groupBy(key, "_day").agg(F.count("*").alias("n"))
    more = [F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias(spread)] if spread else []
    more += [F.count("*").alias(days)] if days else []
    more += [F.sum("n").alias(total)] if total else []
    return daily.groupBy(key).agg(F.avg("n").alias(name), *more)


USER_COLUMNS = (
    "mean_daily_logons", "std_daily_logons", "total_unique_pcs", "after_hours_logon_ratio", "weekend_logon_ratio", "mean_daily_usb", "total_usb_days", "mean_daily_emails_sent",
    "mean_email_size", "external_email_ratio", "mean_daily_http", "job_search_ratio", "cloud_upload_ratio", "mean_daily_file_copies", "total_file_copies", "active_days",
)


def active_days(logs: dict[str, DataFrame]) -> DataFrame:
    """(user, active_days): distinct days with any event."""
    days = [x.where(F.col("user").isNotNull()).select("user", F.to_date("date").alias("d")) for x in logs.values()]
    return reduce(DataFrame.unionByName, days).distinct().groupBy("user").agg(F.count("*").alias("active_days"))


def user_nodes(logs: dict[str, DataFrame]) -> DataFrame:
    d = {k: derived(x, k).where(F.col("user").isNotNull()) for k, x in logs.items()}
    logons = d["logon"].where(P.activity_is(F.col("activity"), "logon"))
    flag = lambda c: F.avg(c.cast("int"))
    blocks = [
        _per_day(logons, "user", "mean_daily_logons", "std_daily_logons"),
        logons.groupBy("user").agg(F.countDistinct("pc").alias("total_unique_pcs"), F.avg("_after").alias("after_hours_logon_ratio"), F.avg("_weekend").alias("weekend_logon_ratio")),
        _per_day(d["device"].where(P.activity_is(F.col("activity"), "connect")), "user", "mean_daily_usb", days="total_usb_days"),
        _per_day(d["email"], "user", "mean_daily_emails_sent"),
        d["email"].groupBy("user").agg(F.avg(P.number(F.col("size"))).alias("mean_email_size"), flag(P.has_external(F.col("to"))).alias("external_email_ratio")),
        _per_day(d["http"], "user", "mean_daily_http"),
        d["http"].groupBy("user").agg(flag(P.any_word(F.col("url"), C.JOB_WORDS)).alias("job_search_ratio"), flag(P.any_word(F.col("url"), C.CLOUD_WORDS)).alias("cloud_upload_ratio")),
        _per_day(d["file"].where(P.removable(F.col("to_removable_media"))), "user", "mean_daily_file_copies", total="total_file_copies"),
        active_days(logs),
    ]
    roster = reduce(DataFrame.unionByName, [x.select("user") for x in d.values()]).distinct()
    return _joined(roster, "user", blocks, USER_COLUMNS)


PC_COLUMNS = ("num_distinct_users", "total_logon_events", "is_shared", "after_hours_usage_ratio", "usb_event_count", "mean_session_count", "weekend_usage_ratio", "unique_days_active")


def pc_nodes(logs: dict[str, DataFrame], shared_over: int = 5) -> DataFrame:
    d = {k: derived(logs[k], k).where(F.col("pc").isNotNull()) for k in ("logon", "device")}
    logons = d["logon"].where(P.activity_is(F.col("activity"), "logon"))
    connects = d["device"].where(P.activity_is(F.col("activity"), "connect"))
    days = logons.select("pc", "_day").union(connects.select("pc", "_day")).distinct()
    blocks = [
        logons.groupBy("pc").agg(F.countDistinct("user").alias("num_distinct_users"), F.count("*").alias("total_logon_events"), F.avg("_after").alias("after_hours_usage_ratio"), F.avg("_weekend").alias("weekend_usage_ratio")).withColumn("is_shared", F.col("num_distinct_users") > shared_over),
        connects.groupBy("pc").agg(F.count("*").alias("usb_event_count")),
        _per_day(logons, "pc", "mean_session_count"),
        days.groupBy("pc").agg(F.count("*").alias("unique_days_active")),
    ]
    return _joined(d["logon"].select("pc").union(d["device"].select("pc")).distinct(), "pc", blocks, PC_COLUMNS)


URL_COLUMNS = ("total_visits", "unique_visitors", "is_job_related", "is_cloud_related", "mean_daily_visits", "visitor_concentration", "weekend_visit_ratio", "after_hours_visit_ratio")


def url_nodes(http: DataFrame) -> DataFrame:
    d = derived(http, "http").where(F.col("_domain").isNotNull())
    by_user = d.groupBy("_domain", "user").agg(F.count("*").alias("n"))
    domain = F.col("_domain")
    blocks = [
        d.groupBy("_domain").agg(F.count("*").alias("total_visits"), F.avg("_weekend").alias("weekend_visit_ratio"), F.avg("_after").alias("after_hours_visit_ratio")).withColumns({"is_job_related": P.any_word(domain, C.JOB_WORDS), "is_cloud_related": P.any_word(domain, C.CLOUD_WORDS)}),
        by_user.groupBy("_domain").agg(F.count("user").alias("unique_visitors"), (F.max("n") / F.sum("n")).alias("visitor_concentration")),
        _per_day(d, "_domain", "mean_daily_visits"),
    ]
    return _joined(d.select("_domain").distinct(), "_domain", blocks, URL_COLUMNS).withColumnRenamed("_domain", "domain")


FILE_COLUMNS = ("total_copies", "unique_users", "file_type_code", "avg_copy_hour", "is_after_hours_copy", "content_topic_count")


def file_nodes(files: DataFrame) -> DataFrame:
    d = derived(files, "file").where(F.col("filename").isNotNull())
    copies = d.where(P.removable(F.col("to_removable_media")))
    blocks = [
        copies.groupBy("filename").agg(F.count("*").alias("total_copies"), F.countDistinct("user").alias("unique_users"), F.avg("_hour").alias("avg_copy_hour"), F.avg("_after").alias("is_after_hours_copy")),
        d.groupBy("filename").agg(F.sum(P.content_words(F.col("content"))).alias("content_topic_count")).withColumn("file_type_code", P.file_type(F.col("filename"))),
    ]
    return _joined(d.select("filename").distinct(), "filename", blocks, FILE_COLUMNS)


def time_encoding(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts) / 24.0, "is_weekend": P.weekend(ts).cast("int"), "is_after_hours": P.after_hours(ts).cast("int"), "dow": F.weekday(ts) / 7.0}


def event_edges(log: DataFrame, source: str, target: str, keep: Column, **more: Column) -> DataFrame:
    """One edge per kept event: src, dst, its time encoding and what else is given."""
    return log.where(keep).select(F.col(source).alias("src"), F.col(target).alias("dst"), *[c.alias(n) for n, c in {**time_encoding(F.col("date")), **more}.items()])


def logon_edges(logon: DataFrame) -> DataFrame:
    return event_edges(logon, "user", "pc", P.activity_is(F.col("activity"), "logon"))


def usb_edges(device: DataFrame) -> DataFrame:
    return event_edges(device, "user", "pc", P.activity_is(F.col("activity"), "connect")).drop("dow")


def file_edges(files: DataFrame) -> DataFrame:
    return event_edges(files, "user", "filename", P.removable(F.col("to_removable_media")), file_type_code=P.file_type(F.col("filename"))).drop("dow")


def attachments() -> Column:
    """The number of attachments, from 0 to 10."""
    return F.least(F.greatest(P.number(F.col("attachments")), F.lit(0.0)), F.lit(10.0))


def email_edges(email: DataFrame, users: DataFrame) -> DataFrame:
    """One edge per internal address of a known user, repeats kept, none to oneself."""
    rows = email.withColumn("dst", F.explode(P.internal_recipients(*[F.col(c) for c in RECIPIENTS])))
    rows = rows.join(users.select(F.col("user").alias("dst")).distinct(), "dst").where(F.col("user") != F.col("dst"))
    return rows.select(
        F.col("user").alias("src"), "dst", (P.number(F.col("size")) / 1e6).alias("size_mb"), (attachments() / 10).alias("attachments"),
        P.external_thread(*[F.col(c) for c in RECIPIENTS]).cast("int").alias("is_external"), (F.hour("date") / 24.0).alias("hour"), P.after_hours(F.col("date")).cast("int").alias("is_after_hours"),
    )


def http_edges(http: DataFrame) -> DataFrame:
    d = derived(http, "http")
    return d.groupBy(F.col("user").alias("src"), F.col("_domain").alias("dst")).agg((F.avg("_hour") / 24.0).alias("hour"), F.avg("_weekend").alias("is_weekend"), F.avg("_after").alias("is_after_hours"))


def reverse(edges: DataFrame) -> DataFrame:
    """The same edges from their target to their source."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def known_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges both of whose ends are known nodes."""
    return edges.join(sources.select(sources.columns[0]).distinct().toDF("src"), "src", "left_semi").join(targets.select(targets.columns[0]).distinct().toDF("dst"), "dst", "left_semi")


def dense_ids(nodes: DataFrame, *keys: str) -> DataFrame:
    """(*keys, idx): places in key order, from 0. Partitions are numbered on their own and then shifted by the sizes before them.

    The ranges are drawn once and written, as both the numbers and the sizes read them.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.select(*keys).distinct().repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    ranged = written(ranged.withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.join(F.broadcast(before), "_p").select(*keys, (F.col("_b") + F.col("_i")).alias("idx"))  # one row per partition


def window_ids(nodes: DataFrame, key: str) -> DataFrame:
    """(window_start, key, idx): places within each window, from 0."""
    ids = written(dense_ids(nodes, "window_start", key))
    first = ids.groupBy("window_start").agg(F.min("idx").alias("_f"))
    return ids.join(F.broadcast(first), "window_start").select("window_start", key, (F.col("idx") - F.col("_f")).alias("idx"))  # one row per window


def numbered_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, observation: Observation | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The edges with the numbers of their ends as `src` and `dst`; those with an end that is no known node are dropped.

    `sources` and `targets` have (*by, key, idx). What is dropped is counted in the same pass:
    `observation` gets n_edges, n_skipped, and the least and largest numbers of the others.
    """
    s, t = sources.toDF(*by, "src", "_s"), targets.toDF(*by, "dst", "_t")
    joined = edges.join(s, [*by, "src"], "left").join(t, [*by, "dst"], "left")
    known = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    if observation is not None:
        ends = [f(F.when(known, F.col(c))).alias(f"{n}_{e}") for c, e in (("_s", "src"), ("_t", "dst")) for f, n in ((F.min, "min"), (F.max, "max"))]
        joined = joined.observe(observation, F.count(F.lit(1)).alias("n_edges"), F.count_if(~known).alias("n_skipped"), *ends)
    return joined.where(known).drop("src", "dst").withColumnsRenamed({"_s": "src", "_t": "dst"})


def in_windows(log: DataFrame, first: str, last: str, size: int = 28, stride: int = 7) -> DataFrame:
    """Each event once for every window [w, w + size - 1 days] whose midnights hold it; windows start at `first`.

    The last day counts with its midnight alone, as both ends are midnights.
    """
    offset = F.datediff(F.col("date"), F.lit(first).cast("date"))
    latest = F.floor(offset / stride)
    at_midnight = F.col("date") == F.date_trunc("day", F.col("date"))
    reach = F.when(at_midnight, size - 1).otherwise(size - 2)
    lowest = F.greatest(F.lit(0), F.ceil((offset - reach) / stride))
    highest = F.least(latest, F.floor(F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) - (size - 1)) / stride)
    starts = F.transform(F.sequence(lowest.cast("int"), F.floor(highest).cast("int")), lambda w: F.date_add(F.lit(first).cast("date"), w * stride))
    return log.where((offset >= 0) & (lowest <= F.floor(highest))).withColumn("window_start", F.explode(starts))


def with_burst(rows: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """Aggregates of each key with `max_day`, the most events on one day."""
    daily = rows.groupBy(*keys, "_day").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("max_day"))
    return rows.groupBy(*keys).agg(*columns).join(daily, keys)


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Days on which a key was seen: what novelty is judged by."""
    return rows.select(*keys, F.col("_day").alias("seen")).distinct()


def is_new(edges: DataFrame, seen: DataFrame, keys: list[str], prior_days: int, name: str) -> DataFrame:
    """1.0 where the key wasn't seen in the `prior_days` before the window, else 0.0."""
    prior = edges.select("window_start", *keys).distinct().join(seen, keys).where((F.col("seen") < F.col("window_start")) & (F.col("seen") >= F.date_sub("window_start", prior_days)))
    prior = prior.select("window_start", *keys).distinct().withColumn("_known", F.lit(True))
    return edges.join(prior, ["window_start", *keys], "left").withColumn(name, F.when(F.col("_known").isNull(), 1.0).otherwise(0.0)).drop("_known")


_N = lambda: F.count("*").alias("n")
_AFTER = lambda: F.avg("_after").alias("frac_after")


def window_pc_nodes(logs: dict[str, DataFrame], windows: dict) -> DataFrame:
    logon, device = (in_windows(derived(logs[k], k), **windows).select("window_start", "user", "pc", "activity", "_hour", "_after", "_weekend", F.lit(k).alias("kind")) for k in ("logon", "device"))
    both = logon.unionByName(device)
    return both.groupBy("window_start", "pc").agg(
        F.countDistinct("user").alias("num_users"), _AFTER(), (F.countDistinct("user") > 1).cast("int").alias("is_shared"), F.count_if((F.col("kind") == "logon") & P.activity_is(F.col("activity"), "logon")).alias("total_logons"),
        F.count_if((F.col("kind") == "device") & P.activity_is(F.col("activity"), "connect")).alias("total_usb"), F.avg("_weekend").alias("weekend_ratio"), F.avg("_hour").alias("mean_hour"), F.coalesce(F.stddev_samp("_hour"), F.lit(0.0)).alias("std_hour"),
    )


def window_url_nodes(http: DataFrame, windows: dict) -> DataFrame:
    rows = in_windows(derived(http, "http"), **windows)
    top = rows.groupBy("window_start", "_domain", "user").agg(F.count("*").alias("n")).groupBy("window_start", "_domain").agg(F.count("user").alias("visitors"), (F.max("n") / F.sum("n")).alias("concentration"))
    out = rows.groupBy("window_start", "_domain").agg(_N(), _AFTER(), F.avg("_hour").alias("mean_hour")).join(top, ["window_start", "_domain"])
    flags = {"is_job": C.JOB_DOMAINS, "is_cloud": C.CLOUD_DOMAINS, "is_keylogger": C.KEYLOGGER_DOMAINS}
    return out.withColumns({n: P.any_word(F.col("_domain"), w).cast("int") for n, w in flags.items()}).withColumnRenamed("_domain", "domain")


def window_file_nodes(files: DataFrame, windows: dict, prior_days: int = 60) -> DataFrame:
    d = derived(files, "file")
    out = in_windows(d, **windows).groupBy("window_start", "filename").agg(_N(), F.countDistinct("user").alias("copiers"), F.count_if("_torem").alias("to_removable"), _AFTER()).withColumn("is_decoy", F.lit(0.0))
    return is_new(out, first_seen(d, ["filename"]), ["filename"], prior_days, "is_new")


def window_logon_edges(logon: DataFrame, windows: dict) -> DataFrame:
    rows = in_windows(derived(logon.where(P.activity_is(F.col("activity"), "logon")), "logon"), **windows)
    return with_burst(rows, ["window_start", "user", "pc"], [_N(), _AFTER(), F.avg("_weekend").alias("frac_weekend"), F.avg("_hour").alias("mean_hour")])


def window_usb_edges(logs: dict[str, DataFrame], windows: dict, prior_days: int = 60) -> DataFrame:
    d = {k: derived(logs[k], k) for k in ("logon", "device")}
    out = with_burst(in_windows(d["device"].where(P.activity_is(F.col("activity"), "connect")), **windows), ["window_start", "user", "pc"], [_N(), _AFTER()])
    seen = first_seen(d["logon"], ["user", "pc"]).union(first_seen(d["device"], ["user", "pc"])).distinct()
    return is_new(out, seen, ["user", "pc"], prior_days, "is_new_pc")


def window_email_edges(email: DataFrame, windows: dict) -> DataFrame:
    rows = in_windows(derived(email, "email"), **windows).withColumns({"dst": F.explode(P.internal_recipients(*[F.col(c) for c in RECIPIENTS])), "_ext": P.external_thread(*[F.col(c) for c in RECIPIENTS]).cast("int")})
    return rows.where(F.col("dst") != F.col("user")).groupBy("window_start", F.col("user").alias("src"), "dst").agg(_N(), F.avg(P.number(F.col("size"))).alias("mean_size"), F.max(attachments()).alias("max_attachments"), _AFTER(), F.avg("_ext").alias("is_external"))


def window_http_edges(http: DataFrame, windows: dict, prior_days: int = 60) -> DataFrame:
    d = derived(http, "http").withColumnRenamed("_domain", "domain")
    out = with_burst(in_windows(d, **windows), ["window_start", "user", "domain"], [_N(), _AFTER()]).withColumn("concentration", F.col("max_day") / F.col("n")).drop("max_day")
    return is_new(out, first_seen(d, ["user", "domain"]), ["user", "domain"], prior_days, "is_new_domain")


def window_file_edges(files: DataFrame, windows: dict, prior_days: int = 60) -> DataFrame:
    d = derived(files, "file")
    out = in_windows(d, **windows).groupBy("window_start", "user", "filename").agg(_N(), _AFTER(), F.avg(F.col("_torem").cast("int")).alias("frac_removable"))
    return is_new(out, first_seen(d, ["user", "filename"]), ["user", "filename"], prior_days, "is_new_file")


def top_keys(rows: DataFrame, key: str, k: int | None, always: Column | None = None) -> DataFrame:
    """(key, n): the k most frequent keys, by key among equals, and those that `always` holds for. Without k, all."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    if not k or k <= 0:
        return counts
    best = counts.orderBy(F.desc("n"), key).limit(k)
    return best if always is None else best.union(counts.where(always)).distinct()


def ego_networks(logs: dict[str, DataFrame]) -> DataFrame:
    """(user, kind, dst, weight, colour) of each user's machines, domains and internal recipients, one edge per address."""
    of = lambda k: derived(logs[k], k).where(F.col("user").isNotNull())
    colour = P.ratio_colour(F.avg("_after")).alias("colour")
    pcs = of("logon").groupBy("user", F.col("pc").alias("dst")).agg(F.count("*").alias("weight"), colour).withColumn("kind", F.lit("pc"))
    urls = of("http").groupBy("user", F.col("_domain").alias("dst")).agg(F.count("*").alias("weight"), colour).withColumn("kind", F.lit("url"))
    address = F.explode(P.internal_recipients(*[F.col(c) for c in RECIPIENTS]))
    mail = of("email").select("user", address.alias("dst"), F.lit(1).cast("long").alias("weight"), F.lit(None).cast("string").alias("colour"), F.lit("user").alias("kind"))
    return pcs.unionByName(urls).unionByName(mail).select("user", "kind", "dst", "weight", "colour")


def ego_network(logs: dict[str, DataFrame], user: str) -> DataFrame:
    """(kind, dst, weight, colour) of one user; the condition reaches the scans."""
    return ego_networks(logs).where(F.col("user") == user).drop("user")


def excluding(logs: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """The logs without the events of some users."""
    return {k: x.join(users.select("user").distinct(), "user", "left_anti") for k, x in logs.items()}


def assertions(nodes: dict[str, int], edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges by index that point outside their nodes: none in a sound graph."""
    return edges.where((F.col("src") < 0) | (F.col("src") >= nodes[source]) | (F.col("dst") < 0) | (F.col("dst") >= nodes[target]))
