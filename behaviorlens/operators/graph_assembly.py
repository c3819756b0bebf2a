"""Whole graphs: node tables with dense numbers and edge tables between them.

`hetero_graph` is one graph of a stretch of time; `windowed_graph` holds the graphs of all windows
at once, keyed by window_start. Both are a dict of nodes and a dict of edges, which stay tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from behaviorlens.functions import predicates as P
from behaviorlens.operators import graph as G
from behaviorlens.sources.store import written

#: Ends of each kind of edge, as kinds of nodes.
ENDS = {"logon": ("user", "pc"), "usb": ("user", "pc"), "file": ("user", "file"), "email": ("user", "user"), "http": ("user", "url")}
KEYS = {"user": "user", "pc": "pc", "url": "domain", "file": "filename"}


@dataclass(frozen=True)
class Graph:
    """`observed` has, as nodes/kind and edges/kind, what is known of the tables that are counted once they were read."""

    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    observed: dict[str, Observation] = field(default_factory=dict)


def between(logs: dict[str, DataFrame], start: str, end: str) -> dict[str, DataFrame]:
    """The events from one time to another, both included."""
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return {k: x.where((F.col("date") >= low) & (F.col("date") <= high)) for k, x in logs.items()}


def hetero_graph(logs: dict[str, DataFrame], insiders: DataFrame, start: str, end: str, hidden: DataFrame | None = None, excluded: DataFrame | None = None) -> Graph:
    """The graph of a stretch of time: nodes with `idx` and their features, users with label `y`; edges with `src` and `dst` as numbers.

    `hidden` users keep their nodes and edges, and have `in_training` false; `excluded` users have
    no node, so that their edges are skipped. All tables are observed.
    """
    own = between(logs, start, end)
    labels = insiders.select(F.col("user_id").alias("user"), F.lit(1).alias("y")).distinct()
    users = G.user_nodes(own).join(labels, "user", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    unseen = users.limit(0).select("user") if hidden is None else hidden.select("user").distinct()
    users = users.join(unseen.withColumn("_h", F.lit(True)), "user", "left").withColumn("in_training", F.col("_h").isNull()).drop("_h")
    nodes = {"user": users, "pc": G.pc_nodes(own), "url": G.url_nodes(own["http"]), "file": G.file_nodes(own["file"])}
    if excluded is not None:
        nodes["user"] = nodes["user"].join(excluded.select("user").distinct(), "user", "left_anti")
    observed = {k: Observation(k) for k in (*(f"nodes/{k}" for k in KEYS), *(f"edges/{k}" for k in ENDS))}
    nodes = {k: x.join(G.dense_ids(x, KEYS[k]), KEYS[k]) for k, x in nodes.items()}
    counted = {k: _counted(x, observed[f"nodes/{k}"]) for k, x in nodes.items()}
    edges = {
        "logon": G.logon_edges(own["logon"]), "usb": G.usb_edges(own["device"]), "file": G.file_edges(own["file"]),
        "email": G.email_edges(own["email"], users), "http": G.http_edges(own["http"]),
    }
    ids = {k: x.select(KEYS[k], "idx") for k, x in nodes.items()}
    numbered = {k: G.numbered_edges(edges[k], ids[s], ids[t], observed[f"edges/{k}"]) for k, (s, t) in ENDS.items()}
    return Graph(counted, numbered, observed)


def _counted(nodes: DataFrame, observation: Observation) -> DataFrame:
    """The nodes, with their number, the largest idx, rows with an odd label and rows with a feature that is no number observed."""
    odd = ~F.col("y").isin(0, 1) if "y" in nodes.columns else F.lit(False)
    gaps = P.any_of(F.lit(False), *[F.col(c).isNull() | F.isnan(c) for c, t in nodes.dtypes if t == "double"])
    return nodes.observe(observation, F.count(F.lit(1)).alias("n"), F.max("idx").alias("max_idx"), F.count_if(odd).alias("odd_labels"), F.count_if(gaps).alias("gaps"))


def measure(graph: Graph, folder: str | None = None) -> dict[str, dict]:
    """What was observed of all tables, which are read once for it: written below a folder, or to nowhere."""
    for name, table in {**{f"nodes/{k}": t for k, t in graph.nodes.items()}, **{f"edges/{k}": t for k, t in graph.edges.items()}}.items():
        writer = table.write.mode("overwrite")
        writer.format("noop").save() if folder is None else writer.parquet(f"{folder}/{name}")
    return {k: o.get for k, o in graph.observed.items()}


def problems(measured: dict[str, dict]) -> list[str]:
    """What is wrong with a measured graph: numbers with gaps, ends out of bounds, odd labels, features that aren't numbers."""
    found = []
    for kind in KEYS:
        m = measured[f"nodes/{kind}"]
        if m["n"] and m["max_idx"] != m["n"] - 1:
            found.append(f"{kind}: {m['n']} nodes are numbered to {m['max_idx']}")
        found += [f"{kind}: {m[c]} rows with {what}" for c, what in (("odd_labels", "an odd label"), ("gaps", "a feature that is no number")) if m[c]]
    for kind, ends in ENDS.items():
        m = measured[f"edges/{kind}"]
        for end, node in zip(("src", "dst"), ends):
            if m["n_edges"] > m["n_skipped"] and (m[f"min_{end}"] < 0 or m[f"max_{end}"] >= measured[f"nodes/{node}"]["n"]):
                found.append(f"{kind}: {end} is out of bounds")
    return found


def cumulative_graphs(logs: dict[str, DataFrame], insiders: DataFrame, start: str, ends: dict[str, str]) -> dict[str, Graph]:
    """A graph for each named end, all from the same start: train, validation and test see ever more of the log."""
    return {name: hetero_graph(logs, insiders, start, end) for name, end in ends.items()}


def window_users(logs: dict[str, DataFrame], windows: dict) -> DataFrame:
    """(window_start, user, in_logs): users with events in a window, and internal recipients of its mail, lower-cased."""
    own = [G.in_windows(x.where(F.col("user").isNotNull()), **windows).select("window_start", "user", F.lit(True).alias("in_logs")) for x in logs.values()]
    mail = G.in_windows(logs["email"], **windows)
    to = mail.select("window_start", F.explode(P.internal_recipients(*[F.col(c) for c in G.RECIPIENTS])).alias("user"), F.lit(False).alias("in_logs"))
    return reduce(DataFrame.union, [*own, to]).groupBy("window_start", "user").agg(F.max("in_logs").alias("in_logs"))


def capped(nodes: DataFrame, key: str, most: int | None) -> DataFrame:
    """The `most` busiest nodes of each window, by key among equals; all of them without a number. Flagged domains always stay."""
    if not most or most <= 0:
        return nodes
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), key))
    flagged = [F.col(c) == 1 for c in ("is_job", "is_cloud", "is_keylogger") if c in nodes.columns]
    return nodes.withColumn("_r", rank).where(P.any_of(F.col("_r") <= most, *flagged)).drop("_r")


def reaching(windows: dict, starts: list[str]) -> dict:
    """The windows from the first of some of their starts to the last, with all events that are in them."""
    last = date.fromisoformat(max(starts)) + timedelta(days=windows["size"] - 1)
    return {**windows, "first": min(starts), "last": last.isoformat()}


def windowed_graph(logs: dict[str, DataFrame], windows: dict, prior_days: int = 60, max_url_nodes: int | None = None, max_file_nodes: int | None = None, once: bool = False) -> Graph:
    """The graphs of all windows at once, keyed by window_start; edges only between nodes of their window.

    With `once` the nodes are made and written once, for the edges and for whoever asks for them.
    """
    nodes = {
        "user": window_users(logs, windows),
        "pc": G.window_pc_nodes(logs, windows),
        "url": capped(G.window_url_nodes(logs["http"], windows), "domain", max_url_nodes),
        "file": capped(G.window_file_nodes(logs["file"], windows, prior_days), "filename", max_file_nodes),
    }
    nodes = {k: written(x) for k, x in nodes.items()} if once else nodes
    edges = {
        "logon": G.window_logon_edges(logs["logon"], windows), "usb": G.window_usb_edges(logs, windows, prior_days), "file": G.window_file_edges(logs["file"], windows, prior_days),
        "email": G.window_email_edges(logs["email"], windows).withColumnsRenamed({"src": "user", "dst": "recipient"}), "http": G.window_http_edges(logs["http"], windows, prior_days),
    }
    for k, (_, target) in ENDS.items():
        known = nodes[target].select("window_start", F.col(KEYS[target]).alias("recipient" if k == "email" else KEYS[target]))
        edges[k] = edges[k].join(known, [*known.columns], "left_semi")
    return Graph(nodes, edges)


def numbered_windows(graph: Graph, both_ways: bool = True) -> Graph:
    """The graphs of all windows with nodes numbered from 0 in each, edges between numbers, and each edge once more from its target as rev_...; edges are made and written once."""
    ids = {k: written(G.window_ids(x, KEYS[k])) for k, x in graph.nodes.items()}
    nodes = {k: x.join(ids[k], ["window_start", KEYS[k]]) for k, x in graph.nodes.items()}
    observed, edges = {f"edges/{k}": Observation(k) for k in ENDS}, {}
    for k, (source, target) in ENDS.items():
        ends = graph.edges[k].withColumnsRenamed({"user": "src", "recipient" if k == "email" else KEYS[target]: "dst"})
        edges[k] = written(G.numbered_edges(ends, ids[source], ids[target], observed[f"edges/{k}"], by=("window_start",)))
        if both_ways:
            edges[f"rev_{k}"] = G.reverse(edges[k])
    return Graph(nodes, edges, observed)


def graph_statistics(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(name, n, min, max, mean, nonzero) of numeric columns: `nonzero` is the share of values that aren't 0."""
    long = table.select(*[F.col(n).cast("double") for n in names]).unpivot([], list(names), "name", "x")
    return long.groupBy("name").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.avg((F.col("x") != 0).cast("int")).alias("nonzero"))
