"""Message passing over typed edges: what a node's neighbours are like, by kind of edge, over several hops.

A hop sends the value of each edge's source to its target and takes the mean of what arrives, first
by kind of edge and then over all kinds; the latter is the target's value in the next hop. Sums and
counts are added before anything is shuffled by target, so a target with very many edges is no
large group. Sources with very many edges are hubs: their value is copied to as many shares as
they need, and their edges are dealt to those by a hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.operators import graph as G
from behaviorlens.sources.store import written

#: Edges of one source that go to one share, at least, and hubs that there may be, at most.
SHARE, MOST_HUBS = 100_000, 20_000


def _named(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value)


def typed_edges(logs: dict[str, DataFrame], both_ways: bool = True) -> DataFrame:
    """(kind, src, dst, n): how often a user met a machine, file, domain or user; a node's name starts with its type.

    With `both_ways`, each edge is there once more from its target to its source, as kind rev_...
    """
    users = reduce(DataFrame.unionByName, [x.select("user") for x in logs.values()]).where("user is not null").distinct()
    found = {
        "logon": (G.logon_edges(logs["logon"]), "pc"), "usb": (G.usb_edges(logs["device"]), "pc"), "file": (G.file_edges(logs["file"]), "file"),
        "email": (G.email_edges(logs["email"], users), "user"), "http": (G.http_edges(logs["http"]), "url"),
    }
    parts = []
    for kind, (edges, target) in found.items():
        pairs = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(_named("user", F.col("src")).alias("src"), _named(target, F.col("dst")).alias("dst"))
        pairs = pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "src", "dst", "n")
        parts += [pairs, pairs.select(F.lit(f"rev_{kind}").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")] if both_ways else [pairs]
    return reduce(DataFrame.unionByName, parts)


def hubs_of(edges: DataFrame, share: int = SHARE, most: int = MOST_HUBS) -> DataFrame:
    """(src, shares) of the sources whose edges need more than one share.

    A share has at least `share` edges, and at least one in `most` of all, so there are no more
    than `most` hubs whatever the number of edges.
    """
    degrees = edges.groupBy("src").agg(F.count("*").alias("d"))
    least = F.greatest(F.lit(share), F.ceil(F.sum("d") / most))
    bound = degrees.agg(least.alias("bound"))  # one row
    return degrees.join(F.broadcast(bound)).where(F.col("d") > F.col("bound")).select("src", F.ceil(F.col("d") / F.col("bound")).cast("int").alias("shares"))


def sent(edges: DataFrame, values: DataFrame, hubs: DataFrame) -> DataFrame:
    """The edges with the values of their source; sources without a value send nothing. `hubs` has MOST_HUBS rows at most."""
    shares, small = F.coalesce("shares", F.lit(1)), F.broadcast(hubs)
    dealt = edges.join(small, "src", "left").withColumn("_share", F.pmod(F.xxhash64("dst", "kind"), shares)).drop("shares")
    copied = values.withColumnRenamed("node", "src").join(small, "src", "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares.cast("long") - 1))).drop("shares")
    return dealt.join(copied, ["src", "_share"]).drop("_share")


def neighbour_means(edges: DataFrame, values: DataFrame, names: tuple[str, ...], hops: int = 2, weighted: bool = False, share: int = SHARE) -> DataFrame:
    """(node, hop, kind, neighbours, *names): the means of what reaches a node by each kind of edge in each hop.

    `values` has (node, *names), a row for each node that has a value at the start. A hop's value
    of a node is the mean over all that reached it in the hop before, of whatever kind. With
    `weighted` an edge counts as often as its `n` says. A null value is not sent.
    """
    edges = written(edges)
    hubs = written(hubs_of(edges, share))
    state, out = values.select("node", *names), []
    for hop in range(1, hops + 1):
        weight = F.col("n").cast("double") if weighted else F.lit(1.0)
        sums = [F.sum(F.when(F.col(n).isNotNull(), F.col(n) * weight)).alias(f"s_{n}") for n in names]
        counts = [F.sum(F.when(F.col(n).isNotNull(), weight)).alias(f"c_{n}") for n in names]
        by_kind = written(sent(edges, state, hubs).groupBy(F.col("dst").alias("node"), "kind").agg(F.count("*").alias("neighbours"), *sums, *counts))
        out.append(by_kind.select("node", F.lit(hop).alias("hop"), "kind", "neighbours", *[(F.col(f"s_{n}") / F.col(f"c_{n}")).alias(n) for n in names]))
        state = by_kind.groupBy("node").agg(*[(F.sum(f"s_{n}") / F.sum(f"c_{n}")).alias(n) for n in names])
    return reduce(DataFrame.unionByName, out)


def context(means: DataFrame, node_type: str, key: str, hops: int, names: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """One row for each node of a type: the means of each hop and kind side by side, null where nothing arrived."""
    own = means.where(F.startswith("node", F.lit(f"{node_type}:"))).withColumn(key, F.substring("node", len(node_type) + 2, 1 << 30))
    cells = [F.max(F.when((F.col("hop") == h) & (F.col("kind") == k), F.col(n))).alias(f"h{h}_{k}_{n}") for h in range(1, hops + 1) for k in kinds for n in names]
    return own.groupBy(key).agg(*cells)
