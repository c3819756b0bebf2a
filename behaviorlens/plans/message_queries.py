"""What users' neighbours are like, over two hops, and a detector that reads it beside all else that is known of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.operators import baseline as B
from behaviorlens.operators import fusion as FU
from behaviorlens.operators import graph as G
from behaviorlens.operators import messages as MP
from behaviorlens.operators import models as M
from behaviorlens.operators import scoring as S
from behaviorlens.plans import daily_queries as DQ
from behaviorlens.plans import graph_queries as GQ
from behaviorlens.plans import serving_queries as SQ
from behaviorlens.plans import testviews as V
from behaviorlens.sources.store import new_folder

QUERIES, ORACLES = {}, {}
NAMES = ("mean_abs_z", "max_abs_z")
KINDS = ("logon", "usb", "file", "email", "http")


def user_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, mean_abs_z, max_abs_z): the means over a user's days."""
    days = B.daily_magnitude(DQ.bootstrap_z(spark, sf_dir))
    return days.groupBy(F.concat(F.lit("user:"), "user").alias("node")).agg(*[F.avg(n).alias(n) for n in NAMES])


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = MP.neighbour_means(MP.typed_edges(V.logs(spark, sf_dir)), user_magnitudes(spark, sf_dir), NAMES)
    return means.select("node", F.col("hop").cast("long").alias("hop"), "kind", "neighbours", *[F.round(n, 5).alias(n) for n in NAMES])


_EDGES = f"""
roster AS (SELECT DISTINCT "user" FROM ({GQ._ALL})),{GQ._EMAIL},
one AS (SELECT DISTINCT 'logon' AS kind, 'user:' || "user" AS src, 'pc:' || pc AS dst FROM logon WHERE lower(activity) = 'logon'
  UNION SELECT 'usb', 'user:' || "user", 'pc:' || pc FROM device WHERE lower(activity) = 'connect'
  UNION SELECT 'file', 'user:' || "user", 'file:' || filename FROM file WHERE {GQ._REM}
  UNION SELECT 'email', 'user:' || p.src, 'user:' || p.dst FROM pairs p JOIN roster r ON r."user" = p.dst
  UNION SELECT 'http', 'user:' || "user", 'url:' || {GQ._DOM} FROM http),
edges AS (SELECT * FROM one UNION ALL SELECT 'rev_' || kind, dst, src FROM one)"""
_HOP = """
m{h} AS (SELECT dst AS node, kind, count(*) AS neighbours, {sums} FROM edges JOIN s{g} ON s{g}.node = edges.src GROUP BY ALL),
s{h} AS (SELECT node, {state} FROM m{h} GROUP BY node)"""


def _hop(h: int) -> str:
    sums = ", ".join(f"sum({n}) AS s_{n}, count({n}) AS c_{n}" for n in NAMES)
    return _HOP.format(h=h, g=h - 1, sums=sums, state=", ".join(f"sum(s_{n}) / sum(c_{n}) AS {n}" for n in NAMES))


QUERIES["neighbour_context"] = neighbour_context
ORACLES["neighbour_context"] = f"""{DQ.WITH},\n{DQ.Z_SQL},\n{DQ.MAGNITUDE_SQL},{_EDGES},
s0 AS (SELECT 'user:' || "user" AS node, {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM mag GROUP BY 1),{_hop(1)},{_hop(2)}
""" + " UNION ALL ".join(f"SELECT node, {h}::BIGINT AS hop, kind, neighbours, {', '.join(f'round(s_{n} / c_{n}, 5) AS {n}' for n in NAMES)} FROM m{h}" for h in (1, 2))


def fusion_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The labelled windows with their statistics, graph aggregates, neighbours, traits, role and department, and the names of the numbers."""
    windows, statistics = SQ.window_features(spark, sf_dir)
    means = MP.neighbour_means(MP.typed_edges(V.logs(spark, sf_dir)), user_magnitudes(spark, sf_dir), NAMES)
    kinds = [("email", 1), ("email", 2), *[(f"rev_{k}", 2) for k in KINDS]]  # those in which users are reached
    near = MP.context(means, "user", "user", 2, NAMES, tuple(dict.fromkeys(k for k, _ in kinds)))
    near = near.select("user", *[f"h{h}_{k}_{n}" for k, h in kinds for n in NAMES])
    directory = V.ldap(spark, sf_dir).select(F.col("user_id").alias("user"), "role", "department").dropDuplicates(["user"])
    traits = S.traits(V.ocean(spark, sf_dir), windows.select("user").distinct())
    rows = FU.joined(windows, G.user_nodes(V.logs(spark, sf_dir)), near, traits, directory)
    numbers = (*statistics, *G.USER_COLUMNS, *near.columns[1:], *"OCEAN")
    return FU.prepared(rows, numbers, ("role", "department")), numbers


def fusion_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the joined pipeline, of every window by one that hasn't seen its user, each stored and loaded in between."""
    rows, numbers = fusion_rows(spark, sf_dir)
    store = FU.ModelStore(spark, new_folder(spark, "models"))

    def fit(rows: DataFrame, held: Column) -> DataFrame:
        fold = rows.where(held).first()["fold"]
        store.save(f"fusion-{fold}", FU.fit(rows.where(~held), numbers), numbers=list(numbers))
        return M.scores(store.load(f"fusion-{fold}"), rows.where(held), "user", "start", "label")

    return M.out_of_fold(rows, fit)


QUERIES["fusion_window_scores"] = fusion_window_scores
