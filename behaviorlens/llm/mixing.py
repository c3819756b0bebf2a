"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell of source, language and topic. The cells are raked: the weights of one
dimension after another are scaled to its target marginal, until all marginals hold. A cell's
weight over its tokens is the rate at which its documents are wanted, and documents are sampled
with probabilities in proportion to it, calibrated so that the expected tokens meet a budget.

The corpus is read twice, to count and to sample. In between there are cells, of which there are
at most as many as combinations of keys; they stay in tables, and the driver sees single numbers.
A hot source is pre-aggregated like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch, text_of

DIMENSIONS = ("source", "lang", "topic")
#: What a marginal may be off its target in the end, and rounds over all dimensions at most.
TOLERANCE, ROUNDS = 1e-10, 60
#: Cells that one task rakes with ease.
SMALL = 100_000
#: The share of tokens that is kept, and the exponent that flattens a marginal into its target.
KEEP, TEMPERATURE = 0.8, 0.7
NONE = "(none)"


def tokens_of(text: Column) -> Column:
    """Words of a text; an empty one counts as one, so that no cell weighs nothing."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("double")


def topic_of(text: Column, tokens: Column) -> Column:
    """The topic where none is given: the form of a text, table or prose by length, the same in every language."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(tokens < 100, "short").when(tokens < 1000, "medium").otherwise("long")


def described(docs: DataFrame, text_col: str = "text", topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """`row`, the input row whatever its columns are called, tokens and the dimensions; a null key is NONE."""
    rows = docs.select(F.struct("*").alias("row"), tokens_of(text_of(text_col)).alias("tokens"), *[F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in DIMENSIONS[:2]])
    return rows.withColumn("topic", topic(F.coalesce(F.col("row")[text_col], F.lit("")), F.col("tokens")))


def tempered(cells: DataFrame, dimension: str, temperature: float = TEMPERATURE) -> DataFrame:
    """(key, share): the marginal of a dimension raised to a power and scaled to sum 1."""
    sums = cells.groupBy(F.col(dimension).alias("key")).agg(F.sum("tokens").alias("tokens"))
    total = sums.agg(F.sum(F.pow("tokens", F.lit(temperature)))).first()[0] or 1.0
    return sums.select("key", (F.pow("tokens", F.lit(temperature)) / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, float, int]:
    """The cells with `rate`, their raked weight over their tokens; the residual, and the rounds it took.

    `cells` has the dimensions and tokens; `targets` gives (key, share) for each dimension. A key
    without a target is wanted at rate 0. A round scales the weights of one dimension after another
    to its marginal. It ends when no key of any dimension is off its target by more than
    `tolerance` of it, or after `rounds`, as where the targets contradict one another or ask for
    cells that are empty; the residual says how far off the worst key is then.
    """
    small = cells.count() <= SMALL
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    now = cells.select(*targets, "tokens", F.col("tokens").alias("weight"))
    for d, t in targets.items():
        now = now.join(t.select(F.col("key").alias(d), (F.col("share") * total).alias(f"wanted_{d}")), d, "left")
    now = scratch.cut(now, small)

    def with_sums(now: DataFrame, d: str) -> DataFrame:
        """With `w`, the weight of the row's key: of few cells in the one task that has them all, without a join."""
        if small:
            return now.withColumn("w", F.sum("weight").over(Window.partitionBy(d)))
        return now.join(now.groupBy(d).agg(F.sum("weight").alias("w")), d, "left")

    columns, residual, done = now.columns, 0.0, 0
    while done < rounds:
        done, used = done + 1, [now]
        for d in targets:
            factor = F.coalesce(F.col(f"wanted_{d}") / F.nullif(F.col("w"), F.lit(0.0)), F.lit(0.0))
            now = with_sums(now, d).withColumn("weight", F.col("weight") * factor).select(columns)
            if not small or d == list(targets)[-1]:
                now = scratch.cut(now, small)
                used.append(now)
        scratch.drop(*used[:-1])
        off = now
        for d in targets:
            off = with_sums(off, d).withColumn(f"off_{d}", F.abs(F.col("w") / F.nullif(F.col(f"wanted_{d}"), F.lit(0.0)) - 1)).drop("w")
        residual = max(x or 0.0 for x in off.agg(*[F.max(f"off_{d}") for d in targets]).first())
        if residual <= tolerance:
            break
    return now.select(*targets, "tokens", (F.col("weight") / F.col("tokens")).alias("rate")), residual, done


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """The cells with `probability` = min(1, c * rate), c such that the expected tokens are `keep` of all, and `budget_gap`.

    Cells whose documents are all kept give what they have; c is set on the others, until no more
    cell is full, which takes no more steps than there are cells and mostly a few. `budget_gap` is
    what the expected tokens are short of the budget, as a part of it: more than rounding only where
    too many cells are wanted at rate 0.
    """
    total = raked.agg(F.sum("tokens")).first()[0] or 0.0
    c, full_before = keep, -1
    while True:
        full = F.col("rate") * c >= 1
        held = raked.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("rate"))).alias("rest"), F.count_if(full).alias("n")).first()
        if not held.rest or held.n == full_before:
            break
        full_before, c = held.n, max(c, (keep * total - (held.full or 0.0)) / held.rest)
    expected = (held.full or 0.0) + c * (held.rest or 0.0)
    gap = 1 - expected / (keep * total) if keep * total else 0.0
    return raked.withColumns({"probability": F.least(F.lit(1.0), F.col("rate") * c), "budget_gap": F.lit(gap)})


def dice(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id as text: the same wherever and whenever it is drawn."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """`row`, the input row; tokens, source, lang, topic, rate, residual, probability, budget_gap and selected.

    `topic` makes a text's topic of the text and its tokens, as from a classifier's column. Without
    targets each marginal's own shares are tempered; `residual` is how far the worst key is
    off its target after raking, `budget_gap` how far the expected tokens fall short. Null and empty texts count as one token, long ones whole; null keys
    are a key of their own; rows with the same id are drawn together, so ties stay or go as one;
    null ids draw as one. An empty table gives no rows; columns with clashing names stay in `row`.
    """
    rows = described(docs, text_col, topic)
    with Scratch(docs.sparkSession) as scratch:
        cells = scratch.cut(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
        raked, residual, _ = rake(cells, targets or {d: tempered(cells, d, temperature) for d in DIMENSIONS}, scratch)
        found = scratch.cut(calibrate(raked, keep).select(*DIMENSIONS, "rate", F.lit(residual).alias("residual"), "probability", "budget_gap"))
        scratch.keep(found)
    # A row per cell: the planner knows the written size, and broadcasts it only if that is small.
    out = rows.join(found, list(DIMENSIONS)).withColumn("selected", dice(f"row.{id_col}", seed) < F.col("probability"))
    return out.select("row", "tokens", *DIMENSIONS, "rate", "residual", "probability", "budget_gap", "selected")


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The selected input rows, with their own columns."""
    return mix(docs, **parameters).where("selected").select("row.*")
