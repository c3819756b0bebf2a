"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Shallow trees are grown over statistics that Spark's own functions compute. Every path from a root
to a node is a rule, a conjunction of conditions on statistics. A lasso logistic regression weighs
the rules and sets most weights to zero. What is left compiles into one Spark column, so scoring
reads each text once, in the JVM, with no model to ship.

Fitting is the only step on a sample: at most about `max_rows` labelled rows, drawn by a hash of
the id. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch, text_of

#: Bound on the labelled rows that the rules are fitted on.
MAX_ROWS = 20_000
TREES, DEPTH, LASSO, ITERATIONS = 12, 3, 0.002, 60
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that is not null; shares of an empty text are 0."""
    n = F.char_length(text)
    words, lines = F.split(F.btrim(text), "[ \\t\\n\\x0b\\f\\r]+"), F.split(text, "\n", -1)
    before = F.slice(F.concat(F.array(F.lit(None)), words), F.lit(1), F.size(words))  # of each word the one before it
    pairs = F.zip_with(before, words, lambda a, b: F.concat_ws(" ", a, b))

    def share(part: Column, whole: Column = n) -> Column:
        return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))

    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_length": share(n, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_pairs": share(F.size(F.array_distinct(pairs)), F.size(words)),
        "stutter": share(F.size(F.filter(F.zip_with(before, words, lambda a, b: a == b), lambda same: same)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "upper": share(F.regexp_count(text, F.lit("[A-Z]"))),
        "marks": share(F.regexp_count(text, F.lit("[*$%&#@^~<>{}=_\\\\]"))),
        "shouts": share(F.regexp_count(text, F.lit("!"))),
        "bars": share(F.regexp_count(text, F.lit("\\|"))),
        "digits": share(F.regexp_count(text, F.lit("[0-9]"))),
        "stops": share(F.regexp_count(text, F.lit("[.,;:?]"))),
        "wide": share(F.octet_length(text) - n),
        "line_length": share(n, F.regexp_count(text, F.lit("\n")) + 1),
    }


@dataclass(frozen=True)
class Rule:
    """A weight and the conditions (statistic, is it at most the threshold, threshold) that all must hold."""

    weight: float
    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self) -> Column:
        return reduce(and_, [F.col(s) <= t if low else F.col(s) > t for s, low, t in self.conditions])


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of good quality, over columns named as the statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.holds(), rule.weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _paths(node, names: list[str], before: tuple = ()) -> list[tuple]:
    """The conditions on the way to each node under `node`."""
    if node.numDescendants() == 0:
        return []
    split, found = node.split(), []
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        here = (*before, (names[split.featureIndex()], low, float(split.threshold())))
        found += [here, *_paths(child, names, here)]
    return found


def _tightest(path: tuple) -> tuple:
    """The path with one bound on each side of a statistic, in a fixed order."""
    best: dict = {}
    for s, low, t in path:
        best[s, low] = t if (s, low) not in best else (min if low else max)(t, best[s, low])
    return tuple(sorted((s, low, t) for (s, low), t in best.items()))


def held_out(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Rules fitted on labels (doc_id, label 0 or 1) of documents (doc_id, text).

    Null labels are left out, and several labels of a document count by their mean. Without rows,
    or with one class alone, the ensemble is its intercept: the share of label 1, or a half.
    """
    labels = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    total = labels.count()
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = labels.where(bucket < min(1 << 20, int((1 << 20) * max_rows / max(1, total))))
    # About max_rows ids of eight bytes, whatever the size of the corpus.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    with Scratch(docs.sparkSession) as scratch:
        # The sample is one task's worth, so that each step of the fit is one short task.
        rows = scratch.cut(rows.select("label", *[c.alias(n) for n, c in statistics(F.col("text")).items()])).coalesce(1)
        return _fit(rows, trees, depth, lasso, scratch)


def _fit(rows: DataFrame, trees: int, depth: int, lasso: float, scratch: Scratch) -> RuleEnsemble:
    classes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        p = min(max(next(iter(classes), 0.5), 0.01), 0.99)
        return RuleEnsemble(float(_logit(p)), ())
    names = [c for c in rows.columns if c != "label"]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=1).fit(vectors.select("label", "features"))
    paths = sorted({_tightest(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"), names)})
    if not paths:
        return RuleEnsemble(float(_logit(classes[1.0] / sum(classes.values()))), ())
    held = [Rule(0.0, p).holds().cast("double").alias(f"r{i}") for i, p in enumerate(paths)]
    rules = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="features").transform(scratch.cut(rows.select("label", *held), small=True))
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=ITERATIONS, standardization=False).fit(rules.select("label", "features"))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), tuple(Rule(float(w), p) for w, p in zip(weights, paths) if w))


def _logit(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """`row`, the input row whatever its columns are called, and `score`; null texts count as empty, and all rows stay."""
    wide = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in statistics(text_of(text_col)).items()])
    return wide.select("row", model.score().alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted; learned only from rows not held out.

    Repeated rows and rows of equal texts are scored alike, so ties stay ties; a null id is not held
    out and has no label; a text of any length is scored whole, an empty one by its zero
    statistics; other columns are ignored, and an empty table gives no rows.
    """
    learn = labels.select("doc_id", F.col("quality").alias("label")).where(held_out("doc_id", folds) != 0)
    model = fit(docs, learn)
    scored = score(docs.select("doc_id", "text"), model)
    scored = scored.select("row.doc_id", "score")
    return scored.select("doc_id", F.coalesce(held_out("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
