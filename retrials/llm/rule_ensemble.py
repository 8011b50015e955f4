"""Quality classifier: a sparse ensemble of rules.

Trees are grown on statistics of the text; every path from a root is a conjunctive rule.  A lasso
logistic regression weighs the rules and most weights become nought.  The rest are compiled into one
Spark column expression, so that scoring is a plain projection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import stored
from retrials.llm.quality_rules import LOWER, UPPER, WHITE, words_of

STATISTICS = ("n_words", "word_length", "distinct", "symbols", "capitals", "digits", "marks", "bars", "ends", "repeats", "same_next", "line_words", "long_words")


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of each text; null counts as empty, and a text without words has zeros."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("words", words_of(F.col("text")))
    body = F.col("text")
    without = lambda letters: F.length(F.translate(body, letters, ""))
    n, chars = F.size("words"), F.col("chars")
    src = src.withColumn("chars", without(WHITE)).withColumn(
        "lines", F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0))
    per_word, per_char = (lambda x: x / F.greatest(n, F.lit(1))), (lambda x: x / F.greatest(chars, F.lit(1)))
    same = F.size(F.filter(F.transform("words", lambda w, i: (i > 0) & F.coalesce(F.get("words", i - 1) == w, F.lit(False))), lambda x: x))
    stats = {
        "n_words": n, "word_length": per_word(chars), "distinct": per_word(F.size(F.array_distinct("words"))),
        "symbols": per_char(F.length(body) - without("#*$%&|<>~^_=+@")), "capitals": per_char(F.length(body) - without(UPPER)),
        "digits": per_char(F.length(body) - without("0123456789")), "marks": per_char(F.length(body) - without("!?")),
        "bars": per_word(F.length(body) - without("|")), "ends": per_word(F.length(body) - without(".")),
        "repeats": (F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1)),
        "same_next": per_word(same), "line_words": n / F.greatest(F.size("lines"), F.lit(1)),
        "long_words": per_word(F.size(F.filter("words", lambda w: F.length(w) > 12)))}
    return src.select("doc_id", *(stats[k].cast("double").alias(k) for k in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, x in self.terms:
            out = out & (F.col(name) <= x if at_most else F.col(name) > x)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def paths(debug: str, names=STATISTICS) -> list[Rule]:
    """All paths from the root of a printed tree to its other nodes, simplified."""
    out, stack = [], []
    for line in debug.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (names[int(m[3])], m[4] == "<=", float(m[5]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, at_most, x) in stack:
            tightest[name, at_most] = (min if at_most else max)(x, tightest.get((name, at_most), x))
        out.append(Rule(tuple(sorted((name, at_most, x) for (name, at_most), x in tightest.items()))))
    return out


def fit(train: DataFrame, trees: int = 16, depth: int = 3, penalty: float = 0.002, max_rows: int = 20_000, seed: int = 7) -> Ensemble:
    """``train``: the statistics and ``label`` (0 or 1).  Beyond ``max_rows`` rows, a sample of about that
    many is taken by a hash of the id.  Without rows the score is 0.5, with one label it is that label's share, smoothed."""
    train = train.where(F.col("label").isNotNull())
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if odd := sorted(set(counts) - {0, 1}):
        raise ValueError(f"labels other than 0 and 1: {odd[:5]}")
    n = sum(counts.values())
    if len(counts) < 2:
        one = counts.get(1, 0)
        return Ensemble(math.log((one + 1) / (n - one + 1)), ())
    if n > max_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    # At most about ``max_rows`` rows pass this exchange; the join above keeps its own tasks.
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train).select(
        "doc_id", *STATISTICS, F.col("label").cast("double").alias("label"), "features").repartition(4, "doc_id").sortWithinPartitions(
        "doc_id", "label", *STATISTICS).persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(data)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree.toDebugString)))
    if not rules:
        data.unpersist()
        return Ensemble(math.log((counts[1] + 1) / (counts[0] + 1)), ())
    named = data.select("label", F.array(*(r.column().cast("double") for r in rules)).alias("r"))
    from pyspark.ml.functions import array_to_vector
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False, aggregationDepth=2).fit(
        named.select("label", array_to_vector("r").alias("features")))
    data.unpersist()
    return Ensemble(float(lasso.intercept), tuple((float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules, strict=True) if w != 0.0))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, held: int = 1, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Rows whose crc32(id as text) leaves ``held`` modulo ``folds`` are never learnt from.  A null id
    is not held out and has no label; labels of unknown ids and null labels are ignored; each of
    several labels of an id is a training row; a label that is neither 0 nor 1 is an error.  An empty
    table gives no rows, an empty text the statistics nought, a long text is read whole.  Other columns
    are not read."""
    stats = stored(statistics(docs, doc_id, text), "statistics")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out)
    ensemble = fit(stats.join(known, "doc_id"), **options)
    return stats.select("doc_id", held_out.alias("held_out"), ensemble.column().alias("score")).select(
        F.col("doc_id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
