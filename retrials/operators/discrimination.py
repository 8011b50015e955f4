"""Discrimination and calibration metrics over distinct-score histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.functions.numeric import count_where, flag, ratio
from retrials.functions.ordered import mid_ranks, position, running_sum


def score_histogram(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """(keys, score) -> positive and negative counts; the map side combines hot scores."""
    y = F.col(label).cast("long")
    return df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*keys, score).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )


def auroc_from_histogram(
    hist: DataFrame, keys: Sequence[str], score: str, cuts: Column | None = None
) -> DataFrame:
    """Exact tie-aware AUROC per key; NULL when a class is absent."""
    run = running_sum(hist, keys, [score], {"below": F.col("neg")}, cuts=cuts)
    u = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / F.lit(2.0)))
    p, n = F.sum("pos"), F.sum("neg")
    return run.groupBy(*keys).agg(
        ratio(u, p.cast("double") * n).alias("auroc"), p.alias("positives"), n.alias("negatives")
    )


def auroc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return auroc_from_histogram(materialize(score_histogram(df, keys, score, label)), keys, score)


def average_precision_from_histogram(hist: DataFrame, keys: Sequence[str], score: str, cuts: Column | None = None) -> DataFrame:
    """Step-wise average precision per key, walking scores from high to low."""
    desc = hist.withColumn("__d", -F.col(score))
    run = running_sum(
        desc, keys, ["__d"], {"tp": F.col("pos"), "seen": F.col("pos") + F.col("neg")}, cuts=cuts
    )
    return run.groupBy(*keys).agg(
        ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision")
    )


def average_precision(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return average_precision_from_histogram(materialize(score_histogram(df, keys, score, label)), keys, score)


def squared_error(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2))


def log_loss(p: Column, y: Column, clip: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def proper_scores(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    p, y = F.col(score), F.col(label).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(squared_error(p, y)).alias("brier"),
        F.avg(log_loss(p, y)).alias("log_loss"),
    )


def probability_bin(p: Column, bins: int) -> Column:
    """Equal-width bin: how many of the edges k * (1 / bins), as doubles, are at most ``p``; the last one is closed at 1."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    return sum(((p >= e).cast("long") for e in edges), F.lit(0).cast("long"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mean forecast, observed rate and count per occupied bin."""
    return df.withColumn("bin", probability_bin(F.col(score), bins)).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_forecast"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    curve = reliability(df, score, label, bins, keys)
    gap = F.col("n") * F.abs(F.col("mean_forecast") - F.col("observed_rate"))
    return curve.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def risk_coverage(df: DataFrame, score: str, label: str, ident: str) -> DataFrame:
    """Coverage and error rate when the most confident rows are kept first."""
    ordered = materialize(df.select(ident, (-F.col(score)).alias("__d"), F.col(label).cast("long").alias("__y")))
    run = running_sum(
        ordered, [], ["__d", ident], {"rank": F.lit(1).cast("long"), "hits": F.col("__y")}
    )
    total = ordered.agg(F.count(F.lit(1)).alias("n")).scalar()
    return run.select(
        ident, "rank", (F.col("rank") / total).alias("coverage"),
        (1 - F.col("hits") / F.col("rank")).alias("risk"),
    )


def within_problem(df: DataFrame, score: str, label: str, problem: str = "problem_id") -> DataFrame:
    """AUROC per problem with its failure and pair weights; single-class problems drop out."""
    per = auroc(df, score, label, [problem]).where(F.col("auroc").isNotNull())
    return per.select(
        problem, "auroc", F.col("negatives").alias("failures"), F.col("positives").alias("successes")
    )


def within_problem_summary(per: DataFrame, above: float = 0.6) -> DataFrame:
    w, v = F.col("failures"), F.col("failures") * F.col("successes")
    return per.agg(
        F.count(F.lit(1)).alias("problems"),
        ratio(F.sum(F.col("auroc") * w), F.sum(w)).alias("failure_weighted"),
        ratio(F.sum(F.col("auroc") * v), F.sum(v)).alias("pair_weighted"),
        F.max("auroc").alias("max_auroc"), count_where(F.col("auroc") > above).alias("above_threshold"),
    )


def spearman(df: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation per key from average ranks."""
    clean = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, left, right)
    ranked = mid_ranks(mid_ranks(clean, keys, left, "__a"), keys, right, "__b")
    return ranked.groupBy(*keys).agg(F.corr("__a", "__b").alias("rho"), F.count(F.lit(1)).alias("n"))
