"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.operators import discrimination as D
from retrials.operators import resampling as B


def problem_outcomes(attempts: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(problem, class) counts with both pass rates.

    All attempts of a problem with the same outcome share one leave-one-out rate, so
    this table, at most two rows per problem, carries the whole analysis and the
    attempts are read once.
    """
    t = attempts.groupBy(problem).agg(
        F.sum(F.col("correct").cast("long")).alias("s"), F.count(F.lit(1)).alias("k")
    ).where("k >= 2")
    sides = F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("y"), F.col("s").alias("n")),
        F.struct(F.lit(0).cast("long").alias("y"), (F.col("k") - F.col("s")).alias("n")),
    )).alias("side")
    return t.select(problem, "s", "k", sides).where("side.n > 0").select(
        problem, F.col("side.y").alias("y"), F.col("side.n").alias("n"),
        ((F.col("s") - F.col("side.y")) / (F.col("k") - 1)).alias("loo_rate"),
        (F.col("s") / F.col("k")).alias("problem_rate"),
    )


def _histogram(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    return rows.groupBy(*keys, score).agg(
        F.sum(F.col("y") * F.col("n")).alias("pos"), F.sum((1 - F.col("y")) * F.col("n")).alias("neg")
    )


def difficulty_ceiling(attempts: DataFrame, draws: int = B.DRAWS, seed: str = "b") -> DataFrame:
    """How well the pass rate of the other attempts forecasts one attempt, with its interval."""
    rows = materialize(problem_outcomes(attempts))
    size = rows.agg(
        F.countDistinct("problem_id").alias("problems"), F.sum("n").alias("attempts"),
        (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("base_rate"),
    )
    hist = _histogram(rows, ["problem_id"], "loo_rate")
    reps = B.replicate_auroc(hist, "loo_rate", draws=draws, seed=seed)

    def point(score: str) -> DataFrame:
        return materialize(D.auroc_from_histogram(materialize(_histogram(rows, [], score)), [], score).select("auroc"))

    # written one by one, so that the driver never holds the plan of all of them
    ci, whole = materialize(B.interval(reps, [], "value")), materialize(size)
    return ci.join(whole, F.lit(True)).withColumn(
        "auroc_loo", point("loo_rate").scalar()
    ).withColumn("auroc_upper", point("problem_rate").scalar())
