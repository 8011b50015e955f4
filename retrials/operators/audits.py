"""Pilot and cohort audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrials.functions.numeric import rate
from retrials.functions.ordered import quantiles


def pilot_audit(attempts: DataFrame, planned_problems: int) -> DataFrame:
    """Coverage, accuracy, token medians and maxima, and the projected total per cell."""
    cells = ["model_key", "level"]
    base = attempts.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("attempts"), F.countDistinct("problem_id").alias("problems"), rate(F.col("correct")).alias("accuracy"),
        F.max("tokens").alias("max_tokens"), F.sum("tokens").alias("__s"),
    )
    projected = F.floor(F.col("__s") * planned_problems / F.col("problems"))
    both = (F.col("accuracy") > 0) & (F.col("accuracy") < 1)
    med = quantiles(attempts, cells, "tokens", {"median_tokens": 0.5})
    return base.join(med, cells).withColumn("projected_tokens", projected).withColumn("both_labels", both).drop("__s")


def complete_seed_coverage(attempts: DataFrame, seeds: int, prefixes: Sequence[int]) -> DataFrame:
    """Per prefix: problems with all seeds still active, their attempts and the covered share."""
    total = attempts.agg(F.countDistinct("problem_id").alias("n")).scalar()
    grid = F.filter(F.array(*[F.lit(p).cast("long") for p in prefixes]), lambda p: p <= F.col("tokens"))
    active = attempts.select("problem_id", "seed", F.explode(grid).alias("prefix_length"))
    full = active.groupBy("problem_id", "prefix_length").agg(F.countDistinct("seed").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("k") == seeds)
    return full.groupBy("prefix_length").agg(F.count(F.lit(1)).alias("problems"), F.sum("n").alias("attempts")).withColumn(
        "coverage", F.col("problems") / total
    )


def mid_band(attempts: DataFrame, low: float, high: float) -> DataFrame:
    """Attempts of problems whose pass rate lies in [low, high)."""
    band = attempts.groupBy("problem_id").agg(rate(F.col("correct")).alias("__r")).where((F.col("__r") >= low) & (F.col("__r") < high))
    return attempts.join(band.select("problem_id"), "problem_id", "left_semi")
