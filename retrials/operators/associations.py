"""Rank associations, adjusted and partial variants, and standardised effects."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.functions.numeric import ratio
from retrials.functions.ordered import mid_ranks
from retrials.operators import resampling as B
from retrials.operators.aggregates import melt
from retrials.operators.discrimination import spearman
from retrials.operators.signals import standardise


def demeaned(df: DataFrame, groups: Sequence[str], values: Sequence[str], prefix: str = "adj_") -> DataFrame:
    """Values minus their group mean, by a partial aggregate and a join."""
    means = df.groupBy(*groups).agg(*[F.avg(v).alias(f"__m_{v}") for v in values])
    out = df.join(means, list(groups))
    for v in values:
        out = out.withColumn(prefix + v, F.col(v) - F.col(f"__m_{v}"))
    return out.drop(*[f"__m_{v}" for v in values])


def level_adjusted_spearman(df: DataFrame, left: str, right: str, groups: Sequence[str], level: str = "level") -> DataFrame:
    """Spearman's rho as is and after removing level means, per group.

    Adjusted values are rounded to 12 digits, so that ties don't hang on the last bits of a mean, and written: a mean
    that is summed again in another order would not meet the ranks of its first sum."""
    raw = spearman(df, left, right, groups).select(*groups, F.col("rho").alias("raw_rho"), "n")
    adj = demeaned(df, [*groups, level], [left, right])
    adj = materialize(adj.select(*groups, *[F.round(f"adj_{v}", 12).alias(f"adj_{v}") for v in (left, right)]))
    adjusted = spearman(adj, f"adj_{left}", f"adj_{right}", groups).select(*groups, F.col("rho").alias("adjusted_rho"))
    return raw.join(adjusted, list(groups))


def level_trends(df: DataFrame, metrics: Sequence[str], groups: Sequence[str], level: str = "level") -> DataFrame:
    """Spearman's rho of each metric with level, per group and metric."""
    long = melt(df, [*groups, level], metrics)
    return spearman(long, level, "value", [*groups, "metric"])


def two_way_correlation(
    df: DataFrame, left: str, right: str, factors: tuple[str, str] = ("level", "category"),
    groups: Sequence[str] = (), sweeps: int = 8,
) -> DataFrame:
    """Correlation of ranks after removing two additive fixed effects.

    The effects depend on cell counts and sums only, so they are fitted on the (factor x factor)
    table of a group, never on its rows.
    """
    keys, (f1, f2) = list(groups), factors
    clean = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, f1, f2, left, right)
    ranked = materialize(mid_ranks(mid_ranks(clean, keys, left, "a"), keys, right, "b"))
    cells = ranked.groupBy(*keys, f1, f2).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"))

    def effects_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Fitted additive effects of each cell: each factor's effect in turn is the mean left by the other's."""
        (i, _), (j, _) = pd.factorize(pdf[f1]), pd.factorize(pdf[f2])
        count = np.zeros((i.max() + 1, j.max() + 1))
        count[i, j] = pdf["n"]
        out = pdf.copy()
        for col in ("a", "b"):
            total = np.zeros_like(count)
            total[i, j] = pdf["n"] * pdf[col]
            second = np.zeros(count.shape[1])
            for _ in range(sweeps):
                first = (total.sum(1) - count @ second) / count.sum(1)
                second = (total.sum(0) - count.T @ first) / count.sum(0)
            out[col] = first[i] + second[j]
        return out

    shape = cells.schema
    effects = cells.groupBy(*keys).applyInPandas(effects_of, shape).select(*keys, f1, f2, F.col("a").alias("ea"), F.col("b").alias("eb"))
    rows = ranked.join(effects, [*keys, f1, f2])
    return rows.groupBy(*keys).agg(
        F.corr(F.col("a") - F.col("ea"), F.col("b") - F.col("eb")).alias("rho"), F.count(F.lit(1)).alias("n")
    )


def residuals(df: DataFrame, targets: Sequence[str], categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Least-squares residual of each target on one-hot and numeric controls (suffix ``_res``)."""
    stages = [StringIndexer(inputCols=list(categorical), outputCols=[f"__i_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=[f"__i_{c}" for c in categorical], outputCols=[f"__h_{c}" for c in categorical])]
    stages.append(VectorAssembler(inputCols=[f"__h_{c}" for c in categorical] + list(numeric), outputCol="__x"))
    out = Pipeline(stages=stages).fit(df).transform(df)
    for t in targets:
        model = LinearRegression(featuresCol="__x", labelCol=t, predictionCol=f"__p_{t}", solver="normal", regParam=0.0).fit(out)
        out = model.transform(out).withColumn(f"{t}_res", F.col(t) - F.col(f"__p_{t}")).drop(f"__p_{t}")
    return out.select(*df.columns, *[f"{t}_res" for t in targets])


def partial_spearman(df: DataFrame, left: str, right: str, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    rows = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return spearman(residuals(materialize(rows), [left, right], categorical, numeric), f"{left}_res", f"{right}_res")


def _rank_all(df: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    out = df.select(ident, *columns)
    for c in columns:
        out = mid_ranks(out, [], c, f"__r_{c}")
    return out


def cross_block(df: DataFrame, ident: str, left: Sequence[str], right: Sequence[str], categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Partial Spearman of every left feature with every right one; each is residualised once."""
    names = [*left, *right]
    res = [f"{n}_res" for n in names]
    ranked = _rank_all(materialize(residuals(materialize(df), names, categorical, numeric)), ident, res)
    wide = ranked.agg(*[F.corr(f"__r_{a}_res", f"__r_{b}_res").alias(f"{a}|{b}") for a in left for b in right])
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), F.col(f"`{a}|{b}`").alias("rho")) for a in left for b in right
    ]))
    return wide.select(cells.alias("c")).select("c.*")


def redundancy_matrix(df: DataFrame, ident: str, strata: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Spearman of all feature pairs after within-stratum standardising; NULL -> 0, diagonal 1."""
    z = standardise(df.select(ident, *strata, *features), strata, features)
    ranked = _rank_all(materialize(z), ident, [f"z_{f}" for f in features])
    pairs = list(combinations(features, 2))
    wide = ranked.agg(*[F.coalesce(F.corr(f"__r_z_{a}", f"__r_z_{b}"), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(f"`{x}|{y}`").alias("rho")) for x, y in pairs for a, b in ((x, y), (y, x))]
    cells += [F.struct(F.lit(f).alias("row"), F.lit(f).alias("column"), F.lit(1.0).alias("rho")) for f in features]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def correctness_effect(
    df: DataFrame, value: str, strata: Sequence[str], cluster: str = "problem_id", draws: int = B.DRAWS, seed: str = "b"
) -> DataFrame:
    """Standardised mean difference, correct minus incorrect, per stratum, with a clustered interval."""
    y = F.col("correct")
    scale = df.groupBy(*strata).agg(F.stddev_samp(value).alias("__s"))
    z = df.join(scale.where(F.col("__s") > 0), list(strata)).withColumn("__z", F.col(value) / F.col("__s"))
    stats = materialize(z.groupBy(*strata, cluster).agg(
        F.coalesce(F.sum(F.when(y, F.col("__z"))), F.lit(0.0)).alias("t1"), F.count(F.when(y, F.col("__z"))).alias("n1"),
        F.coalesce(F.sum(F.when(~y, F.col("__z"))), F.lit(0.0)).alias("t0"), F.count(F.when(~y, F.col("__z"))).alias("n0"),
    ))
    cols = ["t1", "n1", "t0", "n0"]
    gap = ratio(F.col("t1"), F.col("n1")) - ratio(F.col("t0"), F.col("n0"))
    point = stats.groupBy(*strata).agg(*[F.sum(c).alias(c) for c in cols]).select(*strata, gap.alias("effect"))
    reps = B.replicate_sums(stats, strata, cluster, cols, draws, seed).withColumn("value", gap)
    return point.join(B.interval(reps, strata, "value"), list(strata))
