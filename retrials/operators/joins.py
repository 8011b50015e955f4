"""Joins with cardinality contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.numeric import count_where
from retrials.functions.ordered import running_sum
from retrials.operators.contracts import require, require_unique


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join after both sides are proven unique on ``keys``."""
    return require_unique(left, keys, "left").join(require_unique(right, keys, "right"), list(keys))


def full_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one join; any key present on one side only is an error."""
    sides = left.select(*keys, F.lit(1).alias("__l")).join(right.select(*keys, F.lit(1).alias("__r")), list(keys), "full_outer")
    check = sides.agg((count_where(F.col("__l").isNull() | F.col("__r").isNull()) == 0).alias("ok"))
    return require(left.join(right, list(keys)), check, f"keys {list(keys)} do not cover each other")


def one_sided_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys a full-coverage join would complain about, with the side they are on."""
    a = left.select(*keys).join(right.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("left"))
    b = right.select(*keys).join(left.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)


def many_to_one(left: DataFrame, lookup: DataFrame, keys: Sequence[str], required: str) -> DataFrame:
    """Left join to a unique lookup; a row without a match is an error."""
    joined = left.join(require_unique(lookup, keys, "lookup"), list(keys), "left")
    ok = F.when(F.col(required).isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"no {required} for some row")).cast("boolean")
    )
    return joined.where(ok)


def align_predictions(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two prediction sets on identical rows."""
    return full_coverage(left, right, keys)


def common_to_all(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys present in every group."""
    groups = df.agg(F.countDistinct(group).alias("n")).scalar()
    return df.groupBy(key).agg(F.countDistinct(group).alias("__n")).where(F.col("__n") == groups).select(key)


def disjoint_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two panels that must not share a key."""
    shared = left.select(*keys).intersect(right.select(*keys)).agg((F.count(F.lit(1)) == 0).alias("ok"))
    return require(left.unionByName(right), shared, f"panels overlap on {list(keys)}")


def ecdf_lookup(
    rows: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, name: str = "percentile"
) -> DataFrame:
    """Right-continuous ECDF of each value in ``reference``: count(ref <= x) / n.

    Both sides are collapsed to distinct values, merged, and one running sum of
    reference counts answers every lookup (ties count the reference first).
    """
    ref = reference.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    asked = rows.select(*keys, value).distinct().withColumn("__c", F.lit(0).cast("long"))
    merged = ref.unionByName(asked).groupBy(*keys, value).agg(F.sum("__c").alias("__c"))
    from retrials.functions.lineage import materialize
    run = running_sum(materialize(merged), keys, [value], {"__upto": F.col("__c")})
    sizes = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    cdf = run.join(sizes, list(keys)).select(*keys, value, (F.col("__upto") / F.col("__n")).alias(name))
    return rows.join(cdf, [*keys, value])


def arm_pivot(long: DataFrame, keys: Sequence[str], arms: Sequence[str], values: Sequence[str], same: str) -> DataFrame:
    """Arms side by side; incomplete branches drop out, differing ``same`` is an error."""
    aggs = [F.max(F.when(F.col("arm") == a, F.col(v))).alias(f"{a}_{v}") for a in arms for v in values]
    wide = long.where(F.col("arm").isin(list(arms))).groupBy(*keys).agg(
        *aggs, F.countDistinct("arm").alias("__arms"), F.min(same).alias(same), F.max(same).alias("__hi")
    ).where(F.col("__arms") == len(arms))
    ok = F.when(F.col(same) == F.col("__hi"), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{same} differs between arms")).cast("boolean")
    )
    return wide.where(ok).drop("__arms", "__hi")


def is_prefix(short: Column, long: Column) -> Column:
    """Is one token array the beginning of the other."""
    return (F.size(short) <= F.size(long)) & (F.slice(long, 1, F.greatest(F.size(short), F.lit(1))) == F.slice(short, 1, F.greatest(F.size(short), F.lit(1))))


def chosen(arm: Column, pattern: str, arms: Sequence[str]) -> Column:
    """The value of the column named after the chosen arm; an unknown arm is an error."""
    out = None
    for a in arms:
        c = F.col(pattern.format(a))
        out = F.when(arm == a, c) if out is None else out.when(arm == a, c)
    return out
