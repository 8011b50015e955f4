"""Null, NaN and rounding rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def flag(condition: Column) -> Column:
    """0/1 long from a boolean; NULL stays NULL."""
    return condition.cast("int").cast("long")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, NULL for an empty denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def mean_where(value: Column, condition: Column) -> Column:
    """Aggregate: mean of ``value`` over rows meeting ``condition``."""
    return F.avg(F.when(condition, value.cast("double")))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(flag(condition)), F.lit(0).cast("long"))


def rate(condition: Column) -> Column:
    """Aggregate: share of TRUE among non-NULL."""
    return F.avg(flag(condition).cast("double"))


def binary_entropy(p: Column) -> Column:
    """Entropy of a Bernoulli rate in bits; exactly 0 at both ends."""
    inside = (p > 0) & (p < 1)
    q = F.when(inside, p).otherwise(F.lit(0.5))
    bits = -(q * F.ln(q) + (1 - q) * F.ln(1 - q)) / F.ln(F.lit(2.0))
    return F.when(p.isNull(), None).when(inside, bits).otherwise(F.lit(0.0))


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Report form: longs, doubles rounded to ``digits`` (NaN as NULL), no negative zero."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # The nudge decides exact decimal ties the same way whatever the summation order was.
            c = F.round(F.when(~F.isnan(c), c.cast("double")) + F.lit(3e-11), digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)
