"""Order statistics that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(x)`` puts one key into one task, and an
unpartitioned window puts the whole table there.  Here the order domain is cut at
a bounded, deterministic sample of its own values; windows run per (key, bucket),
bucket totals (at most CUTS+1 rows per key) are accumulated separately and joined
back.  The cut points are chosen by hash order, so a recomputed task, or a second
evaluation of the same plan, sees exactly the same buckets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize

MAX_CUTS = 1 << 14
_B = "__bucket"


def _cut_count(df: DataFrame) -> int:
    """As many cuts as shuffle partitions, within [8, MAX_CUTS]."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(MAX_CUTS, wanted))


def cut_points(df: DataFrame, order: Sequence[str]) -> Column:
    """Scalar subquery: sampled order values, as a two-level array for quick search."""
    width = math.ceil(math.sqrt(_cut_count(df)))
    key = F.struct(*[F.col(c) for c in order]).alias("o")
    return (
        df.select(key)
        .orderBy(F.xxhash64("o"), "o")
        .limit(width * width)
        .agg(F.array_sort(F.collect_set("o")).alias("a"))
        .select(
            F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.lit(width - 1)),
                    lambda i: F.slice("a", i * width + 1, width),
                ),
                lambda block: F.size(block) > 0,
            ).alias("blocks")
        )
        .scalar()
    )


def with_bucket(df: DataFrame, order: Sequence[str], cuts: Column | None = None) -> DataFrame:
    """Add a bucket number that never decreases along ``order``."""
    cuts = cut_points(df, order) if cuts is None else cuts
    width = math.ceil(math.sqrt(_cut_count(df)))

    def search(value: Column) -> Column:
        block = F.size(F.filter("__cuts", lambda b: F.element_at(b, 1) <= value))
        return F.get(F.transform(F.array(block), lambda k: F.when(k == 0, F.lit(0)).otherwise(
            (k - 1) * width + F.size(F.filter(F.get("__cuts", k - 1), lambda v: v <= value))
        )), 0)

    # Bound to a lambda variable the order value is computed once per row, not once per comparison.
    key = F.struct(*[F.col(c) for c in order])
    staged = df.withColumn("__cuts", cuts)
    number = F.coalesce(F.get(F.transform(F.array(key), search), 0), F.lit(0))
    return staged.withColumn(_B, number).drop("__cuts")


def index_bucket(index: str, chunk: int = 65536) -> Column:
    """Bucket of an integer index: at most ``chunk`` rows of one key."""
    return F.coalesce(F.floor(F.col(index) / chunk), F.lit(0).cast("long"))


def hash_bucket(df: DataFrame, hashed: str) -> Column:
    """Bucket of a uniform 60-bit hash: its leading bits, already in hash order."""
    bits = max(3, math.ceil(math.log2(_cut_count(df))))
    return F.coalesce(F.shiftright(F.col(hashed), 60 - bits), F.lit(0).cast("long"))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    cuts: Column | None = None,
    hashed: bool = False,
    bucket: Column | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums per key along ``order``; ties of ``order`` must not matter.

    Keys must be non-NULL.  ``cuts`` may be given to reuse the cut points of a cheaper
    table over the same order domain; ``hashed`` says the first order column is a
    uniform 60-bit hash, which needs no cut points at all; ``bucket`` is any other
    expression that never decreases along ``order``; ``totals`` maps the name of a key's
    total to that of its running sum, so that no row has to be joined to it by key.
    """
    totals = totals or {}
    if bucket is not None:
        bucketed = df.withColumn(_B, bucket)
    elif hashed:
        bucketed = df.withColumn(_B, hash_bucket(df, order[0]))
    else:
        bucketed = with_bucket(df, order, cuts)
    spans = [*keys, _B]
    local = Window.partitionBy(*spans).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    parts = bucketed.groupBy(*spans).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    offsets = parts.select(
        *spans, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__p_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(Window.partitionBy(*keys)).alias(t) for t, n in totals.items()],
    )
    rows = bucketed.select("*", *[F.sum(c).over(local).alias(f"__l_{n}") for n, c in sums.items()])
    # merged, as the rows are in this order already: a written table's encoded size says little of its rows, and Spark would send millions through the driver
    joined = rows.join(offsets.hint("merge"), spans, "inner")
    kept = [c for c in df.columns if c not in sums]
    return joined.select(
        *kept, *[(F.col(f"__l_{n}") + F.col(f"__p_{n}")).alias(n) for n in sums], *totals
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", hashed: bool = False, count: str | None = None
) -> DataFrame:
    """1-based row number per key, with the key's size as ``count`` if named; ``order`` must identify a row."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("long")}, hashed=hashed, totals={count: name} if count else None)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **weights: Column) -> DataFrame:
    """Distinct (key, value) with summed weights: the pre-aggregation of every rank."""
    weights = weights or {"n": F.lit(1).cast("long")}
    return df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of ``value`` within each key, ties sharing their mean rank."""
    counts = materialize(value_counts(df, keys, value))
    ranked = running_sum(counts, keys, [value], {"__upto": F.col("n")}).select(
        *keys, value, (F.col("__upto") - (F.col("n") - 1) / F.lit(2.0)).alias(name)
    )
    return df.join(ranked, [*keys, value], "inner")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of ``probs``.

    NULL values are ignored.  Equal to ``percentile`` but without holding a key's
    distinct values in one task.
    """
    clean = df.where(F.col(value).isNotNull())
    counts = materialize(value_counts(clean, keys, value))
    placed = running_sum(counts, keys, [value], {"__upto": F.col("n")}, totals={"__n": "__upto"})
    picks = []
    for name, p in probs.items():
        target = (F.col("__n") - 1) * F.lit(float(p))
        for end, rank in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            hit = (F.col("__upto") > rank) & (F.col("__upto") - F.col("n") <= rank)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"{end}_{name}"))
    best = placed.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)
    out = []
    for name, p in probs.items():
        target = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        out.append((lo + (hi - lo) * (target - F.floor(target))).alias(name))
    return best.select(*keys, *out)


def with_previous(
    df: DataFrame, key: Sequence[str], index: str, columns: Mapping[str, tuple[str, int]], chunk: int = 4096
) -> DataFrame:
    """Lag along a dense 0-based integer index without holding a run in one task.

    ``columns`` maps an output name to (input, lag); a negative lag looks ahead.  The
    index is cut into chunks and each chunk receives a copy of its neighbours' edge rows.
    """
    back = max([k for _, k in columns.values() if k > 0], default=0)
    ahead = max([-k for _, k in columns.values() if k < 0], default=0)
    i, size = F.col(index), F.lit(chunk)
    home = F.floor(i / size)
    # A row is copied into each chunk that needs it as a neighbour.
    first, last = F.floor((i - ahead) / size), F.floor((i + back) / size)
    spread = df.withColumn("__chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    spread = spread.withColumn("__home", F.col("__chunk") == home)
    w = Window.partitionBy(*key, "__chunk").orderBy(index)
    for name, (source, k) in columns.items():
        c = F.lag(source, k).over(w) if k > 0 else F.lead(source, -k).over(w)
        spread = spread.withColumn(name, c)
    return spread.where("__home").drop("__chunk", "__home")
