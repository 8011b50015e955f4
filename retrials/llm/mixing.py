"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Budgets are filled like water: a source's share follows its weight until it holds ``cap`` times
the source.  Complete epochs come first; what is left of a budget takes documents by their
exponential keys -ln(u) / quality, summed up within the source.  The sum never sorts a source in
one task: keys fall into buckets whose totals are summed, and only the bucket in which the budget
ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrials.llm.common import SPACE, stored

CYCLE = (3, 1, 2)
SIGNS = "#*$%&|<>!"
WHITE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, SPACE))).otherwise(0).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for clean prose, falling with the number of signs a word: 1 / (1 + 4 * signs / words)."""
    signs = F.length(text) - F.length(F.translate(text, SIGNS, ""))
    return 1.0 / (1.0 + 4.0 * F.coalesce(signs, F.lit(0)) / F.greatest(size, F.lit(1)))


def uniform(key: Column, seed: int) -> Column:
    """(0, 1) from 52 bits of the MD5 of the key and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, share_pct: int, cap: int) -> DataFrame:
    """From (source, source_size): weight, target.  One row per source; the ordering is over sources, not documents."""
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in CYCLE]), (rank % len(CYCLE)).cast("int")).cast("long")
    t = sizes.withColumn("weight", weight)
    # a source is full first if its cap per weight is small; 6 is divisible by every weight
    t = t.withColumn("fills", cap * F.col("source_size") * (6 / F.col("weight")).cast("long")).withColumn("all", F.sum("source_size").over(every))
    before = Window.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = (t.withColumn("full", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
         .withColumn("open", F.sum("weight").over(after)))
    # the budget left (in hundredths) at the first source that isn't full gives the level of all that follow
    open_ = 100 * cap * F.col("source_size") * F.col("open") >= F.col("weight") * (share_pct * F.col("all") - 100 * F.col("full"))
    t = t.withColumn("is_open", open_)
    first = F.min(F.when(F.col("is_open"), F.struct("fills", F.col("source").isNull().alias("nul"), "source", "full", "open"))).over(every)
    t = t.withColumn("level", first)
    is_full = F.struct("fills", F.col("source").isNull().alias("nul"), "source") < F.struct("level.fills", F.col("level.nul").alias("nul"), F.col("level.source").alias("source"))
    level = (F.col("weight") * (share_pct * F.col("all") - 100 * F.col("level.full"))).cast("double") / (100 * F.col("level.open")).cast("double")
    return t.select("source", "source_size", "weight", F.when(F.col("level").isNull() | is_full, (cap * F.col("source_size")).cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, share_pct: int = 150, cap: int = 2, seed: int = 17, buckets: int = 1024,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, epochs, and
    is_cut for the document in which a budget ends (its first words fill the rest; at most one a source).

    Null or empty text has size 0 and is never taken.  A null source comes last in the order of
    sources.  Repeated rows are documents of their own; rows with one key, size and id share the
    place in the order, and a budget that ends among them is dealt to them one after another.
    ``buckets`` only deals out the work; results don't depend on it.  Other columns are not read;
    an empty table gives no rows."""
    size = word_count(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), size.alias("size"), F.col(text).alias("text"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("id"), seed)) / quality_weight(F.col("text"), F.col("size"))).drop("text")
    rows = stored(rows.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key"))))), "mix")
    by_bucket = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share_pct, cap)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    t, b = targets.alias("t"), by_bucket.alias("b")
    w = Window.partitionBy("b.source").orderBy("b.bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (b.join(t, F.col("b.source").eqNullSafe(F.col("t.source")))
             .select(F.col("b.source").alias("source"), F.col("b.bucket").alias("bucket"), "bucket_size", "source_size", "target", "epochs", "rest",
                     F.coalesce(F.sum("bucket_size").over(w), F.lit(0)).alias("before")))
    r, e = rows.alias("r"), edges.alias("e")
    both = r.join(e, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.bucket"))).select(
        F.col("r.id").alias("id"), F.col("r.source").alias("source"), "size", "key", "source_size", "target", "epochs", "rest", "before", "bucket_size")
    ends_here = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size"))
    within = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = both.where(ends_here).withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.least(F.col("rest") - F.col("sum"), F.col("size")), F.lit(0))
    plain = both.where(~ends_here).withColumn("part", F.when(F.col("before") + F.col("bucket_size") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    cols = ["id", "source", "size", "source_size", "target", "epochs", "part"]
    out = plain.select(*cols).unionByName(last.withColumn("part", part).select(*cols))
    return out.select(
        F.col("id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.col("epochs").cast("long").alias("epochs"), ((F.col("part") > 0) & (F.col("part") < F.col("size"))).alias("is_cut"))
