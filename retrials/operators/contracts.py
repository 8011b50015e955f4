"""Contracts and audits: violations are tables, enforcement is lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.numeric import count_where


def require(df: DataFrame, check: DataFrame, message: str) -> DataFrame:
    """``df``, failing when run if the one-row, one-column ``check`` is not TRUE."""
    passed = F.coalesce(F.col(f"`{check.columns[0]}`"), F.lit(False))
    verdict = check.select(F.when(passed, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")).alias("ok"))
    return df.where(verdict.scalar())


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    check = duplicates(df, keys).agg((F.count(F.lit(1)) == 0).alias("ok"))
    return require(df, check, f"{what}: duplicate key {list(keys)}")


def require_all(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Every row must meet ``condition``; checked row by row while the plan runs."""
    return df.where(
        F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.lit(message)).cast("boolean")
        )
    )


def split_overlap(df: DataFrame, problem: str = "problem_id", split: str = "research_split") -> DataFrame:
    """Problems shared by each pair of splits; every pair of present splits is listed."""
    names = df.select(F.col(split).alias("s")).distinct()
    sets = df.groupBy(problem).agg(F.sort_array(F.collect_set(split)).alias("s"))
    pairs = sets.where(F.size("s") > 1).select(F.explode("s").alias("left_split"), "s").select(
        "left_split", F.explode("s").alias("right_split")
    ).where("left_split < right_split")
    counts = pairs.groupBy("left_split", "right_split").agg(F.count(F.lit(1)).alias("n"))
    grid = names.agg(F.sort_array(F.collect_set("s")).alias("a")).select(
        F.explode("a").alias("left_split"), "a"
    ).select("left_split", F.explode("a").alias("right_split")).where("left_split < right_split")
    return grid.join(counts, ["left_split", "right_split"], "left").select(
        "left_split", "right_split", F.coalesce("n", F.lit(0)).alias("shared_problems")
    )


def missing_by_feature(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """NULL or NaN counts per group and feature, long form."""
    wide = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_where(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in features],
    )
    long = wide.unpivot([group, "rows"], list(features), "feature", "missing")
    return long.withColumn("missing_rate", F.col("missing") / F.col("rows"))


def design_balance(df: DataFrame, seeds: int, problem_level: Mapping[str, str] | None = None) -> DataFrame:
    """Cells of model x level: problems, attempts and problems with exactly ``seeds`` seeds."""
    per = df.groupBy("model_key", "level", "problem_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seed").alias("k")
    )
    return per.groupBy("model_key", "level").agg(
        F.count(F.lit(1)).alias("problems"), F.sum("n").alias("trajectories"),
        count_where(F.col("k") == seeds).alias("complete_problems"),
    )


def unpaired_keys(df: DataFrame, keys: Sequence[str], models: int, model: str = "model_key") -> DataFrame:
    """Keys not present for every model: empty when all models share the same pairs."""
    return df.groupBy(*keys).agg(F.countDistinct(model).alias("models")).where(F.col("models") != models)


def panel_audit(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of expected, observed, missing, unexpected and duplicated keys in one pass."""
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("o"))
    wanted = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    both = seen.join(wanted, list(keys), "full_outer")
    o, e = F.coalesce("o", F.lit(0)), F.coalesce("e", F.lit(0))
    return both.agg(
        F.sum(e).cast("long").alias("expected"), F.sum(o).alias("observed"),
        count_where((e == 1) & (o == 0)).alias("missing"), count_where((e == 0) & (o > 0)).alias("unexpected"),
        count_where(o > 1).alias("duplicate_keys"),
    )


def disagreeing(df: DataFrame, key: str, fields: Sequence[str], across: str) -> DataFrame:
    """Keys whose immutable fields differ between values of ``across``."""
    return df.groupBy(key).agg(
        F.countDistinct(across).alias("sources"), F.countDistinct(F.struct(*fields)).alias("versions")
    ).where("versions > 1")


def completion_counters(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts of each value of each field, long form (kind, value, n)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("kind"), F.col(f).cast("string").alias("value")) for f in fields
    ]))
    return df.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


def table_digest(df: DataFrame, exclude: Sequence[str] = (), buckets: int = 4096) -> DataFrame:
    """Order-insensitive SHA-256 of a table in two levels, so no task holds every row digest.

    Columns are taken by sorted name.  Rows fall into buckets by digest prefix; a bucket
    digest is the XOR of its row digests' words plus a count, the table digest hashes the
    buckets in order.
    """
    cols = sorted(c for c in df.columns if c not in exclude)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])
    row = df.select(F.sha2(text, 256).alias("d"))
    words = [F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("long").alias(f"w{k}") for k in range(4)]
    keyed = row.select(*words, (F.conv(F.substring("d", 61, 3), 16, 10).cast("long") % buckets).alias("b"))
    per = keyed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(f"w{k}").alias(f"w{k}") for k in range(4)])
    line = F.concat_ws(":", "b", "n", *[f"w{k}" for k in range(4)])
    return per.agg(
        F.sum("n").alias("rows"),
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("b", line.alias("l")))), lambda s: s.l)), 256).alias("digest"),
    )
