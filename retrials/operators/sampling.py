"""Outcome-blind deterministic samples, splits, folds and strata.

Members are chosen by keyed hash order, so a larger sample contains a smaller one
and no seeded shuffle has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.keys import hash60
from retrials.functions.ordered import position
from retrials.operators.contracts import require

_H = "__hash"


def _key(seed: str, strata: Sequence[str], ident: str) -> Column:
    parts: list = [seed, ":"]
    for s in strata:
        parts += [F.col(s), ":"]
    return hash60(*parts, F.col(ident))


def hash_rank(
    df: DataFrame, seed: str, ident: str, strata: Sequence[str] = (), name: str = "hash_rank", salt: Sequence[str] | None = None,
    count: str | None = None,
) -> DataFrame:
    """1-based rank in hash order within each stratum; ``salt`` names the hashed columns, ``count`` the stratum's size."""
    keyed = df.withColumn(_H, _key(seed, strata if salt is None else salt, ident))
    return position(keyed, list(strata), [_H, ident], name, hashed=True, count=count).drop(_H)


def with_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Group size on every row, by a partial aggregate and a join."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, list(keys)) if keys else df.withColumn(name, counts.scalar())


def split_by_problem(
    problems: DataFrame, seed: str, train: float = 0.6, validation: float = 0.2,
    strata: Sequence[str] = (), ident: str = "problem_id",
) -> DataFrame:
    """Train/validation/test labels with banker-rounded sizes, optionally per stratum."""
    ranked = hash_rank(problems, seed, ident, strata, "__r", count="__n")
    n_train, n_val = F.bround(F.col("__n") * train), F.bround(F.col("__n") * validation)
    label = (
        F.when(F.col("__r") <= n_train, "train")
        .when(F.col("__r") <= n_train + n_val, "validation").otherwise("test")
    )
    return ranked.withColumn("research_split", label).drop("__r", "__n")


def low_high_strata(
    df: DataFrame, groups: Sequence[str], score: str, ident: str, name: str = "uncertainty_stratum"
) -> DataFrame:
    """Lower and upper half by exact rank; the odd median row stays unassigned."""
    ranked = position(df, list(groups), [score, ident], "__r", count="__n")
    half = F.floor(F.col("__n") / 2)
    label = (
        F.when(F.col("__r") <= half, "low").when(F.col("__r") > F.col("__n") - half, "high")
        .otherwise("unassigned")
    )
    return ranked.withColumn(name, label).drop("__r", "__n")


def balanced_sample(
    problems: DataFrame, seed: str, per_level: int, levels: Sequence[int], ident: str = "problem_id"
) -> DataFrame:
    """Exactly ``per_level`` rows of each level; a short level is an error."""
    pool = problems.where(F.col("level").isin(list(levels)))
    picked = hash_rank(pool, seed, ident, ["level"], "__r").where(F.col("__r") <= per_level).drop("__r")
    short = picked.groupBy("level").count().where(F.col("count") == per_level).agg(
        (F.count(F.lit(1)) == len(levels)).alias("ok")
    )
    return require(picked, short, "a level has fewer problems than requested")


def balanced_with_fill(
    problems: DataFrame, seed: str, size: int, ident: str = "problem_id", levels: int = 5
) -> DataFrame:
    """``size // levels`` of each level, the remainder from all leftover rows in hash order."""
    per_level = size // levels
    ranked = hash_rank(problems, seed, ident, ["level"], "__r")
    head = ranked.where(F.col("__r") <= per_level).drop("__r").withColumn("origin", F.lit("level"))
    rest = ranked.where(F.col("__r") > per_level).drop("__r")
    keyed = rest.withColumn(_H, hash60(f"{seed}:fill:", F.col(ident)))
    fill = keyed.orderBy(_H, ident).limit(size - per_level * levels).drop(_H)
    return head.unionByName(fill.withColumn("origin", F.lit("fill")))


def nested_sample(
    problems: DataFrame, seed: str, base_per_level: int, per_level: int, levels: Sequence[int], ident: str = "problem_id"
) -> DataFrame:
    """A balanced sample with a flag for its smaller balanced core."""
    pool = problems.where(F.col("level").isin(list(levels)))
    ranked = hash_rank(pool, seed, ident, ["level"], "__r").where(F.col("__r") <= per_level)
    marked = ranked.withColumn("in_base", F.col("__r") <= base_per_level).drop("__r")
    full = marked.groupBy("level").count().agg(
        ((F.count(F.lit(1)) == len(levels)) & (F.min("count") == per_level)).alias("ok")
    )
    return require(marked, full, "a level has fewer problems than requested")


def shards(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """Disjoint shards by row position modulo ``count``."""
    return position(df, [], list(order), "__r").withColumn("shard", (F.col("__r") - 1) % count).drop("__r")


def fixed_per_problem(
    attempts: DataFrame, seed: str, k: int, low: int, high: int, problem: str = "problem_id", ident: str = "run_id"
) -> DataFrame:
    """k attempts per problem, all of them where the success count lies in [low, high]."""
    wins = attempts.groupBy(problem).agg(F.sum(F.col("correct").cast("long")).alias("__w"))
    band = wins.select(problem, F.col("__w").between(low, high).alias("in_band"))
    ranked = hash_rank(attempts, seed, ident, [problem], "__r").join(band, problem)
    return ranked.where((F.col("__r") <= k) | F.col("in_band")).drop("__r")


def success_screen(
    attempts: DataFrame, samples: int, low: int, high: int, problem: str = "problem_id"
) -> DataFrame:
    """Problems whose first ``samples`` seeds are all present, with successes in [low, high]."""
    seen = attempts.where(F.col("seed") <= samples).groupBy(problem).agg(
        F.countDistinct("seed").alias("seeds"), F.sum(F.col("correct").cast("long")).alias("successes")
    )
    complete = seen.agg((F.min("seeds") == samples).alias("ok"))
    return require(seen.where(F.col("successes").between(low, high)), complete, "a problem lacks samples")


def evenly_spaced(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], picks: int
) -> DataFrame:
    """Rows at floor(linspace(0, n-1, picks)) of each group's order."""
    ranked = position(df, list(groups), list(order), "__r", count="__n")
    # Row i (0-based) is a grid point when some j in [0, picks) maps to it; j is near i*(picks-1)/(n-1).
    i, last = F.col("__r") - 1, F.col("__n") - 1
    j0 = F.when(last > 0, F.floor(i * (picks - 1) / F.greatest(last, F.lit(1)))).otherwise(F.lit(0))
    hit = F.exists(
        F.sequence(F.greatest(j0 - 1, F.lit(0)), F.least(j0 + 2, F.lit(picks - 1).cast("long"))),
        lambda j: F.floor(j * last / F.lit(max(picks - 1, 1))) == i,
    )
    small = F.col("__n") <= picks
    return ranked.where(small | hit).drop("__n").withColumnRenamed("__r", "rank")


def problem_folds(
    rows: DataFrame, seed: str, folds: int, problem: str = "problem_id", target: str = "correct"
) -> DataFrame:
    """Fold per problem: problems ranked by hash within their class-mix stratum, modulo k."""
    mix = rows.groupBy(problem).agg(
        F.min(F.col(target).cast("int")).alias("lo"), F.max(F.col(target).cast("int")).alias("hi")
    )
    stratum = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(2)).cast("long")
    ranked = hash_rank(mix.select(problem, stratum.alias("class_mix")), seed, problem, ["class_mix"], "__r", salt=[])
    return ranked.select(problem, "class_mix", ((F.col("__r") - 1) % folds).alias("fold"))


def sample_folds(
    rows: DataFrame, seed: str, folds: int, problem: str = "problem_id", target: str = "correct", ident: str = "run_id"
) -> DataFrame:
    """Fold per attempt, balanced inside every (problem, class)."""
    ranked = hash_rank(rows, seed, ident, [problem, target], "__r", salt=[])
    return ranked.withColumn("fold", (F.col("__r") - 1) % folds).drop("__r")


def representative(attempts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key along ``order``, by a mergeable minimum."""
    rest = [c for c in attempts.columns if c not in keys]
    front = F.struct(*order, *[c for c in rest if c not in order])
    return attempts.groupBy(*keys).agg(F.min(front).alias("__m")).select(*keys, "__m.*")


def fair_quota(
    states: DataFrame, seed: str, cap: int, run: str = "run_id", ident: str = "vec_id"
) -> DataFrame:
    """About ``cap`` rows over all runs: an equal quota each, leftovers in further passes."""
    ranked = hash_rank(states, seed, ident, [run], "__r", salt=[])
    runs = states.agg(F.countDistinct(run).alias("n")).scalar()
    quota = F.greatest(F.floor(F.lit(cap) / runs), F.lit(1))
    staged = ranked.withColumn("pass_number", F.floor((F.col("__r") - 1) / quota))
    keyed = staged.withColumn(_H, hash60(f"{seed}:", F.col(ident)))
    return keyed.orderBy("pass_number", run, _H).limit(cap).drop("__r", _H)


def complete_panel(attempts: DataFrame, models: int, exclude: DataFrame, low: int, high: int) -> DataFrame:
    """Problems present for every model, not excluded, with a solved count in [low, high]."""
    per = attempts.groupBy("problem_id", "level").agg(
        F.countDistinct("model_key").alias("models"), F.sum(F.col("correct").cast("long")).alias("solved")
    )
    kept = per.where((F.col("models") == models) & F.col("solved").between(low, high))
    return kept.join(exclude.select("problem_id"), "problem_id", "left_anti")


def first_per_level(sample: DataFrame, seed: str, ident: str = "problem_id") -> DataFrame:
    """Mark the first problem of every level in hash order as the pilot."""
    keyed = sample.withColumn(_H, _key(seed, ["level"], ident))
    first = keyed.groupBy("level").agg(F.min(F.struct(_H, ident)).alias("__m"))
    return sample.join(first.select("level", F.col("__m").getField(ident).alias("__first")), "level").select(
        *sample.columns, (F.col(ident) == F.col("__first")).alias("is_pilot")
    )


def subset_by_ids(problems: DataFrame, ids: DataFrame, ident: str = "problem_id") -> DataFrame:
    """Rows with a listed id; an id that matches nothing is an error."""
    missing = ids.select(ident).join(problems.select(ident), ident, "left_anti").agg(
        (F.count(F.lit(1)) == 0).alias("ok")
    )
    return require(problems.join(ids.select(ident), ident, "left_semi"), missing, "an id is not in the bundle")


def confirmation_and_challenge(
    problems: DataFrame, history: DataFrame, per_level: int, levels: Sequence[int],
    hard_level: int, hard_size: int, seeds: Mapping[str, str],
) -> DataFrame:
    """A balanced split panel plus a hard-level panel; both avoid history and each other."""
    fresh = problems.join(history.select("problem_id"), "problem_id", "left_anti")
    panel = split_by_problem(balanced_sample(fresh, seeds["panel"], per_level, levels), seeds["split"], strata=["level"])
    rest = fresh.join(panel.select("problem_id"), "problem_id", "left_anti")
    hard = balanced_sample(rest, seeds["hard"], hard_size, [hard_level]).withColumn("research_split", F.lit("challenge"))
    return panel.withColumn("panel", F.lit("confirmation")).unionByName(hard.withColumn("panel", F.lit("challenge")))
