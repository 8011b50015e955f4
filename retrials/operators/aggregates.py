"""Pass rates, cell summaries, paired contrasts and frontiers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.functions.numeric import binary_entropy, count_where, flag, mean_where, rate, ratio
from retrials.functions.ordered import quantiles
from retrials.operators import resampling as B

ARMS = ("short", "medium", "long")
CONTRASTS = (("medium_minus_short", "medium", "short"), ("long_minus_medium", "long", "medium"),
             ("long_minus_short", "long", "short"))


def pass_totals(df: DataFrame, problem: str = "problem_id", label: str = "correct") -> DataFrame:
    return df.groupBy(problem).agg(F.sum(F.col(label).cast("long")).alias("successes"), F.count(F.lit(1)).alias("k"))


def loo_pass_rate(df: DataFrame, totals: DataFrame | None = None, problem: str = "problem_id", label: str = "correct") -> DataFrame:
    """Leave-one-out pass rate of each attempt; problems with a single attempt drop out.

    ``totals`` may come from a larger table than the one analysed.  A hot problem is
    pre-aggregated, and the join back is one row per problem (AQE splits a skewed side).
    """
    totals = pass_totals(df, problem, label) if totals is None else totals
    y = F.col(label).cast("long")
    return df.join(totals.where("k >= 2"), problem).withColumn(
        "loo_rate", (F.col("successes") - y) / (F.col("k") - 1)
    )


def with_problem_rate(df: DataFrame, problem: str = "problem_id", label: str = "correct") -> DataFrame:
    """The non-LOO pass rate on every attempt (an upper reference, not a forecast)."""
    rates = df.groupBy(problem).agg(rate(F.col(label)).alias("problem_rate"))
    return df.join(rates, problem)


def k_distribution(df: DataFrame) -> DataFrame:
    """Problems and attempts by number of attempts, with base rate and all-fail/all-pass counts."""
    t = pass_totals(df)
    return t.groupBy("k").agg(
        F.count(F.lit(1)).alias("problems"), F.sum("k").alias("attempts"),
        ratio(F.sum("successes"), F.sum("k")).alias("base_rate"),
        count_where(F.col("successes") == 0).alias("all_fail"),
        count_where(F.col("successes") == F.col("k")).alias("all_pass"),
        count_where((F.col("successes") > 0) & (F.col("successes") < F.col("k"))).alias("intermediate"),
    )


def pass_rate_bands(df: DataFrame, width: int = 10) -> DataFrame:
    """Problems per equal-width pass-rate band, zero-filled, last band closed."""
    t = pass_totals(df)
    band = F.least(F.floor(F.col("successes") * width / F.col("k")), F.lit(width - 1).cast("long"))
    counts = t.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(width).select(F.col("id").alias("band"))
    return grid.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("problems"))


def seed_consistency(df: DataFrame) -> DataFrame:
    """Successes and distinct seeds per model and problem; NULL level or category stay groups."""
    return df.groupBy("model_key", "problem_id", "level", "category").agg(
        F.sum(F.col("correct").cast("long")).alias("successes"), F.countDistinct("seed").alias("seeds")
    )


def seed_instability(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per problem: success rate, its normalised entropy, mean and population sd of features."""
    p = rate(F.col("correct"))
    per = df.groupBy("problem_id").agg(
        F.min("level").alias("level"), F.min("category").alias("category"),
        F.countDistinct("seed").alias("seeds"), F.sum(F.col("correct").cast("long")).alias("correct_seeds"),
        p.alias("success_rate"),
        *[F.avg(f).alias(f"mean__{f}") for f in features],
        *[F.stddev_pop(f).alias(f"sd__{f}") for f in features],
    )
    return per.withColumn("failure_rate", 1 - F.col("success_rate")).withColumn(
        "seed_instability", binary_entropy(F.col("success_rate"))
    )


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form with double values."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(ids), list(metrics), name, value)


def cell_means(df: DataFrame, cells: Sequence[str], metrics: Sequence[str], problem: str = "problem_id") -> DataFrame:
    """Mean over problems of the problem mean, per cell and metric."""
    per = df.groupBy(*cells, problem).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return melt(per, [*cells, problem], metrics).groupBy(*cells, "metric").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("problems")
    )


def level_slopes(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Least-squares slope of problem means on level, per model and metric."""
    per = df.groupBy("model_key", "problem_id", "level").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return melt(per, ["model_key", "problem_id", "level"], metrics).groupBy("model_key", "metric").agg(
        F.regr_slope("value", "level").alias("slope_per_level"), F.count("value").alias("problems")
    )


def level_slope_difference(df: DataFrame, metrics: Sequence[str], left: str, right: str) -> DataFrame:
    """slope(right) - slope(left) over the problems both models have."""
    per = df.where(F.col("model_key").isin(left, right)).groupBy("problem_id", "level").agg(*[
        F.avg(F.when(F.col("model_key") == m, F.col(x).cast("double"))).alias(f"{side}__{x}")
        for side, m in (("l", left), ("r", right)) for x in metrics
    ])
    parts = per.select("level", F.explode(F.array(*[
        F.struct(F.lit(x).alias("metric"), F.col(f"l__{x}").alias("lv"), F.col(f"r__{x}").alias("rv")) for x in metrics
    ])).alias("m")).select("level", "m.*").where("lv is not null and rv is not null")
    return parts.groupBy("metric").agg(
        (F.regr_slope("rv", "level") - F.regr_slope("lv", "level")).alias("difference"),
        F.count(F.lit(1)).alias("pairs"),
    )


def condition_summary(df: DataFrame, groupings: Sequence[Sequence[str]], metrics: Sequence[str]) -> DataFrame:
    """Counts, problems and metric means for several grouping sets in one pass (NULL = pooled)."""
    names = sorted({c for g in groupings for c in g})
    sets = [[F.col(c) for c in g] for g in groupings]
    return df.groupingSets(sets, *[F.col(c) for c in names]).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("problem_id").alias("problems"),
        *[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in metrics],
    )


def paired_conditions(df: DataFrame, keys: Sequence[str], condition: str, left: str, right: str, value: str) -> DataFrame:
    """One row per key present under both conditions, by one conditional aggregate."""
    pair = df.where(F.col(condition).isin(left, right)).groupBy(*keys).agg(
        F.max(F.when(F.col(condition) == left, F.col(value).cast("double"))).alias("left_value"),
        F.max(F.when(F.col(condition) == right, F.col(value).cast("double"))).alias("right_value"),
    )
    return pair.where("left_value is not null and right_value is not null").withColumn(
        "difference", F.col("right_value") - F.col("left_value")
    )


def marginal_returns(df: DataFrame, budgets: Sequence[str], value: str = "{}_correct", cost: str = "{}_tokens") -> DataFrame:
    """Mean gain and mean extra cost between successive budgets of paired rows."""
    steps = F.explode(F.array(*[
        F.struct(
            F.lit(f"{a}->{b}").alias("step"),
            (F.col(value.format(b)).cast("double") - F.col(value.format(a)).cast("double")).alias("gain"),
            (F.col(cost.format(b)) - F.col(cost.format(a))).cast("double").alias("extra"),
        ) for a, b in zip(budgets, budgets[1:])
    ]))
    return df.select(steps.alias("s")).groupBy("s.step").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("s.gain").alias("mean_gain"), F.avg("s.extra").alias("mean_extra_cost"),
        ratio(F.sum("s.gain") * 1000, F.sum("s.extra")).alias("gain_per_1000"),
    )


def melt_arms(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Paired arms in long form: (ids, arm, correct, tokens)."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("arm"), F.col(f"{a}_correct").alias("correct"), F.col(f"{a}_tokens").alias("tokens"))
        for a in ARMS
    ]))
    return df.select(*ids, rows.alias("r")).select(*ids, "r.*")


def arm_summary(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Accuracy, finished share, capped count and tokens per model and arm."""
    long = melt_arms(df, ["model_key", "problem_id"])
    cap = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    capped = F.col("tokens") >= F.try_element_at(cap, F.col("arm"))
    return long.withColumn("capped", capped).groupBy("model_key", "arm").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("problem_id").alias("problems"),
        rate(F.col("correct")).alias("accuracy"), rate(~F.col("capped")).alias("finished_rate"),
        count_where(F.col("capped")).alias("capped"), F.avg("tokens").alias("mean_tokens"),
    )


def transition_label(a: Column, b: Column) -> Column:
    return (
        F.when(~a & b, "wrong_to_correct").when(a & ~b, "correct_to_wrong")
        .when(a & b, "stable_correct").otherwise("stable_wrong")
    )


TRANSITIONS = ("wrong_to_correct", "correct_to_wrong", "stable_correct", "stable_wrong")


def matched_transitions(df: DataFrame, left: str, right: str, right_cap: int) -> DataFrame:
    """Transitions between two arms and the class of the extended outcome."""
    a, b = F.col(f"{left}_correct"), F.col(f"{right}_correct")
    done = F.col(f"{right}_tokens") < right_cap
    extended = F.when(done & b, "finished_correct").when(done, "finished_wrong").otherwise("still_capped")
    return df.select("model_key", transition_label(a, b).alias("transition"), extended.alias("extended_outcome")).groupBy(
        "model_key", "transition", "extended_outcome"
    ).agg(F.count(F.lit(1)).alias("rows"))


def fate_shares(df: DataFrame, capped: Column, fate: Column) -> DataFrame:
    """Shares of each fate among capped rows within a model."""
    counts = df.where(capped).groupBy("model_key", fate.alias("fate")).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("model_key").agg(F.sum("rows").alias("model_rows"))
    return counts.join(totals, "model_key").withColumn("share", F.col("rows") / F.col("model_rows"))


def budget_effects(df: DataFrame) -> DataFrame:
    """Per stratum: arm accuracies, three contrasts and rescued/harmed counts, plus high - low."""
    def acc(a):
        return rate(F.col(f"{a}_correct"))

    aggs = [F.count(F.lit(1)).alias("paired_branches"), F.countDistinct("problem_id").alias("problems")]
    aggs += [acc(a).alias(f"{a}_accuracy") for a in ARMS]
    for name, hi, lo in CONTRASTS:
        h, l = F.col(f"{hi}_correct"), F.col(f"{lo}_correct")
        aggs += [(acc(hi) - acc(lo)).alias(name), count_where(h & ~l).alias(f"{hi}_vs_{lo}_rescued"),
                 count_where(~h & l).alias(f"{hi}_vs_{lo}_harmed")]
    strata = df.where(F.col("uncertainty_stratum").isin("low", "high")).groupBy("uncertainty_stratum").agg(*aggs)

    def gap(c):
        return (F.max(F.when(F.col("uncertainty_stratum") == "high", F.col(c)))
                - F.max(F.when(F.col("uncertainty_stratum") == "low", F.col(c)))).alias(c)

    inter = strata.agg(*[gap(n) for n, _, _ in CONTRASTS]).withColumn("uncertainty_stratum", F.lit("high_minus_low"))
    return strata.unionByName(inter, allowMissingColumns=True)


def dose_response(df: DataFrame) -> DataFrame:
    """Accuracy by scope (pooled or model) x stratum x arm."""
    long = melt_arms(df, ["model_key", "uncertainty_stratum", "problem_id"])
    s, a, m = F.col("uncertainty_stratum"), F.col("arm"), F.col("model_key")
    return long.groupingSets([[s, a], [m, s, a]], m, s, a).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("problem_id").alias("problems"),
        rate(F.col("correct")).alias("accuracy"),
    ).withColumn("model_key", F.coalesce("model_key", F.lit("pooled")))


def contrast_table(df: DataFrame) -> DataFrame:
    """Difference, rescued, harmed and net per scope x stratum x contrast."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(n).alias("contrast"), F.col(f"{h}_correct").alias("h"), F.col(f"{l}_correct").alias("l"))
        for n, h, l in CONTRASTS
    ]))
    long = df.select("model_key", "uncertainty_stratum", parts.alias("c")).select("model_key", "uncertainty_stratum", "c.*")
    s, c, m = F.col("uncertainty_stratum"), F.col("contrast"), F.col("model_key")
    out = long.groupingSets([[s, c], [m, s, c]], m, s, c).agg(
        F.count(F.lit(1)).alias("rows"), (rate(F.col("h")) - rate(F.col("l"))).alias("difference"),
        count_where(F.col("h") & ~F.col("l")).alias("rescued"), count_where(~F.col("h") & F.col("l")).alias("harmed"),
    )
    return out.withColumn("net", F.col("rescued") - F.col("harmed")).withColumn(
        "model_key", F.coalesce("model_key", F.lit("pooled"))
    )


def token_summary(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Mean and exact median tokens and budget-finish rate per model and arm."""
    long = melt_arms(df, ["model_key"])
    cap = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    base = long.groupBy("model_key", "arm").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("tokens").alias("mean_tokens"),
        rate(F.col("tokens") >= F.try_element_at(cap, F.col("arm"))).alias("budget_finish_rate"),
    )
    med = quantiles(long, ["model_key", "arm"], "tokens", {"median_tokens": 0.5})
    return base.join(med, ["model_key", "arm"])


def transition_table(df: DataFrame) -> DataFrame:
    """Four transitions per stratum and contrast with rates, absent cells as zero."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("contrast"), transition_label(F.col(f"{l}_correct"), F.col(f"{h}_correct")).alias("transition"))
        for n, h, l in CONTRASTS
    ]))
    counts = df.select("uncertainty_stratum", cells.alias("c")).groupBy(
        "uncertainty_stratum", "c.contrast", "c.transition"
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("uncertainty_stratum", "contrast").agg(F.sum("n").alias("total"))
    grid = totals.select("*", F.explode(F.array(*[F.lit(t) for t in TRANSITIONS])).alias("transition"))
    keys = ["uncertainty_stratum", "contrast", "transition"]
    return grid.join(counts, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("rows"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("rate")
    )


def censoring_table(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Finish and limit rates and the accuracy conditional on each, per model and arm."""
    long = melt_arms(df, ["model_key"])
    cap = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    long = long.withColumn("at_limit", F.col("tokens") >= F.try_element_at(cap, F.col("arm")))
    y = F.col("correct").cast("int")
    return long.groupBy("model_key", "arm").agg(
        F.count(F.lit(1)).alias("rows"), rate(~F.col("at_limit")).alias("eos_rate"), rate(F.col("at_limit")).alias("limit_rate"),
        mean_where(y, ~F.col("at_limit")).alias("accuracy_if_eos"), mean_where(y, F.col("at_limit")).alias("accuracy_if_limit"),
    )


def power_gate(df: DataFrame, groups: Sequence[str], target: str, folds: int) -> DataFrame:
    """Problems per class; a table is powered when both classes have at least ``folds``."""
    y = F.col(target).cast("boolean")
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.when(y, F.col("problem_id"))).alias("positive_problems"),
        F.countDistinct(F.when(~y, F.col("problem_id"))).alias("negative_problems"),
    ).withColumn("powered", F.least("positive_problems", "negative_problems") >= folds)


def cluster_outcomes(df: DataFrame, target: str, groups: Sequence[str]) -> DataFrame:
    """Cluster-level outcomes: problems with any, all or mixed positive attempts per group."""
    y = F.col(target).cast("int")
    per = df.groupBy(*groups, "problem_id").agg(
        F.max(y).alias("any"), F.min(y).alias("all"), F.count(F.lit(1)).alias("n"), F.sum(y).alias("s")
    )
    return per.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("problems"), F.sum("n").alias("attempts"), F.sum("s").alias("positive_attempts"),
        F.sum("any").alias("positive_problems"), count_where(F.col("any") == 0).alias("negative_problems"),
        count_where(F.col("any") != F.col("all")).alias("mixed_problems"),
    ).withColumn("degenerate", (F.col("positive_problems") == 0) | (F.col("positive_problems") == F.col("problems")))


def seed_concordance(df: DataFrame, first: int, second: int, target: str = "correct") -> DataFrame:
    """Agreement of one outcome between two seeds of the same problem and model."""
    y = F.col(target).cast("int")
    pair = df.where(F.col("seed").isin(first, second)).groupBy("model_key", "problem_id").agg(
        F.max(F.when(F.col("seed") == first, y)).alias("a"), F.max(F.when(F.col("seed") == second, y)).alias("b")
    ).where("a is not null and b is not null")
    return pair.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("pairs"), rate(F.col("a") == F.col("b")).alias("concordance"),
        count_where((F.col("a") == 1) & (F.col("b") == 1)).alias("both"),
        count_where((F.col("a") == 0) & (F.col("b") == 0)).alias("neither"),
    )


def distribution(df: DataFrame, cells: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, median and quartiles per cell and metric."""
    long = melt(df, cells, metrics).where(F.col("value").isNotNull())
    keys = [*cells, "metric"]
    base = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean"))
    return base.join(quantiles(long, keys, "value", {"median": 0.5, "q25": 0.25, "q75": 0.75}), keys)


def mode_transitions(df: DataFrame, left: str, right: str) -> DataFrame:
    """(k+1) x (k+1) counts of problems by success count under two modes, zero-filled; k is the largest count seen."""
    y = F.col("correct").cast("int")
    per = df.groupBy("problem_id").agg(
        F.sum(F.when(F.col("dataset") == left, y)).alias("from_successes"), F.sum(F.when(F.col("dataset") == right, y)).alias("to_successes"),
    ).where("from_successes is not null and to_successes is not null")
    counts = per.groupBy("from_successes", "to_successes").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    axis = F.sequence(F.lit(0).cast("long"), F.col("most"))
    grid = counts.agg(F.max(F.greatest("from_successes", "to_successes")).alias("most")).where("most is not null").select("most", F.explode(axis).alias("from_successes")).select(
        "from_successes", F.explode(axis).alias("to_successes")
    )
    direction = (
        F.when(F.col("to_successes") > F.col("from_successes"), "improved")
        .when(F.col("to_successes") < F.col("from_successes"), "worsened").otherwise("unchanged")
    )
    return grid.join(counts, ["from_successes", "to_successes"], "left").select(
        "from_successes", "to_successes", F.coalesce("n", F.lit(0)).alias("problems"), direction.alias("direction")
    )


def compute_frontier(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Accuracy and tokens per cell, problem means first."""
    per = df.groupBy(*cells, "problem_id").agg(rate(F.col("correct")).alias("a"), F.avg("tokens").alias("t"))
    return per.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("problems"), F.avg("a").alias("accuracy"), F.avg("t").alias("mean_tokens")
    )


def quality_profile(df: DataFrame, condition: str, parsed: Column, truncated: Column) -> DataFrame:
    return df.groupBy(condition).agg(
        F.count(F.lit(1)).alias("rows"), rate(parsed).alias("parse_rate"), rate(truncated).alias("truncation_rate")
    )


def stratified_interaction(df: DataFrame, hi: str, lo: str, draws: int = B.DRAWS, seed: str = "b") -> DataFrame:
    """(hi - lo) in the high stratum minus the same in the low one, problems resampled jointly."""
    d = F.col(f"{hi}_correct").cast("double") - F.col(f"{lo}_correct").cast("double")
    aggs = []
    for s in ("high", "low"):
        inside = F.col("uncertainty_stratum") == s
        aggs += [F.coalesce(F.sum(F.when(inside, d)), F.lit(0.0)).alias(f"top_{s}"), count_where(inside).alias(f"n_{s}")]
    stats = materialize(df.where(F.col("uncertainty_stratum").isin("high", "low")).groupBy("problem_id").agg(*aggs))
    cols = ["top_high", "n_high", "top_low", "n_low"]

    def gap():
        return ratio(F.col("top_high"), F.col("n_high")) - ratio(F.col("top_low"), F.col("n_low"))

    point = stats.agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("clusters")).select(
        gap().alias("estimate"), "clusters"
    )
    reps = B.replicate_sums(stats, [], "problem_id", cols, draws, seed).withColumn("value", gap())
    return point.join(B.interval(reps, [], "value"), F.lit(True))
