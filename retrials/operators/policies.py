"""Uncertainty index and compute-allocation policies.

Grids are never crossed with rows: a threshold policy only depends on the grid cell of the
score, so rows are collapsed to a few cells per model first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.functions.numeric import finite, rate, ratio
from retrials.operators import resampling as B
from retrials.operators.aggregates import ARMS
from retrials.operators.contracts import require, require_all, require_unique
from retrials.operators.joins import chosen, ecdf_lookup, full_coverage
from retrials.functions.ordered import running_sum

# Threshold, forecast and penalty grids.
THRESHOLDS = tuple(float(x) for x in np.linspace(0.05, 0.95, 19))
FORECASTS = tuple(float(x) for x in np.linspace(0.1, 0.9, 9))
PENALTIES = tuple(float(x) for x in np.linspace(0.0, 1.0, 101))
# Feature blocks of the index; features marked -1 fall with uncertainty, "abs" use magnitude.
BLOCKS = {
    "predictive_ambiguity": ("normalized_entropy_mean",),
    "temporal_instability": ("normalized_entropy_std", "normalized_entropy_robust_slope", "normalized_entropy_max_rise",
                             "successive_js_divergence_mean"),
    "geometry_instability": ("geometry_mean_relative_velocity", "geometry_mean_cosine_drift",
                             "geometry_trajectory_efficiency", "geometry_turning_angle_variance"),
    "spectral_instability": ("spectral_normalized_entropy_entropy", "spectral_surprisal_entropy",
                             "spectral_successive_js_divergence_entropy", "spectral_relative_l2_step_entropy"),
}
NEGATIVE = ("geometry_trajectory_efficiency",)
ABSOLUTE = ("normalized_entropy_robust_slope",)


def oriented_long(
    rows: DataFrame, ids: Sequence[str], features: Sequence[str], negative: Sequence[str] = NEGATIVE, absolute: Sequence[str] = ABSOLUTE
) -> DataFrame:
    """(ids, feature, value) with larger always meaning more uncertain."""
    def oriented(f: str) -> Column:
        v = finite(F.col(f))
        v = F.abs(v) if f in absolute else v
        return -v if f in negative else v

    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), oriented(f).alias("value")) for f in features]))
    return rows.select(*ids, cells.alias("c")).select(*ids, "c.*")


def fit_references(rows: DataFrame, features: Sequence[str], train: Column, **how) -> DataFrame:
    """Train-only ECDF per model and feature: distinct (value, cdf)."""
    long = oriented_long(rows.where(train), ["model_key"], features, **how).where(F.col("value").isNotNull())
    counts = materialize(long.groupBy("model_key", "feature", "value").agg(F.count(F.lit(1)).alias("n")))
    run = running_sum(counts, ["model_key", "feature"], ["value"], {"upto": F.col("n")})
    sizes = counts.groupBy("model_key", "feature").agg(F.sum("n").alias("total"))
    return run.join(sizes, ["model_key", "feature"]).select("model_key", "feature", "value", (F.col("upto") / F.col("total")).alias("cdf"))


def uncertainty_index(
    rows: DataFrame, ident: str, blocks: Mapping[str, Sequence[str]], train: Column, **how
) -> DataFrame:
    """Feature percentiles in the train ECDF, averaged within blocks, blocks averaged to one score."""
    features = [f for fs in blocks.values() for f in fs]
    where = F.create_map(*[F.lit(x) for b, fs in blocks.items() for f in fs for x in (f, b)])
    long = require_all(
        oriented_long(rows, [ident, "model_key"], features, **how), F.col("value").isNotNull(), "non-finite uncertainty feature"
    )
    reference = oriented_long(rows.where(train), ["model_key"], features, **how).where(F.col("value").isNotNull())
    scored = ecdf_lookup(long, reference, ["model_key", "feature"], "value")
    per = scored.withColumn("block", F.element_at(where, F.col("feature"))).groupBy(ident, "model_key", "block").agg(F.avg("percentile").alias("b"))
    return per.groupBy(ident, "model_key").agg(
        *[F.max(F.when(F.col("block") == b, F.col("b"))).alias(f"block_{b}") for b in blocks], F.avg("b").alias("uncertainty_score")
    )


def route(score: Column, short_max: Column, medium_max: Column, forecast: Column | None = None, continue_min: Column | None = None) -> Column:
    """Arm from a score in [0, 1] and ordered thresholds; a confident forecast turns long into medium."""
    sound = (short_max >= 0) & (short_max < medium_max) & (medium_max <= 1) & score.between(0, 1)
    last = F.lit("long")
    if continue_min is not None:
        gap = F.when(continue_min.isNotNull() & forecast.isNull(), F.raise_error(F.lit("policy needs a forecast")).cast("string"))
        last = F.coalesce(gap, F.when(forecast >= continue_min, "medium").otherwise("long"))
    arm = F.when(score <= short_max, "short").when(score <= medium_max, "medium").otherwise(last)
    return F.when(F.coalesce(sound, F.lit(False)), arm).otherwise(F.raise_error(F.lit("thresholds or score out of range")).cast("string"))


def with_action(df: DataFrame, arm: Column, anchor: int = 512) -> DataFrame:
    """The chosen arm's outcome and token columns."""
    out = df.withColumn("selected_arm", arm)
    a = F.col("selected_arm")
    answers = chosen(a, "{}_answer_tokens", ARMS) if f"{ARMS[0]}_answer_tokens" in df.columns else F.lit(0).cast("long")
    return out.withColumn("chosen_correct", chosen(a, "{}_correct", ARMS)).withColumn(
        "chosen_reasoning", anchor + chosen(a, "{}_tokens", ARMS)
    ).withColumn("chosen_answer", answers).withColumn("chosen_total", F.col("chosen_reasoning") + F.col("chosen_answer"))


def action_metrics(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy, mean tokens and route rates of chosen actions."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), rate(F.col("chosen_correct")).alias("accuracy"),
        F.avg("chosen_reasoning").alias("mean_reasoning_tokens"), F.avg("chosen_answer").alias("mean_answer_tokens"),
        F.avg("chosen_total").alias("mean_total_tokens"),
        *[rate(F.col("selected_arm") == a).alias(f"route_rate_{a}") for a in ARMS],
    )


def threshold_candidates(
    df: DataFrame, groups: Sequence[str] = (), grid: Sequence[float] = THRESHOLDS, forecast: str | None = None,
    forecasts: Sequence[float] = FORECASTS, anchor: int = 512,
) -> DataFrame:
    """Accuracy and tokens of every ordered threshold pair (and forecast cut), per group.

    The score falls into one of len(grid)+1 cells; ``score <= grid[j]`` exactly when its cell
    is at most j, so all candidates follow from cell totals.
    """
    def cell(c: Column, cuts: Sequence[float], strict: bool) -> Column:
        above = [(c > v) if strict else (c >= v) for v in cuts]
        return sum((x.cast("int") for x in above), F.lit(0))

    keys = [*groups, "__c", "__f"]
    staged = df.withColumn("__c", cell(F.col("uncertainty_score"), grid, True)).withColumn(
        "__f", cell(F.col(forecast), forecasts, False) if forecast else F.lit(0)
    )
    sums = [F.count(F.lit(1)).alias("n")]
    for a in ARMS:
        sums += [F.sum(F.col(f"{a}_correct").cast("long")).alias(f"c_{a}"), F.sum(F.col(f"{a}_tokens")).alias(f"t_{a}")]
    cells = materialize(staged.groupBy(*keys).agg(*sums))   # at most 20 x 10 rows per group
    pairs = [(i, j, k) for i in range(len(grid)) for j in range(i + 1, len(grid)) for k in (range(len(forecasts)) if forecast else [None])]
    params = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).cast("int").alias("k"), F.lit(grid[i]).alias("short_max"),
                 F.lit(grid[j]).alias("medium_max"), F.lit(None if k is None else forecasts[k]).cast("double").alias("continue_min"))
        for i, j, k in pairs
    ]))
    fan = cells.select("*", params.alias("p"))
    c = F.col("__c")
    soon = F.col("p.k").isNotNull() & (F.col("__f") > F.col("p.k"))
    arm = F.when(c <= F.col("p.i"), "short").when(c <= F.col("p.j"), "medium").when(soon, "medium").otherwise("long")
    fan = fan.withColumn("arm", arm)
    n = F.sum("n")
    return fan.groupBy(*groups, "p.short_max", "p.medium_max", "p.continue_min").agg(
        n.alias("rows"), ratio(F.sum(chosen(F.col("arm"), "c_{}", ARMS)), n).alias("accuracy"),
        (anchor + ratio(F.sum(chosen(F.col("arm"), "t_{}", ARMS)), n)).alias("mean_total_tokens"),
        ratio(F.sum("c_long"), n).alias("fixed_long_accuracy"),
        *[ratio(F.coalesce(F.sum(F.when(F.col("arm") == a, F.col("n"))), F.lit(0)), n).alias(f"route_rate_{a}") for a in ARMS],
    )


def select_thresholds(candidates: DataFrame, groups: Sequence[str] = (), max_gap: float = 0.05) -> DataFrame:
    """Cheapest candidate within the accuracy gap of always-long, else the most accurate one."""
    ok = F.col("accuracy") >= F.col("fixed_long_accuracy") - max_gap
    rank = F.struct(
        (~ok).cast("int").alias("bad"), F.when(ok, F.col("mean_total_tokens")).otherwise(-F.col("accuracy")).alias("r1"),
        F.when(ok, -F.col("accuracy")).otherwise(F.col("mean_total_tokens")).alias("r2"), "short_max", "medium_max",
        F.coalesce("continue_min", F.lit(0.0)).alias("r3"),
    )
    best = candidates.groupBy(*groups).agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in groups]), rank).alias("b"), F.min(rank).alias("r"))
    status = F.when(F.col("r.bad") == 0, "minimum_compute_within_accuracy_gap").otherwise("no_candidate_met_accuracy_gap")
    return best.select(*groups, "b.*", status.alias("selection_status"))


def fit_policy(df: DataFrame, train: Column, min_problems: int, max_gap: float = 0.05) -> DataFrame:
    """Thresholds per model from train rows, gated on accuracy and size of the remaining history."""
    policy = materialize(select_thresholds(threshold_candidates(df.where(train), ["model_key"]), ["model_key"], max_gap))
    history = df.where(~train).join(policy.select("model_key", "short_max", "medium_max"), "model_key")
    acted = with_action(history, route(F.col("uncertainty_score"), F.col("short_max"), F.col("medium_max")))
    gate = acted.groupBy("model_key").agg(
        F.countDistinct("problem_id").alias("history_problems"), rate(F.col("chosen_correct")).alias("history_accuracy"),
        rate(F.col("long_correct")).alias("history_long_accuracy"), F.avg("chosen_total").alias("history_tokens"),
    )
    passed = (F.col("history_problems") >= min_problems) & (F.col("history_accuracy") >= F.col("history_long_accuracy") - max_gap)
    return policy.join(gate, "model_key").withColumn("gate_passed", passed)


def policy_digest(short_max: Column, medium_max: Column, model: Column) -> Column:
    """Digest of one frozen policy row over its fields in name order."""
    def text(c: Column) -> Column:
        return F.round(c * 1_000_000).cast("long").cast("string")
    return F.sha2(F.concat_ws("|", text(medium_max), model, text(short_max)), 256)


def apply_policy(rows: DataFrame, policy: DataFrame, expected: DataFrame) -> DataFrame:
    """Route new rows by a frozen policy: digest verified, exact run coverage, both routed arms known."""
    good = policy_digest(F.col("short_max"), F.col("medium_max"), F.col("model_key")) == F.col("digest")
    frozen = require_all(require_unique(policy, ["model_key"], "policy"), good, "policy digest does not match its content")
    joined = rows.join(frozen.select("model_key", "short_max", "medium_max"), "model_key", "left")
    known = require_all(joined, F.col("short_max").isNotNull(), "a model has no frozen policy")
    arm = route(F.col("uncertainty_score"), F.col("short_max"), F.col("medium_max"))
    return full_coverage(known.withColumn("selected_arm", arm), expected.select("source_run_id"), ["source_run_id"])


def policy_arms(df: DataFrame, model_arm: Column, adaptive: Column) -> DataFrame:
    """Each row under every policy: three fixed arms, by stratum, by model only, adaptive."""
    arms = {f"fixed_{a}": F.lit(a) for a in ARMS}
    arms["stratum_selective"] = F.when(F.col("uncertainty_stratum") == "high", "long").otherwise("short")
    arms["model_only"], arms["adaptive"] = model_arm, adaptive
    fan = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), a.alias("arm")) for p, a in arms.items()]))
    rows = df.select("*", fan.alias("__p")).select(*df.columns, F.col("__p.policy").alias("policy"), F.col("__p.arm").alias("__arm"))
    return with_action(rows, F.col("__arm")).drop("__arm")


def policy_comparison(acted: DataFrame, draws: int = B.DRAWS, seed: str = "b") -> DataFrame:
    """Accuracy and tokens per policy with problem-clustered intervals."""
    stats = materialize(acted.groupBy("policy", "problem_id").agg(
        F.sum(F.col("chosen_correct").cast("long")).alias("c"), F.sum("chosen_total").alias("t"), F.count(F.lit(1)).alias("n")
    ))
    point = stats.groupBy("policy").agg(
        ratio(F.sum("c"), F.sum("n")).alias("accuracy"), ratio(F.sum("t"), F.sum("n")).alias("mean_total_tokens")
    )
    reps = materialize(B.replicate_sums(stats, ["policy"], "problem_id", ["c", "t", "n"], draws, seed))
    a = B.interval(reps.withColumn("v", ratio(F.col("c"), F.col("n"))), ["policy"], "v", "accuracy").drop("used_draws", "skipped_draws")
    t = B.interval(reps.withColumn("v", ratio(F.col("t"), F.col("n"))), ["policy"], "v", "tokens").drop("used_draws", "skipped_draws")
    return point.join(a, "policy").join(t, "policy")


def policy_deltas(acted: DataFrame, baseline: str, keys: Sequence[str], draws: int = B.DRAWS, seed: str = "b") -> DataFrame:
    """Paired accuracy difference of each policy to a baseline, on the same resampled problems."""
    base = acted.where(F.col("policy") == baseline).select(*keys, F.col("chosen_correct").cast("int").alias("__b"))
    paired = acted.where(F.col("policy") != baseline).join(base, list(keys))
    return B.ratio_interval(paired, F.col("chosen_correct").cast("int") - F.col("__b"), ["policy"], draws=draws, seed=seed)


def with_utilities(df: DataFrame, penalty: Column, costs: Mapping[str, float], p: str = "p_{}") -> DataFrame:
    """utility = probability - penalty * cost / largest cost; ties go to the cheaper arm."""
    top = max(costs.values())
    out = df
    for a in ARMS:
        out = out.withColumn(f"utility_{a}", F.col(p.format(a)) - penalty * F.lit(costs[a] / top))
    u = [F.col(f"utility_{a}") for a in ARMS]
    best = F.greatest(*u)
    arm = F.when(u[0] == best, ARMS[0]).when(u[1] == best, ARMS[1]).otherwise(ARMS[2])
    return out.withColumn("selected_arm", arm)


def _turning_cell(cheap: Column, dear: Column, gap: float, shares: tuple[float, float], grid: Sequence[float]) -> Column:
    """First cell of the ascending ``grid`` whose penalty makes the cheaper arm at least as useful, else its length.

    The lead of the cheaper arm only grows with the penalty, so the cell follows from the point of
    equality; the cells around it are judged by the utilities themselves, as rounding decides ties."""
    size, cells = len(grid), F.array(*[F.lit(g) for g in grid])
    point = (dear - cheap) / F.lit(gap)
    step = (grid[-1] - grid[0]) / (size - 1) if size > 1 else 1.0
    if size > 1 and np.allclose(np.diff(grid), step, rtol=0, atol=step * 1e-6):
        near = F.greatest(F.lit(0.0), F.least(F.lit(float(size)), F.floor((point - F.lit(grid[0])) / F.lit(step)).cast("double"))).cast("int")
    else:
        near = F.size(F.filter(cells, lambda g: g < point))
    def wins(k: Column) -> Column:
        g = F.get(cells, k)
        return (cheap - g * F.lit(shares[0])) >= (dear - g * F.lit(shares[1]))
    # ``near`` is off by one cell at most either way; a cell beyond the end counts as won, one before the start as lost.
    first = near + 2
    for back in (1, 0, -1, -2):
        k = near + back
        first = F.when((k >= 0) & (k < size) & wins(k), k).otherwise(first)
    first = F.greatest(F.lit(0), F.least(F.lit(size), first))
    return F.when(cheap.isNull() | F.isnan(dear) & ~F.isnan(cheap), size).when(dear.isNull() | F.isnan(cheap), 0).otherwise(first)


def select_penalty(df: DataFrame, costs: Mapping[str, float], max_gap: float, grid: Sequence[float] = PENALTIES, p: str = "p_{}") -> DataFrame:
    """Cheapest penalty whose accuracy stays within the gap of always-long; none is an error.

    A row's arm changes at most twice along the ascending grid, from long to medium to short.  Each row adds
    its start and its changes to an array of differences, combined on the map side into at
    most ``len(grid)`` cells; prefix sums over those cells give every penalty's table.
    Costs must ascend in the order of the arms.
    """
    grid = sorted(set(grid))
    size, top = len(grid), max(costs.values())
    share = {a: costs[a] / top for a in ARMS}
    if not all(costs[a] < costs[b] for a, b in zip(ARMS, ARMS[1:], strict=False)):
        raise ValueError("costs must ascend from arm to arm")
    prob = {a: F.col(p.format(a)).cast("double") for a in ARMS}
    def turn(a: str, b: str) -> Column:
        return _turning_cell(prob[a], prob[b], share[b] - share[a], (share[a], share[b]), grid)
    kept = df.select(*[F.when(F.col(f"{a}_correct"), 1).when(~F.col(f"{a}_correct"), 0).cast("long").alias(f"y_{a}") for a in ARMS],
                     F.greatest(turn("short", "medium"), turn("short", "long")).alias("s"), turn("medium", "long").alias("m"))
    start = F.when(F.col("s") == 0, "short").when(F.col("m") == 0, "medium").otherwise("long")
    change = lambda k, old, new: F.struct(k.cast("int").alias("cell"), old.alias("old"), new.alias("new"))
    no = F.lit(None).cast("string")
    changes = F.array(
        change(F.lit(0), no, start),
        F.when((F.col("m") > 0) & (F.col("m") < F.col("s")), change(F.col("m"), F.lit("long"), F.lit("medium"))),
        F.when((F.col("s") > 0) & (F.col("s") < size), change(F.col("s"), F.when(F.col("m") < F.col("s"), "medium").otherwise("long"), F.lit("short"))))
    rows = kept.select(*[f"y_{a}" for a in ARMS], F.explode(F.filter(changes, lambda x: x.isNotNull() & (x.cell < size))).alias("x")).select(
        "x.*", *[f"y_{a}" for a in ARMS])
    def total(value: dict[str, Column]) -> Column:
        signed = F.lit(0).cast("long")
        for a in ARMS:
            signed = signed + F.when(F.col("new") == a, F.coalesce(value[a], F.lit(0))).otherwise(0) - F.when(F.col("old") == a, F.coalesce(value[a], F.lit(0))).otherwise(0)
        return F.sum(signed)
    y = {a: F.col(f"y_{a}") for a in ARMS}
    first = F.col("old").isNull()
    cells = materialize(rows.groupBy("cell").agg(
        total(y).alias("d_right"), total({a: y[a].isNotNull().cast("long") for a in ARMS}).alias("d_known"),
        *[total({b: F.lit(int(a == b)).cast("long") for b in ARMS}).alias(f"d_{a}") for a in ARMS],
        F.sum(F.when(first, 1)).alias("n"), F.sum(F.when(first, y["long"])).alias("long_right"), F.count(F.when(first, y["long"])).alias("long_known")))
    spark = df.sparkSession
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # one row a grid value
    names = ["d_right", "d_known", *[f"d_{a}" for a in ARMS], "n", "long_right", "long_known"]
    listed = spark.createDataFrame(list(enumerate(grid)), "cell int, penalty double").join(cells, "cell", "left")
    run = listed.select("penalty", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(along).alias(c) for c in names]).where("n > 0")
    cost = sum((F.col(f"d_{a}") * F.lit(float(costs[a])) for a in ARMS), F.lit(0.0))
    table = materialize(run.select(
        "penalty", ratio(F.col("d_right"), F.col("d_known")).alias("accuracy"), ratio(cost, F.col("n")).alias("mean_token_cost"),
        ratio(F.col("long_right"), F.col("long_known")).alias("long_accuracy"),
        *[ratio(F.col(f"d_{a}"), F.col("n")).alias(f"route_rate_{a}") for a in ARMS]))
    ok = table.where(F.col("accuracy") >= F.col("long_accuracy") - max_gap)
    some = ok.agg((F.count(F.lit(1)) > 0).alias("ok"))
    ranked = ok.orderBy("mean_token_cost", F.desc("accuracy"), "penalty").limit(1)
    return require(ranked, some, "no feasible compute penalty")


def remediation_audit(source: DataFrame, repaired: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Does each repaired token path extend its source, and do its counts agree."""
    s = source.select(*keys, F.col("tokens").alias("src"), F.col("finish_reason").alias("src_finish"))
    j = repaired.join(s, list(keys), "left")
    a, b = F.size("src"), F.size("tokens")
    answer = b - F.col("reasoning_count") - F.col("inserted_count")
    censored = F.col("src_finish") != "eos"
    checks = {
        "has_source": F.col("src").isNotNull(),
        "extends_source": (a <= b) & (F.slice("tokens", F.lit(1), F.greatest(a, F.lit(1))) == F.slice("src", F.lit(1), F.greatest(a, F.lit(1)))),
        "answer_within_limit": answer.between(0, limit),
        "answer_count_agrees": F.col("answer_count") == answer,
        "added_count_agrees": F.col("added_count") == b - a,
        "added_only_when_censored": F.when(censored, b > a).otherwise(b == a),
        "known_finish": F.col("finish_reason").isin("eos", "answer_limit"),
        "limit_reached_when_said": F.when(F.col("finish_reason") == "answer_limit", answer == limit).otherwise(answer <= limit),
    }
    out = j.select(*keys, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    valid = None
    for n in checks:
        valid = F.col(n) if valid is None else valid & F.col(n)
    return out.withColumn("valid", valid)
