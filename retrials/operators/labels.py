"""Interval-censored event labels, restart-controlled advantage and longitudinal tables.

Windows here run over the probed anchors, budgets or prefixes of one run.  Probe tables
hold one row per (run, anchor), so a window never exceeds the probing schedule, however
many trials a run has: the trials are counted before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrials.functions.numeric import count_where, rate
from retrials.operators.contracts import require_all, require_unique

RUN = ("run_id", "problem_id", "model_key")


def with_rate(probes: DataFrame) -> DataFrame:
    return probes.withColumn("rate", F.try_divide(F.col("successes"), F.col("continuations")))


def checked_probes(probes: DataFrame) -> DataFrame:
    """Unique anchors, at least one continuation, successes within range; else an error."""
    ok = (F.col("continuations") >= 1) & F.col("successes").between(0, F.col("continuations"))
    return require_unique(require_all(probes, ok, "probe counts out of range"), ["run_id", "anchor"], "probes")


def _steps(probes: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("anchor")
    return with_rate(probes).select(
        "*", F.lead("rate").over(w).alias("next_rate"), F.lead("anchor").over(w).alias("next_anchor"),
        F.coalesce(F.lag("anchor").over(w), F.lit(0)).alias("prev_anchor"),
    )


def stable_crossing(probes: DataFrame, thresholds: Sequence[float] = (0.75,), ids: Sequence[str] = RUN) -> DataFrame:
    """First anchor at or above tau whose next anchor is too: an interval, else right-censored."""
    fan = _steps(probes).withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = (F.col("rate") >= F.col("tau")) & (F.col("next_rate") >= F.col("tau"))
    first = F.min(F.when(hit, F.struct("anchor", "prev_anchor", "next_anchor")))
    per = fan.groupBy(*ids, "tau").agg(first.alias("h"), F.max("anchor").alias("last"))
    h = F.col("h")
    return per.select(
        *ids, "tau", h.isNotNull().alias("event_observed"),
        F.coalesce(h.prev_anchor, F.when(h.isNull(), F.col("last"))).alias("interval_lower"),
        h.anchor.alias("interval_upper"), h.anchor.alias("event_time_proxy"),
        F.coalesce(h.next_anchor, F.col("last")).alias("censoring_time"),
        h.anchor.alias("stable_anchor"), h.next_anchor.alias("stability_anchor"),
    )


def first_crossing(probes: DataFrame, tau: float, ids: Sequence[str] = RUN) -> DataFrame:
    """First anchor at or above tau, stable or not."""
    return with_rate(probes).groupBy(*ids).agg(
        F.min(F.when(F.col("rate") >= tau, F.col("anchor"))).alias("first_anchor")
    )


def crossing_shift(canonical: DataFrame, variant: DataFrame, tau: float, extra_budget: int) -> DataFrame:
    """How far the first crossing moves earlier under a larger continuation budget."""
    a = first_crossing(canonical, tau).withColumnRenamed("first_anchor", "canonical_first")
    b = first_crossing(variant, tau, ["run_id"]).withColumnRenamed("first_anchor", "variant_first")
    shift = F.col("canonical_first") - F.col("variant_first")
    return a.join(b, "run_id").withColumn("shift", shift).withColumn(
        "large_shift", shift >= F.lit(extra_budget) * 2 / 3
    )


def last_probe(probes: DataFrame, ids: Sequence[str] = RUN) -> DataFrame:
    """The run's final probe and the anchor before it."""
    w = Window.partitionBy("run_id").orderBy("anchor")
    marked = with_rate(probes).withColumn("prev_anchor", F.coalesce(F.lag("anchor").over(w), F.lit(0)))
    tail = F.max(F.struct("anchor", "prev_anchor", "successes", "continuations", "rate"))
    return marked.groupBy(*ids).agg(tail.alias("t")).select(
        *ids, F.col("t.anchor").alias("final_anchor"), F.col("t.prev_anchor").alias("previous_anchor"),
        F.col("t.successes").alias("final_successes"), F.col("t.continuations").alias("final_continuations"),
        F.col("t.rate").alias("final_rate"),
    )


def terminal_replication(probes: DataFrame, extra: DataFrame, tau: float = 0.75) -> DataFrame:
    """Censored runs whose final anchor reaches tau, decided with extra trials pooled in."""
    censored = stable_crossing(probes, [tau]).where(~F.col("event_observed")).select("run_id")
    near = last_probe(probes).where(F.col("final_rate") >= tau).join(censored, "run_id", "left_semi")
    more = extra.select("run_id", F.col("anchor").alias("final_anchor"), F.col("successes").alias("xs"), F.col("continuations").alias("xc"))
    pooled = near.join(more, ["run_id", "final_anchor"])
    s, n = F.col("final_successes") + F.col("xs"), F.col("final_continuations") + F.col("xc")
    out = pooled.withColumn("pooled_successes", s).withColumn("pooled_continuations", n).withColumn("pooled_rate", s / n)
    event = F.col("pooled_rate") >= tau
    return out.select(
        *RUN, "final_anchor", "final_rate", "pooled_successes", "pooled_continuations", "pooled_rate",
        event.alias("event_observed"),
        F.when(event, F.col("previous_anchor")).otherwise(F.col("final_anchor")).alias("interval_lower"),
        F.when(event, F.col("final_anchor")).alias("interval_upper"),
    )


def pool_ambiguous(probes: DataFrame, extra: DataFrame) -> DataFrame:
    """Cells with 0 < successes < continuations take their extra trials; others stay."""
    more = extra.select("run_id", "anchor", F.col("successes").alias("xs"), F.col("continuations").alias("xc"))
    mixed = (F.col("successes") > 0) & (F.col("successes") < F.col("continuations"))
    joined = probes.join(more, ["run_id", "anchor"], "left")
    s = F.when(mixed, F.col("successes") + F.coalesce("xs", F.lit(0))).otherwise(F.col("successes"))
    n = F.when(mixed, F.col("continuations") + F.coalesce("xc", F.lit(0))).otherwise(F.col("continuations"))
    return joined.select(*RUN, "anchor", s.alias("successes"), n.alias("continuations"), mixed.alias("ambiguous"))


def label_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs by whether the label kept its state and anchor."""
    b = after.select("run_id", F.col("stable_anchor").alias("new_anchor"))
    same = F.col("stable_anchor").eqNullSafe(F.col("new_anchor"))
    kind = (
        F.when(same, "unchanged").when(F.col("stable_anchor").isNull(), "gained")
        .when(F.col("new_anchor").isNull(), "lost").otherwise("moved")
    )
    return before.join(b, "run_id").groupBy("model_key", kind.alias("change")).agg(F.count(F.lit(1)).alias("runs"))


def restart_brackets(panel: DataFrame) -> DataFrame:
    """Budget intervals covering the whole axis, flat beyond both ends.

    Inner intervals are (lo, hi]; the last budget itself belongs to the flat upper end.
    """
    w = Window.partitionBy("run_id").orderBy("budget")
    edge = panel.select(
        "run_id", F.col("budget").alias("lo"), F.col("rate").alias("r_lo"),
        F.lead("budget").over(w).alias("hi"), F.lead("rate").over(w).alias("r_hi"),
        F.lead("budget", 2).over(w).isNotNull().alias("hi_in"), F.lag("budget").over(w).isNull().alias("first"),
    )
    slopes = F.col("hi").isNotNull()
    upper = edge.select(
        "run_id", "lo", (~slopes & ~F.col("first")).alias("lo_in"), "hi", "hi_in", "r_lo",
        F.coalesce("r_hi", "r_lo").alias("r_hi"), slopes.alias("slopes"),
    )
    below = edge.where("first").select(
        "run_id", F.lit(None).cast("long").alias("lo"), F.lit(False).alias("lo_in"), F.col("lo").alias("hi"),
        F.lit(True).alias("hi_in"), "r_lo", F.col("r_lo").alias("r_hi"), F.lit(False).alias("slopes"),
    )
    return upper.unionByName(below)


def restart_rate_at(points: DataFrame, panel: DataFrame, total: str) -> DataFrame:
    """Restart rate at a total budget: log2-linear in its bracket; conservative = the larger end."""
    b = restart_brackets(panel).withColumnRenamed("run_id", "__run")
    t, lo, hi = F.col(total), F.col("lo"), F.col("hi")
    above = lo.isNull() | (t > lo) | (F.col("lo_in") & (t == lo))
    under = hi.isNull() | (t < hi) | (F.col("hi_in") & (t == hi))
    joined = points.join(b, (F.col("run_id") == F.col("__run")) & above & under)
    share = (F.log2(t) - F.log2(lo)) / (F.log2(hi) - F.log2(lo))
    plain = F.when(F.col("slopes"), F.col("r_lo") + share * (F.col("r_hi") - F.col("r_lo"))).otherwise(F.col("r_lo"))
    cons = F.when(F.col("slopes"), F.greatest("r_lo", "r_hi")).otherwise(F.col("r_lo"))
    return joined.withColumn("r_hat", plain).withColumn("r_cons", cons).drop(
        "__run", "lo", "lo_in", "hi", "hi_in", "r_lo", "r_hi", "slopes"
    )


def advantage(probes: DataFrame, panel: DataFrame, budget: int = 1024) -> DataFrame:
    """Prefix rate minus the restart rate at the same total budget, plain and conservative."""
    points = with_rate(probes).withColumn("total", F.col("anchor") + budget)
    out = restart_rate_at(points, panel, "total")
    return out.withColumn("adv", F.col("rate") - F.col("r_hat")).withColumn("adv_cons", F.col("rate") - F.col("r_cons"))


def advantage_crossing(
    adv: DataFrame, column: str, deltas: Sequence[float], tau: float = 0.75, ids: Sequence[str] = RUN
) -> DataFrame:
    """First anchor where rate >= tau and advantage >= delta, both holding at the next anchor."""
    w = Window.partitionBy("run_id").orderBy("anchor")
    steps = adv.select(
        *ids, "anchor", "rate", F.col(column).alias("a"), F.lead("rate").over(w).alias("rate2"), F.lead(column).over(w).alias("a2")
    ).withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    ok = (F.least("rate", "rate2") >= tau) & (F.least("a", "a2") >= F.col("delta")) & F.col("a2").isNotNull()
    return steps.groupBy(*ids, "delta").agg(F.min(F.when(ok, F.col("anchor"))).alias("crossing"))


# Names of the regimes and the class of each.
REGIME_CLASS = {
    "instant_scratch_solvable": "instant", "instant_prefix_advantaged": "instant", "instant_ambiguous": "instant",
    "budget_limited": "budget_limited", "prefix_limited": "prefix_limited",
    "no_crossing_at_primary_delta": "other", "terminal_A1": "other", "unsolved_hard": "unsolved",
}


def regimes(
    probes: DataFrame, panel: DataFrame, labels: DataFrame, terminal: DataFrame,
    tau: float = 0.75, budget: int = 1024, instant_max: int = 16, budgets: Sequence[int] = (1024, 2048, 4096, 8192),
) -> DataFrame:
    """One regime per run from its event label, restart panel and advantage crossings."""
    adv = advantage(probes, panel, budget)
    peak = adv.groupBy(*RUN).agg(F.max("adv").alias("max_advantage"))

    def wide(column: str, deltas: Sequence[float], prefix: str) -> DataFrame:
        cross = advantage_crossing(adv, column, deltas, tau, ["run_id"])
        return cross.groupBy("run_id").agg(*[
            F.max(F.when(F.col("delta") == d, F.col("crossing"))).alias(f"{prefix}{int(d * 100):03d}") for d in deltas
        ])

    rates = panel.groupBy("run_id").agg(*[
        F.max(F.when(F.col("budget") == b, F.col("rate"))).alias(f"r_{b}") for b in budgets
    ])
    ends = terminal.where("event_observed").select("run_id", F.lit(True).alias("terminal"))
    rows = (
        peak.join(wide("adv", (0.25, 0.5, 0.75), "t_v_d"), "run_id").join(wide("adv_cons", (0.5,), "t_c_d"), "run_id")
        .join(rates, "run_id").join(labels.select("run_id", "event_observed", "stable_anchor"), "run_id")
        .join(ends, "run_id", "left")
    )
    instant = F.col("event_observed") & (F.col("stable_anchor") <= instant_max)
    crossed = F.col("t_v_d050").isNotNull()
    regime = (
        F.when(instant & (F.coalesce(f"r_{budgets[0]}", F.lit(0.0)) >= tau), "instant_scratch_solvable")
        .when(instant & crossed, "instant_prefix_advantaged").when(instant, "instant_ambiguous")
        .when(F.col("r_4096") >= tau, "budget_limited").when(crossed, "prefix_limited")
        .when(F.col("event_observed"), "no_crossing_at_primary_delta")
        .when(F.col("terminal"), "terminal_A1").otherwise("unsolved_hard")
    )
    return rows.select(
        *RUN, "event_observed", F.coalesce(instant, F.lit(False)).alias("instant"), "max_advantage",
        "t_v_d025", "t_v_d050", "t_v_d075", "t_c_d050", *[f"r_{b}" for b in budgets], regime.alias("regime"),
        F.col("t_v_d050").isNull().eqNullSafe(F.col("t_c_d050").isNull()).alias("conservative_agrees"),
    )


def regime_summary(table: DataFrame) -> DataFrame:
    """Counts per model: regimes, crossings by delta among non-instant runs, disagreements."""
    slow = ~F.col("instant")
    kinds = F.array_compact(F.array(
        F.struct(F.lit("regime").alias("kind"), F.col("regime").alias("value")),
        *[F.when(slow & F.col(f"t_v_d{d}").isNotNull(), F.struct(F.lit("crossing").alias("kind"), F.lit(f"d{d}").alias("value")))
          for d in ("025", "050", "075")],
        F.when(~F.col("conservative_agrees"), F.struct(F.lit("conservative").alias("kind"), F.lit("disagrees").alias("value"))),
    ))
    return table.select("model_key", F.explode(kinds).alias("k")).groupBy("model_key", "k.kind", "k.value").agg(
        F.count(F.lit(1)).alias("runs")
    )


def cross_model_agreement(table: DataFrame, left: str, right: str) -> DataFrame:
    """Problems classified for both models, and those in the same collapsed class."""
    names = F.create_map(*[F.lit(v) for kv in REGIME_CLASS.items() for v in kv])
    top = F.try_element_at(names, F.col("regime"))
    pair = table.groupBy("problem_id").agg(
        F.max(F.when(F.col("model_key") == left, top)).alias("l"), F.max(F.when(F.col("model_key") == right, top)).alias("r")
    ).where("l is not null and r is not null")
    return pair.agg(F.count(F.lit(1)).alias("both"), count_where(F.col("l") == F.col("r")).alias("agree"))


def horizon_outcome(prefix: Column, horizon: Column) -> Column:
    """1/0 when the censoring interval decides the horizon (prefix, prefix+horizon], else NULL."""
    lo, hi, end = F.col("interval_lower"), F.col("interval_upper"), prefix + horizon
    event = (
        F.when(hi <= prefix, None).when((lo >= prefix) & (hi <= end), F.lit(1)).when(lo >= end, F.lit(0))
    )
    return F.when(F.col("event_observed"), event).when(F.col("censoring_time") >= end, F.lit(0)).cast("long")


LABEL = ["event_observed", "interval_lower", "interval_upper", "censoring_time"]


def labelled_panel(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefix rows that were really reached, with the run's label."""
    return panel.where(F.col("observed_token_count") >= F.col("forecast_token")).join(
        labels.select("run_id", *LABEL), "run_id"
    )


def horizon_table(panel: DataFrame, labels: DataFrame, horizons: Sequence[int]) -> DataFrame:
    rows = labelled_panel(panel, labels).withColumn("forecast_horizon", F.explode(F.array(*[F.lit(int(h)).cast("long") for h in horizons])))
    y = horizon_outcome(F.col("forecast_token"), F.col("forecast_horizon"))
    return rows.withColumn("within_horizon", y).where(F.col("within_horizon").isNotNull())


def hazard_table(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Pre-event prefix rows with the event in the last bin; zero-width bins drop out."""
    rows = labelled_panel(panel, labels)
    keep = F.when(F.col("event_observed"), F.col("forecast_token") <= F.col("interval_lower")).otherwise(
        F.col("forecast_token") < F.col("censoring_time")
    )
    w = Window.partitionBy("run_id").orderBy("forecast_token")
    rows = rows.where(keep).withColumn("__next", F.lead("forecast_token").over(w))
    last = F.col("__next").isNull()
    end = F.when(~last, F.col("__next")).when(F.col("event_observed"), F.col("interval_upper")).otherwise(F.col("censoring_time"))
    out = rows.withColumn("in_bin", (last & F.col("event_observed")).cast("long")).withColumn("interval_end", end)
    return out.withColumn("width", F.col("interval_end") - F.col("forecast_token")).where("width > 0").withColumn(
        "time_log1p", F.log1p(F.col("forecast_token").cast("double"))
    ).drop("__next")


def next_anchor(labels: DataFrame, probes: DataFrame, resolution: int = 16) -> DataFrame:
    """Midpoint of an event interval wider than ``resolution`` that was not probed yet."""
    mid = F.floor((F.col("interval_lower") + F.col("interval_upper")) / 2)
    wide = labels.where((F.col("interval_upper") - F.col("interval_lower") > resolution) & (mid > 0))
    todo = wide.select(*RUN, mid.alias("anchor"))
    return todo.join(probes.select("run_id", "anchor"), ["run_id", "anchor"], "left_anti")


def event_filter(labels: DataFrame, last: DataFrame, tau: float, instant_max: int) -> DataFrame:
    """Status of each run: instant, delayed, censored at threshold, censored."""
    hi = F.col("interval_upper")
    status = (
        F.when(F.col("event_observed") & (hi <= instant_max), "instant").when(F.col("event_observed"), "delayed")
        .when(F.col("final_rate") >= tau, "censored_at_threshold").otherwise("censored")
    )
    return labels.join(last.select("run_id", "final_anchor", "final_rate"), "run_id").withColumn("status", status)


def restart_dose_response(table: DataFrame, budgets: Sequence[int], tau: float = 0.75) -> DataFrame:
    """Share of complete restart rows reaching tau per model and budget."""
    cols = [f"r_{b}" for b in budgets]
    full = table.dropna(subset=cols)
    long = full.select("model_key", F.explode(F.array(*[
        F.struct(F.lit(b).cast("long").alias("budget"), F.col(f"r_{b}").alias("r")) for b in budgets
    ])).alias("x")).select("model_key", "x.*")
    return long.groupBy("model_key", "budget").agg(F.count(F.lit(1)).alias("cells"), rate(F.col("r") >= tau).alias("share"))


def success_histogram(cells: DataFrame, trials: int, low: int, high: int) -> DataFrame:
    """Pooled cells of exactly ``trials`` trials by success count, zero-filled, with a band."""
    used = cells.where(F.col("continuations") == trials)
    counts = used.groupBy("model_key", "successes").agg(F.count(F.lit(1)).alias("n"))
    axis = F.sequence(F.lit(0).cast("long"), F.lit(trials).cast("long"))
    grid = used.select("model_key").distinct().select("model_key", F.explode(axis).alias("successes"))
    band = F.when(F.col("successes") <= low, "low").when(F.col("successes") >= high, "high").otherwise("mid")
    return grid.join(counts, ["model_key", "successes"], "left").select(
        "model_key", "successes", F.coalesce("n", F.lit(0)).alias("cells"), band.alias("band")
    )


def matched_compute(adv: DataFrame) -> DataFrame:
    """Prefix against restart at equal total budget: wins, ties, losses per model."""
    d = F.col("adv")
    return adv.groupBy("model_key").agg(
        count_where(d > 1e-12).alias("wins"), count_where(F.abs(d) <= 1e-12).alias("ties"),
        count_where(d < -1e-12).alias("losses"), F.avg(d).alias("mean_advantage"),
    )


def class_audit(df: DataFrame, split: str, target: str) -> DataFrame:
    """Rows, problems and class counts per split, and whether train and test hold both classes."""
    y = F.col(target).cast("long")
    per = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("problem_id").alias("problems"),
        F.sum(y).alias("positives"), F.sum(1 - y).alias("negatives"),
    )
    good = count_where(F.col(split).isin("train", "test") & (F.col("positives") > 0) & (F.col("negatives") > 0))
    return per.withColumn("viable", per.agg((good == 2).alias("v")).scalar())


def branch_audit(observed: DataFrame, probes: DataFrame) -> DataFrame:
    """Expected (run, anchor, branch) keys against the observed ones: missing and unexpected."""
    wanted = probes.select("run_id", "anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("continuations") - 1)).alias("branch"), F.lit(1).alias("e"))
    seen = observed.groupBy("run_id", "anchor", "branch").agg(F.count(F.lit(1)).alias("o"))
    both = wanted.join(seen, ["run_id", "anchor", "branch"], "full_outer")
    return both.agg(
        count_where(F.col("e").isNotNull()).alias("expected"), count_where(F.col("o").isNull()).alias("missing"),
        count_where(F.col("e").isNull()).alias("unexpected"), count_where(F.col("o") > 1).alias("duplicated"),
    )
