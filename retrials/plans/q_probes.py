"""Queries over anchor probes and restart panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.operators import contracts as C
from retrials.operators import labels as L
from retrials.plans import fixtures as X
from retrials.plans.registry import query

EVENT = """run_id, problem_id, model_key, event_observed, interval_lower, interval_upper, event_time_proxy, censoring_time, stable_anchor, stability_anchor"""
PREFIXES = [32, 64, 128, 256, 512, 1024, 2048, 4096]
PANEL = f"""fpanel AS (SELECT run_id, problem_id, model_key, f AS forecast_token, last_anchor + 32*(run_id % 3) AS observed_token_count
  FROM (SELECT run_id, problem_id, model_key, max(anchor) AS last_anchor FROM probes GROUP BY ALL), (SELECT unnest({PREFIXES}) AS f)
  WHERE last_anchor + 32*(run_id % 3) >= f), lp AS (SELECT p.*, event_observed, interval_lower, interval_upper, censoring_time
  FROM fpanel p JOIN event_labels l USING (run_id))"""


def _panel(spark, sf):
    last = X.probes(spark, sf).groupBy(*L.RUN).agg(F.max("anchor").alias("a"))
    return last.select(*L.RUN, (F.col("a") + 32 * (F.col("run_id") % 3)).alias("observed_token_count"),
                       F.explode(F.array(*[F.lit(p).cast("long") for p in PREFIXES])).alias("forecast_token"))


def _labels(spark, sf):
    return L.stable_crossing(X.probes(spark, sf), [0.75]).drop("tau")


@query("l01_stable_crossing", f"SELECT {EVENT} FROM event_labels")
def _(spark, sf):
    return _labels(spark, sf)


@query("l02_checked_probes", "SELECT model_key, count(*) AS cells, I(sum(continuations)) AS trials, I(sum(successes)) AS successes FROM probes GROUP BY 1")
def _(spark, sf):
    return L.checked_probes(X.probes(spark, sf)).groupBy("model_key").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("continuations").alias("trials"), F.sum("successes").alias("successes"))


@query("l03_threshold_grid", """
SELECT model_key, cast(tau AS double) AS tau, count(*) AS runs, count(hit) AS events, R(avg(hit)) AS mean_stable_anchor FROM labels_at GROUP BY ALL""")
def _(spark, sf):
    t = L.stable_crossing(X.probes(spark, sf), [0.5, 0.75, 1.0])
    return t.groupBy("model_key", "tau").agg(F.count(F.lit(1)).alias("runs"), F.count("stable_anchor").alias("events"),
                                             F.avg("stable_anchor").alias("mean_stable_anchor"))


@query("l04_crossing_shift", """
WITH a AS (SELECT run_id, problem_id, model_key, min(anchor) FILTER (successes/continuations >= 0.75) AS c FROM base_probes GROUP BY ALL),
 b AS (SELECT run_id, min(anchor) FILTER (successes/continuations >= 0.75) AS v FROM probes GROUP BY ALL)
SELECT a.*, c AS canonical_first, v AS variant_first, c - v AS shift, c - v >= 1024*2/3 AS large_shift FROM a JOIN b USING (run_id)""".replace("a.*, c AS", "run_id, problem_id, model_key, c AS"))
def _(spark, sf):
    return L.crossing_shift(X.probes(spark, sf, "base"), X.probes(spark, sf), 0.75, 1024)


TERMINAL = """lad AS (SELECT *, successes/continuations AS rate, lead(successes/continuations) OVER w AS nr, coalesce(lag(anchor) OVER w, 0) AS pa,
    lead(anchor) OVER w AS na FROM base_probes WINDOW w AS (PARTITION BY run_id ORDER BY anchor)),
  cens AS (SELECT run_id FROM lad GROUP BY 1 HAVING count(*) FILTER (rate >= 0.75 AND nr >= 0.75) = 0),
  term AS (SELECT l.run_id, l.problem_id, l.model_key, l.anchor AS final_anchor, rate AS final_rate, I(l.successes + e.successes) AS pooled_successes,
    I(l.continuations + e.continuations) AS pooled_continuations, (l.successes + e.successes)/(l.continuations + e.continuations) AS pooled_rate, pa
    FROM lad l JOIN cens USING (run_id) JOIN extra_probes e ON e.run_id = l.run_id AND e.anchor = l.anchor WHERE na IS NULL AND rate >= 0.75)"""


@query("l05_terminal_replication", f"""WITH {TERMINAL}
SELECT run_id, problem_id, model_key, final_anchor, R(final_rate) AS final_rate, pooled_successes, pooled_continuations, R(pooled_rate) AS pooled_rate,
  pooled_rate >= 0.75 AS event_observed, CASE WHEN pooled_rate >= 0.75 THEN pa ELSE final_anchor END AS interval_lower,
  CASE WHEN pooled_rate >= 0.75 THEN final_anchor END AS interval_upper FROM term""")
def _(spark, sf):
    return L.terminal_replication(X.probes(spark, sf, "base"), X.probes(spark, sf, "extra"))


POOLED = """pooled AS (SELECT b.run_id, b.problem_id, b.model_key, b.anchor, b.successes + CASE WHEN b.successes > 0 AND b.successes < b.continuations THEN coalesce(e.successes, 0) ELSE 0 END AS successes,
    b.continuations + CASE WHEN b.successes > 0 AND b.successes < b.continuations THEN coalesce(e.continuations, 0) ELSE 0 END AS continuations
    FROM base_probes b LEFT JOIN extra_probes e ON e.run_id = b.run_id AND e.anchor = b.anchor)"""


@query("l06_ambiguity_pooling", f"""WITH {POOLED},
  o AS (SELECT run_id, model_key, min(anchor) FILTER (r >= 0.75 AND nr >= 0.75) AS h FROM (SELECT *, successes/continuations AS r, lead(successes/continuations) OVER (PARTITION BY run_id ORDER BY anchor) AS nr FROM base_probes) GROUP BY ALL),
  n AS (SELECT run_id, min(anchor) FILTER (r >= 0.75 AND nr >= 0.75) AS g FROM (SELECT *, successes/continuations AS r, lead(successes/continuations) OVER (PARTITION BY run_id ORDER BY anchor) AS nr FROM pooled) GROUP BY ALL)
SELECT model_key, CASE WHEN h IS NOT DISTINCT FROM g THEN 'unchanged' WHEN h IS NULL THEN 'gained' WHEN g IS NULL THEN 'lost' ELSE 'moved' END AS change, count(*) AS runs
FROM o JOIN n USING (run_id) GROUP BY ALL""")
def _(spark, sf):
    base = X.probes(spark, sf, "base")
    pooled = L.pool_ambiguous(base, X.probes(spark, sf, "extra"))
    return L.label_changes(L.stable_crossing(base), L.stable_crossing(pooled))


@query("j08_restart_rate_at_budget", """
SELECT run_id, anchor, R(rate) AS rate, R(r_hat) AS r_hat, R(r_cons) AS r_cons FROM advantage""")
def _(spark, sf):
    adv = L.advantage(X.probes(spark, sf), X.restarts(spark, sf))
    return adv.select("run_id", "anchor", "rate", "r_hat", "r_cons")


@query("l07_prefix_advantage", """
SELECT run_id, R(max(rate - r_hat)) AS max_advantage, R(max(rate - r_cons)) AS max_conservative FROM advantage GROUP BY 1""")
def _(spark, sf):
    adv = L.advantage(X.probes(spark, sf), X.restarts(spark, sf))
    return adv.groupBy("run_id").agg(F.max("adv").alias("max_advantage"), F.max("adv_cons").alias("max_conservative"))


CROSS = """adv2 AS (SELECT *, rate - r_hat AS a, rate - r_cons AS ac, lead(rate) OVER w AS rate2, lead(rate - r_hat) OVER w AS a2, lead(rate - r_cons) OVER w AS ac2
    FROM advantage WINDOW w AS (PARTITION BY run_id ORDER BY anchor)),
  crossing AS (SELECT run_id, problem_id, model_key, d, min(anchor) FILTER (rate >= 0.75 AND rate2 >= 0.75 AND a >= d AND a2 >= d) AS t,
    min(anchor) FILTER (rate >= 0.75 AND rate2 >= 0.75 AND ac >= d AND ac2 >= d) AS tc FROM adv2, (SELECT unnest([0.25, 0.5, 0.75]) AS d) GROUP BY ALL)"""


@query("l08_advantage_crossing", f"WITH {CROSS} SELECT run_id, problem_id, model_key, cast(d AS double) AS delta, t AS crossing FROM crossing")
def _(spark, sf):
    return L.advantage_crossing(L.advantage(X.probes(spark, sf), X.restarts(spark, sf)), "adv", (0.25, 0.5, 0.75))


REGIME = f"""{CROSS}, {TERMINAL},
  r AS (SELECT run_id, max(rate) FILTER (budget = 1024) AS r_1024, max(rate) FILTER (budget = 2048) AS r_2048, max(rate) FILTER (budget = 4096) AS r_4096,
    max(rate) FILTER (budget = 8192) AS r_8192 FROM restarts GROUP BY 1),
  w AS (SELECT run_id, max(t) FILTER (d = 0.25) AS t_v_d025, max(t) FILTER (d = 0.5) AS t_v_d050, max(t) FILTER (d = 0.75) AS t_v_d075,
    max(tc) FILTER (d = 0.5) AS t_c_d050 FROM crossing GROUP BY 1),
  pk AS (SELECT run_id, max(rate - r_hat) AS max_advantage FROM advantage GROUP BY 1),
  regime AS (SELECT e.run_id, e.problem_id, e.model_key, event_observed, event_observed AND stable_anchor <= 64 AS instant, max_advantage, t_v_d025, t_v_d050, t_v_d075,
    t_c_d050, r_1024, r_2048, r_4096, r_8192,
    CASE WHEN event_observed AND stable_anchor <= 64 THEN CASE WHEN coalesce(r_1024, 0) >= 0.75 THEN 'instant_scratch_solvable'
        WHEN t_v_d050 IS NOT NULL THEN 'instant_prefix_advantaged' ELSE 'instant_ambiguous' END
      WHEN r_4096 >= 0.75 THEN 'budget_limited' WHEN t_v_d050 IS NOT NULL THEN 'prefix_limited' WHEN event_observed THEN 'no_crossing_at_primary_delta'
      WHEN e.run_id IN (SELECT run_id FROM term WHERE pooled_rate >= 0.75) THEN 'terminal_A1' ELSE 'unsolved_hard' END AS regime,
    (t_v_d050 IS NULL) = (t_c_d050 IS NULL) AS conservative_agrees
    FROM event_labels e JOIN pk USING (run_id) JOIN w USING (run_id) JOIN r USING (run_id))"""


def _regimes(spark, sf):
    p = X.probes(spark, sf)
    terminal = L.terminal_replication(X.probes(spark, sf, "base"), X.probes(spark, sf, "extra"))
    return L.regimes(p, X.restarts(spark, sf), _labels(spark, sf), terminal, instant_max=64)


@query("l09_regimes", f"""WITH {REGIME} SELECT run_id, problem_id, model_key, event_observed, instant, R(max_advantage) AS max_advantage, t_v_d025, t_v_d050, t_v_d075,
  t_c_d050, R(r_1024) AS r_1024, R(r_2048) AS r_2048, R(r_4096) AS r_4096, R(r_8192) AS r_8192, regime, conservative_agrees FROM regime""")
def _(spark, sf):
    return _regimes(spark, sf)


@query("l10_regime_summary", f"""WITH {REGIME}
SELECT model_key, 'regime' AS kind, regime AS value, count(*) AS runs FROM regime GROUP BY ALL
UNION ALL SELECT model_key, 'crossing', 'd025', count(*) FROM regime WHERE NOT instant AND t_v_d025 IS NOT NULL GROUP BY ALL
UNION ALL SELECT model_key, 'crossing', 'd050', count(*) FROM regime WHERE NOT instant AND t_v_d050 IS NOT NULL GROUP BY ALL
UNION ALL SELECT model_key, 'crossing', 'd075', count(*) FROM regime WHERE NOT instant AND t_v_d075 IS NOT NULL GROUP BY ALL
UNION ALL SELECT model_key, 'conservative', 'disagrees', count(*) FROM regime WHERE NOT conservative_agrees GROUP BY ALL""")
def _(spark, sf):
    return L.regime_summary(_regimes(spark, sf))


@query("j14_cross_model_agreement", f"""WITH {REGIME}, c AS (SELECT problem_id, model_key, CASE WHEN regime LIKE 'instant%' THEN 'instant'
    WHEN regime IN ('no_crossing_at_primary_delta', 'terminal_A1') THEN 'other' WHEN regime = 'unsolved_hard' THEN 'unsolved' ELSE regime END AS c FROM regime),
  p AS (SELECT problem_id, max(c) FILTER (model_key='m0') AS l, max(c) FILTER (model_key='m1') AS r FROM c GROUP BY 1)
SELECT count(*) AS both, count(*) FILTER (l = r) AS agree FROM p WHERE l IS NOT NULL AND r IS NOT NULL""")
def _(spark, sf):
    return L.cross_model_agreement(_regimes(spark, sf), "m0", "m1")


OUTCOME = """CASE WHEN event_observed THEN CASE WHEN interval_upper <= {p} THEN NULL WHEN interval_lower >= {p} AND interval_upper <= {p} + {h} THEN 1
  WHEN interval_lower >= {p} + {h} THEN 0 END WHEN censoring_time >= {p} + {h} THEN 0 END"""


@query("l11_horizon_outcome", f"SELECT run_id, I({OUTCOME.format(p='128', h='512')}) AS outcome FROM event_labels")
def _(spark, sf):
    return _labels(spark, sf).select("run_id", L.horizon_outcome(F.lit(128), F.lit(512)).alias("outcome"))


@query("l12_horizon_table", f"""WITH {PANEL}, hz AS (SELECT *, I(h) AS forecast_horizon, {OUTCOME.format(p='forecast_token', h='h')} AS y FROM lp, (SELECT unnest([128, 512, 2048]) AS h))
SELECT run_id, problem_id, model_key, I(forecast_token) AS forecast_token, forecast_horizon, I(y) AS within_horizon FROM hz WHERE y IS NOT NULL""")
def _(spark, sf):
    return L.horizon_table(_panel(spark, sf), _labels(spark, sf), [128, 512, 2048]).select(
        *L.RUN, "forecast_token", "forecast_horizon", "within_horizon")


@query("l13_hazard_table", f"""WITH {PANEL}, k AS (SELECT *, lead(forecast_token) OVER (PARTITION BY run_id ORDER BY forecast_token) AS nx FROM lp
    WHERE CASE WHEN event_observed THEN forecast_token <= interval_lower ELSE forecast_token < censoring_time END),
  z AS (SELECT *, CASE WHEN nx IS NOT NULL THEN nx WHEN event_observed THEN interval_upper ELSE censoring_time END AS e FROM k)
SELECT run_id, I(forecast_token) AS forecast_token, I(CASE WHEN nx IS NULL AND event_observed THEN 1 ELSE 0 END) AS in_bin, I(e) AS interval_end,
  I(e - forecast_token) AS width, R(ln(1 + forecast_token)) AS time_log1p FROM z WHERE e > forecast_token""")
def _(spark, sf):
    return L.hazard_table(_panel(spark, sf), _labels(spark, sf)).select(
        "run_id", "forecast_token", "in_bin", "interval_end", "width", "time_log1p")


@query("l16_next_anchor", """
SELECT run_id, problem_id, model_key, I((interval_lower + interval_upper)//2) AS anchor FROM event_labels e
WHERE interval_upper - interval_lower > 16 AND NOT EXISTS (SELECT 1 FROM probes p WHERE p.run_id = e.run_id AND p.anchor = (e.interval_lower + e.interval_upper)//2)""")
def _(spark, sf):
    return L.next_anchor(_labels(spark, sf), X.probes(spark, sf))


STATUS = """st AS (SELECT e.run_id, e.model_key, e.interval_lower, e.interval_upper, l.anchor AS final_anchor, l.rate AS final_rate,
  CASE WHEN event_observed AND interval_upper <= 64 THEN 'instant' WHEN event_observed THEN 'delayed' WHEN l.rate >= 0.75 THEN 'censored_at_threshold' ELSE 'censored' END AS status
  FROM event_labels e JOIN (SELECT run_id, anchor, rate FROM ladder WHERE next_anchor IS NULL) l USING (run_id))"""


@query("p09_event_status", f"WITH {STATUS} SELECT run_id, status, final_anchor, R(final_rate) AS final_rate FROM st")
def _(spark, sf):
    s = L.event_filter(_labels(spark, sf), L.last_probe(X.probes(spark, sf)), 0.75, 64)
    return s.select("run_id", "status", "final_anchor", "final_rate")


@query("a40_event_status_counts", f"WITH {STATUS} SELECT model_key, status, count(*) AS runs, R(avg(interval_lower)) AS mean_lower FROM st GROUP BY ALL")
def _(spark, sf):
    s = L.event_filter(_labels(spark, sf), L.last_probe(X.probes(spark, sf)), 0.75, 64)
    return s.groupBy("model_key", "status").agg(F.count(F.lit(1)).alias("runs"), F.avg("interval_lower").alias("mean_lower"))


@query("a35_restart_dose_response", f"""WITH {REGIME}, c AS (SELECT model_key, unnest([1024, 2048, 4096, 8192]) AS budget, unnest([r_1024, r_2048, r_4096, r_8192]) AS r FROM regime
    WHERE r_1024 IS NOT NULL AND r_2048 IS NOT NULL AND r_4096 IS NOT NULL AND r_8192 IS NOT NULL AND NOT instant)
SELECT model_key, I(budget) AS budget, count(*) AS cells, R(avg((r >= 0.75)::int)) AS share FROM c GROUP BY ALL""")
def _(spark, sf):
    return L.restart_dose_response(_regimes(spark, sf).where("not instant"), (1024, 2048, 4096, 8192))


@query("a36_success_histogram", f"""WITH {POOLED}, g AS (SELECT DISTINCT model_key, unnest(range(9)) AS s FROM pooled WHERE continuations = 8),
  c AS (SELECT model_key, successes, count(*) AS n FROM pooled WHERE continuations = 8 GROUP BY ALL)
SELECT g.model_key, I(s) AS successes, I(coalesce(n, 0)) AS cells, CASE WHEN s <= 2 THEN 'low' WHEN s >= 6 THEN 'high' ELSE 'mid' END AS band
FROM g LEFT JOIN c ON c.model_key = g.model_key AND c.successes = s""")
def _(spark, sf):
    return L.success_histogram(L.pool_ambiguous(X.probes(spark, sf, "base"), X.probes(spark, sf, "extra")), 8, 2, 6)


@query("a41_matched_compute", """
SELECT model_key, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses, R(avg(d)) AS mean_advantage
FROM (SELECT model_key, rate - r_hat AS d FROM advantage) GROUP BY 1""")
def _(spark, sf):
    return L.matched_compute(L.advantage(X.probes(spark, sf), X.restarts(spark, sf)))


@query("a22_class_audit", f"""WITH {PANEL}, hz AS (SELECT *, {OUTCOME.format(p='forecast_token', h='512')} AS y,
    CASE WHEN problem_id % 5 < 3 THEN 'train' WHEN problem_id % 5 = 3 THEN 'validation' ELSE 'test' END AS research_split FROM lp),
  c AS (SELECT research_split, count(*) AS rows, count(DISTINCT problem_id) AS problems, I(sum(y)) AS positives, I(sum(1-y)) AS negatives FROM hz WHERE y IS NOT NULL GROUP BY 1)
SELECT *, (SELECT count(*) = 2 FROM c WHERE research_split IN ('train','test') AND positives > 0 AND negatives > 0) AS viable FROM c""")
def _(spark, sf):
    t = L.horizon_table(_panel(spark, sf), _labels(spark, sf), [512])
    k = F.col("problem_id") % 5
    split = F.when(k < 3, "train").when(k == 3, "validation").otherwise("test")
    return L.class_audit(t.withColumn("research_split", split), "research_split", "within_horizon")


@query("j13_disjoint_panels", """
SELECT model_key, budget, count(*) AS cells, I(sum(successes)) AS successes FROM restarts GROUP BY ALL""")
def _(spark, sf):
    r = X.restarts(spark, sf)
    from retrials.operators import joins as J
    u = J.disjoint_union(r.where("run_id % 2 = 0"), r.where("run_id % 2 = 1"), ["run_id"])
    return u.groupBy("model_key", "budget").agg(F.count(F.lit(1)).alias("cells"), F.sum("successes").alias("successes"))


@query("c07_branch_audit", """
WITH o AS (SELECT l_partkey AS run_id, I(64*power(2, l_linenumber-1)) AS anchor, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS branch,
    l_suppkey % 10 AS s FROM lineitem), w AS (SELECT run_id, anchor, unnest(range(continuations)) AS branch FROM probes), k AS (SELECT DISTINCT run_id, anchor, branch FROM o WHERE s <> 0)
SELECT (SELECT count(*) FROM w) AS expected, (SELECT count(*) FROM w ANTI JOIN k USING (run_id, anchor, branch)) AS missing, I(0) AS unexpected, I(0) AS duplicated""")
def _(spark, sf):
    from retrials.functions.ordered import position
    line = X.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("run_id"), (64 * F.pow(F.lit(2), F.col("l_linenumber") - 1)).cast("long").alias("anchor"),
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = position(line, ["run_id", "anchor"], ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    seen = rows.where("l_suppkey % 10 <> 0").select("run_id", "anchor", (F.col("position") - 1).alias("branch"))
    return L.branch_audit(seen, X.probes(spark, sf))
