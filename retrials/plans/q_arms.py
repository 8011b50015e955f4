"""Queries over three-arm branches: contrasts, policies, controller utilities, path audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.operators import aggregates as A
from retrials.operators import contracts as C
from retrials.operators import joins as J
from retrials.operators import policies as P
from retrials.operators import resampling as B
from retrials.plans import fixtures as X
from retrials.plans.q_metrics import CI, boot_sql
from retrials.plans.registry import query

LIMITS = {"short": 40, "medium": 160, "long": 960}


def arms(spark, sf):
    return materialize(X.arms(spark, sf))


LONG = """al AS (SELECT problem_id, source_run_id, branch_index, model_key, level, uncertainty_stratum, 'short' AS arm, short_correct AS correct, short_tokens AS tokens, 40 AS cap FROM arms
 UNION ALL SELECT problem_id, source_run_id, branch_index, model_key, level, uncertainty_stratum, 'medium', medium_correct, medium_tokens, 160 FROM arms
 UNION ALL SELECT problem_id, source_run_id, branch_index, model_key, level, uncertainty_stratum, 'long', long_correct, long_tokens, 960 FROM arms)"""
CON = """cl AS (SELECT problem_id, model_key, uncertainty_stratum, 'medium_minus_short' AS contrast, medium_correct AS h, short_correct AS l FROM arms
 UNION ALL SELECT problem_id, model_key, uncertainty_stratum, 'long_minus_medium', long_correct, medium_correct FROM arms
 UNION ALL SELECT problem_id, model_key, uncertainty_stratum, 'long_minus_short', long_correct, short_correct FROM arms)"""


@query("a10_marginal_returns", """
WITH s AS (SELECT 'short->medium' AS step, medium_correct::int - short_correct::int AS g, medium_tokens - short_tokens AS c FROM arms UNION ALL SELECT 'medium->long', long_correct::int - medium_correct::int, long_tokens - medium_tokens FROM arms)
SELECT step, count(*) AS pairs, R(avg(g)) AS mean_gain, R(avg(c)) AS mean_extra_cost, R(sum(g)*1000/sum(c)) AS gain_per_1000 FROM s GROUP BY 1""")
def _(spark, sf):
    return A.marginal_returns(X.arms(spark, sf), A.ARMS)


@query("a11_arm_summary", f"""WITH {LONG} SELECT model_key, arm, count(*) AS rows, count(DISTINCT problem_id) AS problems, R(avg(correct::int)) AS accuracy, R(avg((tokens < cap)::int)) AS finished_rate,
 count(*) FILTER (tokens >= cap) AS capped, R(avg(tokens)) AS mean_tokens FROM al GROUP BY ALL""")
def _(spark, sf):
    return A.arm_summary(X.arms(spark, sf), LIMITS)


TL = "CASE WHEN NOT {a} AND {b} THEN 'wrong_to_correct' WHEN {a} AND NOT {b} THEN 'correct_to_wrong' WHEN {a} AND {b} THEN 'stable_correct' ELSE 'stable_wrong' END"


@query("a12_matched_transitions", f"""SELECT model_key, {TL.format(a='medium_correct', b='long_correct')} AS transition, CASE WHEN long_tokens < 960 AND long_correct THEN 'finished_correct' WHEN long_tokens < 960 THEN 'finished_wrong' ELSE 'still_capped' END AS extended_outcome,
 count(*) AS rows FROM arms GROUP BY ALL""")
def _(spark, sf):
    return A.matched_transitions(X.arms(spark, sf), "medium", "long", 960)


@query("a13_fate_shares", """WITH c AS (SELECT model_key, CASE WHEN long_correct THEN 'recovered' ELSE 'lost' END AS fate, count(*) AS rows FROM arms WHERE medium_tokens >= 160 GROUP BY ALL)
SELECT model_key, fate, rows, I(sum(rows) OVER (PARTITION BY model_key)) AS model_rows, R(rows/sum(rows) OVER (PARTITION BY model_key)) AS share FROM c""")
def _(spark, sf):
    return A.fate_shares(X.arms(spark, sf), F.col("medium_tokens") >= 160, F.when(F.col("long_correct"), "recovered").otherwise("lost"))


ACC = {a: f"avg({a}_correct::int)" for a in A.ARMS}
EFF = ", ".join(f"R({ACC[a]}) AS {a}_accuracy" for a in A.ARMS) + ", " + ", ".join(
    f"R({ACC[h]} - {ACC[l]}) AS {n}, count(*) FILTER ({h}_correct AND NOT {l}_correct) AS {h}_vs_{l}_rescued, count(*) FILTER (NOT {h}_correct AND {l}_correct) AS {h}_vs_{l}_harmed" for n, h, l in A.CONTRASTS)
GAP = ", ".join(f"R((SELECT {ACC[h]} - {ACC[l]} FROM arms WHERE uncertainty_stratum = 'high') - (SELECT {ACC[h]} - {ACC[l]} FROM arms WHERE uncertainty_stratum = 'low')), NULL, NULL" for _, h, l in A.CONTRASTS)


@query("a14_budget_effects", f"""SELECT uncertainty_stratum, count(*) AS paired_branches, count(DISTINCT problem_id) AS problems, {EFF} FROM arms WHERE uncertainty_stratum IN ('low', 'high') GROUP BY 1
UNION ALL SELECT 'high_minus_low', NULL, NULL, NULL, NULL, NULL, {GAP}""")
def _(spark, sf):
    return A.budget_effects(arms(spark, sf))


@query("a15_dose_response", f"""WITH {LONG} SELECT coalesce(model_key, 'pooled') AS model_key, uncertainty_stratum, arm, count(*) AS rows, count(DISTINCT problem_id) AS problems, R(avg(correct::int)) AS accuracy
FROM al GROUP BY GROUPING SETS ((uncertainty_stratum, arm), (model_key, uncertainty_stratum, arm))""")
def _(spark, sf):
    return A.dose_response(X.arms(spark, sf))


@query("a16_contrast_table", f"""WITH {CON} SELECT coalesce(model_key, 'pooled') AS model_key, uncertainty_stratum, contrast, count(*) AS rows, R(avg(h::int) - avg(l::int)) AS difference, count(*) FILTER (h AND NOT l) AS rescued,
 count(*) FILTER (NOT h AND l) AS harmed, count(*) FILTER (h AND NOT l) - count(*) FILTER (NOT h AND l) AS net FROM cl GROUP BY GROUPING SETS ((uncertainty_stratum, contrast), (model_key, uncertainty_stratum, contrast))""")
def _(spark, sf):
    return A.contrast_table(X.arms(spark, sf))


@query("a17_token_summary", f"""WITH {LONG} SELECT model_key, arm, count(*) AS rows, R(avg(tokens)) AS mean_tokens, R(avg((tokens >= cap)::int)) AS budget_finish_rate, R(median(tokens)) AS median_tokens FROM al GROUP BY ALL""")
def _(spark, sf):
    return A.token_summary(arms(spark, sf), LIMITS)


@query("a18_transition_table", f"""WITH {CON}, c AS (SELECT uncertainty_stratum, contrast, {TL.format(a='l', b='h')} AS transition, count(*) AS n FROM cl GROUP BY ALL),
 t AS (SELECT uncertainty_stratum, contrast, sum(n) AS total FROM c GROUP BY ALL), g AS (SELECT *, unnest(['wrong_to_correct', 'correct_to_wrong', 'stable_correct', 'stable_wrong']) AS transition FROM t)
SELECT g.uncertainty_stratum, g.contrast, g.transition, I(coalesce(n, 0)) AS rows, R(coalesce(n, 0)/total) AS rate FROM g LEFT JOIN c ON c.uncertainty_stratum = g.uncertainty_stratum AND c.contrast = g.contrast AND c.transition = g.transition""")
def _(spark, sf):
    return A.transition_table(arms(spark, sf))


@query("a19_censoring_table", f"""WITH {LONG} SELECT model_key, arm, count(*) AS rows, R(avg((tokens < cap)::int)) AS eos_rate, R(avg((tokens >= cap)::int)) AS limit_rate,
 R(avg(correct::int) FILTER (tokens < cap)) AS accuracy_if_eos, R(avg(correct::int) FILTER (tokens >= cap)) AS accuracy_if_limit FROM al GROUP BY ALL""")
def _(spark, sf):
    return A.censoring_table(X.arms(spark, sf), LIMITS)


@query("b06_paired_contrast_interval", f"""WITH {CON}, st AS (SELECT contrast, problem_id, sum(h::int - l::int)::double AS t, count(*)::double AS n FROM cl GROUP BY ALL), {boot_sql('SELECT * FROM st', ['t', 'n'], ['contrast'])},
 p AS (SELECT contrast, sum(t)/sum(n) AS estimate, count(*) AS clusters FROM st GROUP BY 1)
SELECT contrast, R(any_value(estimate)) AS estimate, any_value(clusters) AS clusters, {CI} FROM (SELECT contrast, t/n AS v FROM reps) JOIN p USING (contrast) GROUP BY contrast""")
def _(spark, sf):
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), (F.col(f"{h}_correct").cast("int") - F.col(f"{l}_correct").cast("int")).alias("d")) for n, h, l in A.CONTRASTS]))
    long = X.arms(spark, sf).select("problem_id", parts.alias("c")).select("problem_id", "c.*")
    return B.ratio_interval(long, F.col("d"), ["contrast"])


@query("b07_interaction_interval", f"""WITH st AS (SELECT problem_id, coalesce(sum(long_correct::int - medium_correct::int) FILTER (uncertainty_stratum = 'high'), 0)::double AS th, count(*) FILTER (uncertainty_stratum = 'high') AS nh,
   coalesce(sum(long_correct::int - medium_correct::int) FILTER (uncertainty_stratum = 'low'), 0)::double AS tl, count(*) FILTER (uncertainty_stratum = 'low') AS nl FROM arms WHERE uncertainty_stratum IN ('low', 'high') GROUP BY 1), {boot_sql('SELECT * FROM st', ['th', 'nh', 'tl', 'nl'], [])}
SELECT R((SELECT sum(th)/sum(nh) - sum(tl)/sum(nl) FROM st)) AS estimate, (SELECT count(*) FROM st) AS clusters, {CI} FROM (SELECT th/nh - tl/nl AS v FROM reps)""")
def _(spark, sf):
    return A.stratified_interaction(X.arms(spark, sf), "long", "medium")


@query("j10_arm_pivot", f"WITH {LONG} SELECT problem_id, branch_index, level, short_correct, medium_correct, long_correct, short_tokens, medium_tokens, long_tokens FROM arms")
def _(spark, sf):
    long = A.melt_arms(X.arms(spark, sf), ["problem_id", "branch_index", "level"])
    return J.arm_pivot(long, ["problem_id", "branch_index"], A.ARMS, ["correct", "tokens"], "level")


def paths(spark, sf):
    ids = F.sequence(F.lit(1).cast("long"), F.col("long_tokens"))
    longer = F.when(F.col("problem_id") % 11 == 0, F.array_append(F.slice(ids, 1, 3), F.lit(-1).cast("long"))).otherwise(ids)
    return X.arms(spark, sf).select("source_run_id", "short_tokens", "medium_tokens", F.slice(ids, F.lit(1), F.col("short_tokens").cast("int")).alias("s"),
                                    F.slice(ids, F.lit(1), F.col("medium_tokens").cast("int")).alias("m"), longer.alias("l"))


@query("j11_nested_paths", """SELECT source_run_id, least(short_tokens, long_tokens) <= least(medium_tokens, long_tokens) AS short_in_medium,
 CASE WHEN problem_id % 11 = 0 THEN least(medium_tokens, long_tokens) <= 3 ELSE true END AS medium_in_long FROM arms""")
def _(spark, sf):
    return paths(spark, sf).select("source_run_id", J.is_prefix(F.col("s"), F.col("m")).alias("short_in_medium"), J.is_prefix(F.col("m"), F.col("l")).alias("medium_in_long"))


ROUTE = "CASE WHEN uncertainty_score <= {a} THEN 'short' WHEN uncertainty_score <= {b} THEN 'medium' ELSE 'long' END"
ACTED = "acted AS (SELECT *, CASE selected_arm WHEN 'short' THEN short_correct WHEN 'medium' THEN medium_correct ELSE long_correct END AS chosen_correct, 512 + CASE selected_arm WHEN 'short' THEN short_tokens WHEN 'medium' THEN medium_tokens ELSE long_tokens END AS chosen_total FROM {src})"


@query("j12_policy_materialised", f"WITH r AS (SELECT *, {ROUTE.format(a=0.3, b=0.6)} AS selected_arm FROM arms), {ACTED.format(src='r')} SELECT source_run_id, selected_arm, chosen_correct, chosen_total FROM acted")
def _(spark, sf):
    rows = X.arms(spark, sf)
    assignment = rows.select("source_run_id", P.route(F.col("uncertainty_score"), F.lit(0.3), F.lit(0.6)).alias("arm"))
    return P.with_action(J.many_to_one(rows, assignment, ["source_run_id"], "arm"), F.col("arm")).select("source_run_id", "selected_arm", "chosen_correct", "chosen_total")


@query("r03_route", f"SELECT source_run_id, {ROUTE.format(a=0.25, b=0.5)} AS arm, CASE WHEN uncertainty_score <= 0.25 THEN 'short' WHEN uncertainty_score <= 0.5 THEN 'medium' WHEN H('f:'||source_run_id) % 100 / 100 >= 0.7 THEN 'medium' ELSE 'long' END AS arm_with_forecast FROM arms")
def _(spark, sf):
    from retrials.functions.keys import hash60
    u, a, b = F.col("uncertainty_score"), F.lit(0.25), F.lit(0.5)
    f = hash60("f:", F.col("source_run_id")) % 100 / 100
    return X.arms(spark, sf).select("source_run_id", P.route(u, a, b).alias("arm"), P.route(u, a, b, f, F.lit(0.7)).alias("arm_with_forecast"))


METRICS = """count(*) AS rows, R(avg(chosen_correct::int)) AS accuracy, R(avg(chosen_total)) AS mean_reasoning_tokens, R(0) AS mean_answer_tokens, R(avg(chosen_total)) AS mean_total_tokens,
 R(avg((selected_arm = 'short')::int)) AS route_rate_short, R(avg((selected_arm = 'medium')::int)) AS route_rate_medium, R(avg((selected_arm = 'long')::int)) AS route_rate_long"""


@query("r04_action_metrics", f"WITH r AS (SELECT *, {ROUTE.format(a=0.3, b=0.6)} AS selected_arm FROM arms), {ACTED.format(src='r')} SELECT model_key, {METRICS} FROM acted GROUP BY 1")
def _(spark, sf):
    return P.action_metrics(P.with_action(X.arms(spark, sf), P.route(F.col("uncertainty_score"), F.lit(0.3), F.lit(0.6))), ["model_key"])


GRID = ", ".join(repr(x) for x in P.THRESHOLDS)


def grid_sql(src: str) -> str:
    return f"""g AS (SELECT a, b FROM (SELECT unnest([{GRID}]::double[]) AS a), (SELECT unnest([{GRID}]::double[]) AS b) WHERE a < b),
 gr AS (SELECT model_key, a, b, {ROUTE.format(a='a', b='b')} AS selected_arm, short_correct, medium_correct, long_correct, short_tokens, medium_tokens, long_tokens FROM {src}, g), {ACTED.format(src='gr')},
 cand AS (SELECT model_key, a AS short_max, b AS medium_max, count(*) AS rows, avg(chosen_correct::int) AS accuracy, avg(chosen_total) AS mean_total_tokens, avg(long_correct::int) AS fixed_long_accuracy,
   avg((selected_arm = 'short')::int) AS rs, avg((selected_arm = 'medium')::int) AS rm, avg((selected_arm = 'long')::int) AS rl FROM acted GROUP BY ALL),
 pick AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY CASE WHEN accuracy >= fixed_long_accuracy - 0.05 THEN 0 ELSE 1 END, CASE WHEN accuracy >= fixed_long_accuracy - 0.05 THEN mean_total_tokens ELSE -accuracy END,
   CASE WHEN accuracy >= fixed_long_accuracy - 0.05 THEN -accuracy ELSE mean_total_tokens END, short_max, medium_max) AS k FROM cand)"""


@query("r05_threshold_candidates", f"WITH {grid_sql('arms')} SELECT model_key, R(short_max) AS short_max, R(medium_max) AS medium_max, rows, R(accuracy) AS accuracy, R(mean_total_tokens) AS mean_total_tokens, R(rs) AS route_rate_short FROM cand")
def _(spark, sf):
    return P.threshold_candidates(X.arms(spark, sf), ["model_key"]).select("model_key", "short_max", "medium_max", "rows", "accuracy", "mean_total_tokens", "route_rate_short")


TRAIN = "problem_id % 5 < 3"


@query("r06_fitted_policy", f"""WITH tr AS (SELECT * FROM arms WHERE {TRAIN}), {grid_sql('tr')}, best AS (SELECT * FROM pick WHERE k = 1),
 h AS (SELECT arms.*, {ROUTE.format(a='short_max', b='medium_max')} AS selected_arm FROM arms JOIN best USING (model_key) WHERE NOT ({TRAIN})), {ACTED.format(src='h').replace('acted AS', 'ha AS')},
 gt AS (SELECT model_key, count(DISTINCT problem_id) AS hp, avg(chosen_correct::int) AS ha, avg(long_correct::int) AS hl, avg(chosen_total) AS ht FROM ha GROUP BY 1)
SELECT model_key, R(short_max) AS short_max, R(medium_max) AS medium_max, R(accuracy) AS accuracy, R(mean_total_tokens) AS mean_total_tokens,
 CASE WHEN accuracy >= fixed_long_accuracy - 0.05 THEN 'minimum_compute_within_accuracy_gap' ELSE 'no_candidate_met_accuracy_gap' END AS selection_status, hp AS history_problems, R(ha) AS history_accuracy, R(hl) AS history_long_accuracy, R(ht) AS history_tokens,
 hp >= 50 AND ha >= hl - 0.05 AS gate_passed FROM best JOIN gt USING (model_key)""")
def _(spark, sf):
    p = P.fit_policy(arms(spark, sf), F.col("problem_id") % 5 < 3, 50)
    return p.select("model_key", "short_max", "medium_max", "accuracy", "mean_total_tokens", "selection_status", "history_problems", "history_accuracy", "history_long_accuracy", "history_tokens", "gate_passed")


@query("r07_applied_policy", f"WITH p AS (SELECT model_key, CASE model_key WHEN 'm0' THEN 0.2 ELSE 0.4 END AS a, 0.7 AS b FROM (SELECT DISTINCT model_key FROM arms)) SELECT source_run_id, {ROUTE.format(a='a', b='b')} AS selected_arm FROM arms JOIN p USING (model_key)")
def _(spark, sf):
    rows = arms(spark, sf)
    p = rows.select("model_key").distinct().select("model_key", F.when(F.col("model_key") == "m0", 0.2).otherwise(0.4).alias("short_max"), F.lit(0.7).alias("medium_max"))
    p = p.withColumn("digest", P.policy_digest(F.col("short_max"), F.col("medium_max"), F.col("model_key")))
    return P.apply_policy(rows, p, rows.select("source_run_id")).select("source_run_id", "selected_arm")


FAN = f"""fan AS (SELECT arms.*, unnest(['fixed_short', 'fixed_medium', 'fixed_long', 'stratum_selective', 'model_only', 'adaptive']) AS policy,
   unnest(['short', 'medium', 'long', CASE WHEN uncertainty_stratum = 'high' THEN 'long' ELSE 'short' END, CASE WHEN model_key = 'm0' THEN 'medium' ELSE 'long' END, {ROUTE.format(a=0.3, b=0.6)}]) AS selected_arm FROM arms), {ACTED.format(src='fan')}"""


def acted(spark, sf):
    model = F.when(F.col("model_key") == "m0", "medium").otherwise("long")
    return P.policy_arms(X.arms(spark, sf), model, P.route(F.col("uncertainty_score"), F.lit(0.3), F.lit(0.6)))


@query("r08_policy_comparison", f"""WITH {FAN}, st AS (SELECT policy, problem_id, sum(chosen_correct::int) AS c, sum(chosen_total) AS t, count(*) AS n FROM acted GROUP BY ALL), {boot_sql('SELECT * FROM st', ['c', 't', 'n'], ['policy'])},
 p AS (SELECT policy, sum(c)/sum(n) AS a, sum(t)/sum(n) AS m FROM st GROUP BY 1)
SELECT policy, R(any_value(a)) AS accuracy, R(any_value(m)) AS mean_total_tokens, R(quantile_cont(c/n, 0.025)) AS accuracy_low, R(quantile_cont(c/n, 0.975)) AS accuracy_high, R(quantile_cont(t/n, 0.025)) AS tokens_low, R(quantile_cont(t/n, 0.975)) AS tokens_high
FROM reps JOIN p USING (policy) GROUP BY policy""")
def _(spark, sf):
    return P.policy_comparison(acted(spark, sf))


@query("r08_policy_deltas", f"""WITH {FAN}, pr AS (SELECT a.policy, a.problem_id, a.chosen_correct::int - b.chosen_correct::int AS d FROM acted a JOIN (SELECT source_run_id, chosen_correct FROM acted WHERE policy = 'fixed_long') b USING (source_run_id) WHERE a.policy <> 'fixed_long'),
 st AS (SELECT policy, problem_id, sum(d)::double AS t, count(*)::double AS n FROM pr GROUP BY ALL), {boot_sql('SELECT * FROM st', ['t', 'n'], ['policy'])}, p AS (SELECT policy, sum(t)/sum(n) AS estimate, count(*) AS clusters FROM st GROUP BY 1)
SELECT policy, R(any_value(estimate)) AS estimate, any_value(clusters) AS clusters, {CI} FROM (SELECT policy, t/n AS v FROM reps) JOIN p USING (policy) GROUP BY policy""")
def _(spark, sf):
    return P.policy_deltas(materialize(acted(spark, sf)), "fixed_long", ["source_run_id"])


COSTS = {"short": 1024.0, "medium": 4096.0, "long": 24576.0}
PR = "SELECT *, 1 - uncertainty_score AS p_short, 0.5 + 0.4*(1 - uncertainty_score) AS p_medium, 0.8 AS p_long FROM arms"


def with_p(spark, sf):
    u = F.col("uncertainty_score")
    return X.arms(spark, sf).withColumn("p_short", 1 - u).withColumn("p_medium", 0.5 + 0.4 * (1 - u)).withColumn("p_long", F.lit(0.8))


def util_sql(lam: str) -> str:
    return f"SELECT *, p_short - {lam}*cast({COSTS['short']/COSTS['long']!r} AS double) AS us, p_medium - {lam}*cast({COSTS['medium']/COSTS['long']!r} AS double) AS um, p_long - {lam}*1.0 AS ul"


PICK = "CASE WHEN us >= um AND us >= ul THEN 'short' WHEN um >= ul THEN 'medium' ELSE 'long' END"


@query("r09_arm_utilities", f"WITH pr AS ({PR}), u AS ({util_sql('cast(0.2 AS double)')} FROM pr) SELECT source_run_id, R(us) AS utility_short, R(um) AS utility_medium, R(ul) AS utility_long, {PICK} AS selected_arm FROM u")
def _(spark, sf):
    return P.with_utilities(with_p(spark, sf), F.lit(0.2), COSTS).select("source_run_id", "utility_short", "utility_medium", "utility_long", "selected_arm")


@query("r10_selected_penalty", f"""WITH pr AS ({PR}), l AS (SELECT unnest([{', '.join(repr(x) for x in P.PENALTIES)}]::double[]) AS lam), u AS ({util_sql('lam')} FROM pr, l), c AS (SELECT *, {PICK} AS arm FROM u),
 t AS (SELECT lam, avg(CASE arm WHEN 'short' THEN short_correct WHEN 'medium' THEN medium_correct ELSE long_correct END::int) AS a, avg(CASE arm WHEN 'short' THEN 1024 WHEN 'medium' THEN 4096 ELSE 24576 END) AS c, avg(long_correct::int) AS la,
   avg((arm='short')::int) AS rs, avg((arm='medium')::int) AS rm, avg((arm='long')::int) AS rl FROM c GROUP BY 1)
SELECT R(lam) AS penalty, R(a) AS accuracy, R(c) AS mean_token_cost, R(la) AS long_accuracy, R(rs) AS route_rate_short, R(rm) AS route_rate_medium, R(rl) AS route_rate_long FROM t WHERE a >= la - 0.15 ORDER BY c, a DESC, lam LIMIT 1""")
def _(spark, sf):
    return P.select_penalty(with_p(spark, sf), COSTS, 0.15)


@query("r12_remediation_audit", """SELECT source_run_id, true AS has_source, problem_id % 13 <> 0 OR short_tokens <= 1 AS extends_source, medium_tokens - 1 - 0 <= 400 AS answer_within_limit, problem_id % 17 <> 0 AS answer_count_agrees, true AS added_count_agrees,
 CASE WHEN short_correct THEN medium_tokens = short_tokens ELSE medium_tokens > short_tokens END AS added_only_when_censored, true AS known_finish, medium_tokens - 1 <= 400 AS limit_reached_when_said,
 (problem_id % 13 <> 0 OR short_tokens <= 1) AND medium_tokens - 1 <= 400 AND problem_id % 17 <> 0 AND CASE WHEN short_correct THEN medium_tokens = short_tokens ELSE medium_tokens > short_tokens END AS valid FROM arms WHERE short_tokens <= medium_tokens""")
def _(spark, sf):
    a = X.arms(spark, sf).where("short_tokens <= medium_tokens")
    one = F.lit(1).cast("long")
    src = a.select("source_run_id", F.sequence(one, F.col("short_tokens")).alias("tokens"), F.when(F.col("short_correct"), "eos").otherwise("answer_limit").alias("finish_reason"))
    odd = F.transform(F.sequence(one, F.col("medium_tokens")), lambda x: F.when((x == 2) & (F.col("problem_id") % 13 == 0), -x).otherwise(x))
    rep = a.select("source_run_id", odd.alias("tokens"), F.lit("eos").alias("finish_reason"), F.lit(1).alias("reasoning_count"), F.lit(0).alias("inserted_count"),
                   (F.col("medium_tokens") - 1 + F.when(F.col("problem_id") % 17 == 0, 1).otherwise(0)).alias("answer_count"), (F.col("medium_tokens") - F.col("short_tokens")).alias("added_count"))
    return P.remediation_audit(src, rep, ["source_run_id"], 400)


@query("s13_table_digest")
def _(spark, sf):
    return C.table_digest(X.arms(spark, sf).select("source_run_id", "model_key", "short_correct", "long_tokens", "uncertainty_stratum"), exclude=["uncertainty_stratum"])
