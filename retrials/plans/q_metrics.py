"""Queries over attempts: power, association, effects, within-problem metrics, bootstrap family."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.operators import aggregates as A
from retrials.operators import associations as S
from retrials.operators import discrimination as D
from retrials.operators import resampling as B
from retrials.plans import fixtures as X
from retrials.plans.q_attempts import LOO, auroc_sql, picks_sql
from retrials.plans.registry import query


@query("a20_power_gate", """
SELECT model_key, level, count(*) AS rows, count(DISTINCT problem_id) FILTER (correct) AS positive_problems, count(DISTINCT problem_id) FILTER (NOT correct) AS negative_problems,
 least(count(DISTINCT problem_id) FILTER (correct), count(DISTINCT problem_id) FILTER (NOT correct)) >= 390 AS powered FROM attempts GROUP BY ALL""")
def _(spark, sf):
    return A.power_gate(X.attempts(spark, sf), ["model_key", "level"], "correct", 390)


@query("a21_cluster_outcomes", """
WITH p AS (SELECT model_key, research_split, a.level, problem_id, max(correct::int) AS y1, min(correct::int) AS y0, count(*) AS n, sum(correct::int) AS s FROM attempts a JOIN problem_splits USING (problem_id) GROUP BY ALL)
SELECT model_key, research_split, level, count(*) AS problems, I(sum(n)) AS attempts, I(sum(s)) AS positive_attempts, I(sum(y1)) AS positive_problems, count(*) FILTER (y1 = 0) AS negative_problems,
 count(*) FILTER (y1 <> y0) AS mixed_problems, sum(y1) = 0 OR sum(y1) = count(*) AS degenerate FROM p GROUP BY ALL""")
def _(spark, sf):
    rows = X.attempts(spark, sf).join(X.problem_splits(spark, sf).drop("level"), "problem_id")
    return A.cluster_outcomes(rows, "correct", ["model_key", "research_split", "level"])


@query("a21_seed_concordance", """
WITH p AS (SELECT model_key, problem_id, max(correct::int) FILTER (mseed = 1) AS a, max(correct::int) FILTER (mseed = 2) AS b FROM seeded GROUP BY ALL)
SELECT model_key, count(*) AS pairs, R(avg((a = b)::int)) AS concordance, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 0 AND b = 0) AS neither
FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return A.seed_concordance(X.seeded(spark, sf, True).drop("seed").withColumnRenamed("mseed", "seed"), 1, 2)


MR = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1)/2.0"


@query("a23_level_adjusted_spearman", f"""
WITH d AS (SELECT model_key, tax AS x, ln(1+tokens) AS y, tax - avg(tax) OVER w AS ax, ln(1+tokens) - avg(ln(1+tokens)) OVER w AS ay FROM attempts WINDOW w AS (PARTITION BY model_key, level)),
 q AS (SELECT model_key, x, y, round(ax, 12) AS ax, round(ay, 12) AS ay FROM d),
 r AS (SELECT model_key, {MR.format(k='model_key', v='x')} AS rx, {MR.format(k='model_key', v='y')} AS ry, {MR.format(k='model_key', v='ax')} AS rax, {MR.format(k='model_key', v='ay')} AS ray FROM q)
SELECT model_key, R(corr(rx, ry)) AS raw_rho, R(corr(rax, ray)) AS adjusted_rho, count(*) AS n FROM r GROUP BY 1""")
def _(spark, sf):
    rows = X.attempts(spark, sf).select("model_key", "level", F.col("tax").alias("x"), F.log1p(F.col("tokens").cast("double")).alias("y"))
    return S.level_adjusted_spearman(rows, "x", "y", ["model_key"])


@query("a24_level_trends", f"""
WITH l AS (SELECT * FROM (UNPIVOT (SELECT model_key, level, cast(tokens AS double) AS tokens, tax, discount FROM attempts) ON tokens, tax, discount INTO NAME metric VALUE value)),
 r AS (SELECT model_key, metric, {MR.format(k='model_key, metric', v='level')} AS a, {MR.format(k='model_key, metric', v='value')} AS b FROM l)
SELECT model_key, metric, R(corr(a, b)) AS rho, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, sf):
    return S.level_trends(X.attempts(spark, sf), ["tokens", "tax", "discount"], ["model_key"])


def _two_way() -> str:
    steps = [f"s0 AS (SELECT model_key, level, category, {MR.format(k='model_key', v='tax')} AS a, {MR.format(k='model_key', v='tokens')} AS b FROM attempts)"]
    for i in range(16):
        f = "level" if i % 2 == 0 else "category"
        steps.append(f"s{i+1} AS (SELECT model_key, level, category, a - avg(a) OVER (PARTITION BY model_key, {f}) AS a, b - avg(b) OVER (PARTITION BY model_key, {f}) AS b FROM s{i})")
    return "WITH " + ", ".join(steps) + " SELECT model_key, R(corr(a, b)) AS rho, count(*) AS n FROM s16 GROUP BY 1"


@query("a25_two_way_correlation", _two_way())
def _(spark, sf):
    return S.two_way_correlation(X.attempts(spark, sf), "tax", "tokens", ("level", "category"), ["model_key"])


def instability(spark, sf):
    return materialize(A.seed_instability(X.seeded(spark, sf), ["discount", "tax", "tokens"]))


@query("a26_partial_spearman")
def _(spark, sf):
    return S.partial_spearman(instability(spark, sf), "seed_instability", "mean__tax", ["level", "category"], ["mean__tokens"])


@query("a27_cross_block_matrix")
def _(spark, sf):
    return S.cross_block(instability(spark, sf), "problem_id", ["mean__tax", "sd__tax"], ["mean__discount", "sd__discount"], ["level", "category"], ["mean__tokens"])


@query("a28_redundancy_matrix", f"""
WITH z AS (SELECT {', '.join(f"round(({c} - avg({c}) OVER w)/greatest(stddev_samp({c}) OVER w, 1e-12), 12) AS {c}" for c in ('tokens', 'discount', 'tax'))} FROM attempts WINDOW w AS (PARTITION BY dataset, model_key)),
 r AS (SELECT {', '.join(MR.format(k='1', v=c) + ' AS ' + c for c in ('tokens', 'discount', 'tax'))} FROM z),
 c AS (SELECT coalesce(corr(tokens, discount), 0) AS td, coalesce(corr(tokens, tax), 0) AS tt, coalesce(corr(discount, tax), 0) AS dt FROM r)
SELECT 'tokens' AS row, 'discount' AS "column", R(td) AS rho FROM c UNION ALL SELECT 'discount', 'tokens', R(td) FROM c UNION ALL SELECT 'tokens', 'tax', R(tt) FROM c UNION ALL SELECT 'tax', 'tokens', R(tt) FROM c
UNION ALL SELECT 'discount', 'tax', R(dt) FROM c UNION ALL SELECT 'tax', 'discount', R(dt) FROM c UNION ALL SELECT f, f, R(1) FROM (SELECT unnest(['tokens', 'discount', 'tax']) AS f)""")
def _(spark, sf):
    return S.redundancy_matrix(X.attempts(spark, sf), "run_id", ["dataset", "model_key"], ["tokens", "discount", "tax"])


def boot_sql(stats: str, sums: list[str], groups: list[str], draws: int = 2000, seed: str = "b") -> str:
    """CTE ``reps``: per (groups, draw) totals of per-cluster sums in ``stats`` (problem_id, groups, sums)."""
    g = "".join(f"{x}, " for x in groups)
    part = f"PARTITION BY {', '.join(groups)}" if groups else ""
    key = "".join(f"{x}||':'||" for x in groups)
    using = ", ".join([*groups, "slot"])
    return f"""bx AS (SELECT *, row_number() OVER ({part} ORDER BY H('c:'||problem_id), problem_id) AS slot, count(*) OVER ({part}) AS slots FROM ({stats})),
  bp AS (SELECT {g} draw, H('{seed}:'||{key}draw||':'||slot) % slots + 1 AS slot FROM bx, (SELECT unnest(range({draws})) AS draw)),
  reps AS (SELECT {g} draw, {', '.join(f'sum({s}) AS {s}' for s in sums)} FROM bp JOIN bx USING ({using}) GROUP BY {g} draw)"""


CI = "R(quantile_cont(v, 0.025)) AS ci_low, R(quantile_cont(v, 0.975)) AS ci_high, count(v) AS used_draws, count(*) FILTER (v IS NULL) AS skipped_draws"


@query("a29_correctness_effect", f"""
WITH z AS (SELECT *, tokens/stddev_samp(tokens) OVER (PARTITION BY dataset, model_key) AS z FROM attempts),
 st AS (SELECT dataset, model_key, problem_id, coalesce(sum(z) FILTER (correct), 0) AS t1, count(z) FILTER (correct) AS n1, coalesce(sum(z) FILTER (NOT correct), 0) AS t0, count(z) FILTER (NOT correct) AS n0 FROM z GROUP BY ALL),
 {boot_sql('SELECT * FROM st', ['t1', 'n1', 't0', 'n0'], ['dataset', 'model_key'])},
 p AS (SELECT dataset, model_key, sum(t1)/sum(n1) - sum(t0)/sum(n0) AS effect FROM st GROUP BY ALL)
SELECT dataset, model_key, R(any_value(effect)) AS effect, {CI} FROM (SELECT dataset, model_key, t1/nullif(n1, 0) - t0/nullif(n0, 0) AS v FROM reps) JOIN p USING (dataset, model_key) GROUP BY dataset, model_key""")
def _(spark, sf):
    return S.correctness_effect(X.attempts(spark, sf), "tokens", ["dataset", "model_key"])


@query("a30_mode_transitions", """
WITH p AS (SELECT problem_id, sum(correct::int) FILTER (dataset = 'gsm8k') AS f, sum(correct::int) FILTER (dataset = 'math') AS t FROM attempts GROUP BY 1),
 c AS (SELECT f, t, count(*) AS n FROM p WHERE f IS NOT NULL AND t IS NOT NULL GROUP BY ALL), k AS (SELECT unnest(range((SELECT max(greatest(f, t))::bigint + 1 FROM c))) AS x), g AS (SELECT a.x AS f, b.x AS t FROM k a, k b)
SELECT I(g.f) AS from_successes, I(g.t) AS to_successes, I(coalesce(n, 0)) AS problems, CASE WHEN g.t > g.f THEN 'improved' WHEN g.t < g.f THEN 'worsened' ELSE 'unchanged' END AS direction
FROM g LEFT JOIN c ON c.f = g.f AND c.t = g.t""")
def _(spark, sf):
    return A.mode_transitions(X.attempts(spark, sf), "gsm8k", "math")


@query("a31_compute_frontier", """
WITH p AS (SELECT dataset, mode, problem_id, avg((finish_reason = 'eos')::int) AS a, avg(tokens) AS t FROM attempts GROUP BY ALL)
SELECT dataset, mode, count(*) AS problems, R(avg(a)) AS accuracy, R(avg(t)) AS mean_tokens FROM p GROUP BY ALL""")
def _(spark, sf):
    rows = X.attempts(spark, sf).withColumn("correct", F.col("finish_reason") == "eos")
    return A.compute_frontier(rows, ["dataset", "mode"])


@query("a34_distribution_table", """
WITH l AS (SELECT * FROM (UNPIVOT (SELECT model_key, level, cast(tokens AS double) AS tokens, tax FROM attempts) ON tokens, tax INTO NAME metric VALUE value))
SELECT model_key, level, metric, count(*) AS rows, R(avg(value)) AS mean, R(quantile_cont(value, 0.5)) AS median, R(quantile_cont(value, 0.25)) AS q25, R(quantile_cont(value, 0.75)) AS q75 FROM l GROUP BY ALL""")
def _(spark, sf):
    return A.distribution(X.attempts(spark, sf), ["model_key", "level"], ["tokens", "tax"])


@query("a39_quality_profile", """
SELECT mode, count(*) AS rows, R(avg((finish_reason <> 'answer_reserve')::int)) AS parse_rate, R(avg((finish_reason = 'max_new_tokens')::int)) AS truncation_rate FROM attempts GROUP BY 1""")
def _(spark, sf):
    return A.quality_profile(X.attempts(spark, sf), "mode", F.col("finish_reason") != "answer_reserve", F.col("finish_reason") == "max_new_tokens")


@query("q19_stratum_standardised", """
SELECT run_id, R((tokens - avg(tokens) OVER w)/greatest(stddev_samp(tokens) OVER w, 1e-12)) AS z_tokens FROM attempts WINDOW w AS (PARTITION BY dataset, level)""")
def _(spark, sf):
    return S.standardise(X.attempts(spark, sf), ["dataset", "level"], ["tokens"]).select("run_id", "z_tokens")


@query("e07_auroc_by_subgroup", f"WITH {LOO}, m AS ({auroc_sql('loo', 'loo_rate', 'correct', 'k')}) SELECT I(k) AS k, R(auroc) AS auroc, positives, negatives FROM m")
def _(spark, sf):
    return D.auroc(A.loo_pass_rate(X.attempts(spark, sf)), "loo_rate", "correct", ["k"])


WITHIN = f"per AS (SELECT problem_id, auroc, negatives AS failures, positives AS successes FROM ({auroc_sql('attempts', 'tokens', 'correct', 'problem_id')}) WHERE auroc IS NOT NULL)"


@query("e08_within_problem_auroc", f"WITH {WITHIN} SELECT problem_id, R(auroc) AS auroc, failures, successes FROM per")
def _(spark, sf):
    return D.within_problem(X.attempts(spark, sf), "tokens", "correct")


@query("e08_loo_is_mechanical", f"""WITH {LOO}, m AS ({auroc_sql('loo', 'loo_rate', 'correct', 'problem_id')})
SELECT count(*) AS problems, R(max(auroc)) AS max_auroc FROM m WHERE auroc IS NOT NULL""")
def _(spark, sf):
    per = D.within_problem(A.loo_pass_rate(X.attempts(spark, sf)), "loo_rate", "correct")
    return per.agg(F.count(F.lit(1)).alias("problems"), F.max("auroc").alias("max_auroc"))


@query("e09_within_problem_summary", f"""WITH {WITHIN} SELECT count(*) AS problems, R(sum(auroc*failures)/sum(failures)) AS failure_weighted, R(sum(auroc*failures*successes)/sum(failures*successes)) AS pair_weighted,
 R(max(auroc)) AS max_auroc, count(*) FILTER (auroc > 0.6) AS above_threshold FROM per""")
def _(spark, sf):
    return D.within_problem_summary(D.within_problem(X.attempts(spark, sf), "tokens", "correct"))


@query("b01_replicate_weights", f"""WITH {picks_sql('SELECT DISTINCT problem_id FROM attempts')}, w AS (SELECT problem_id, draw, count(*) AS w FROM picks GROUP BY ALL)
SELECT problem_id, I(sum(coalesce(w, 0))) AS picked, I(count(w)) AS draws_hit, sha256(string_agg(coalesce(w, 0)::varchar, ',' ORDER BY draw)) AS weights_sha256
FROM (SELECT * FROM (SELECT DISTINCT problem_id FROM attempts), (SELECT unnest(range(2000)) AS draw)) LEFT JOIN w USING (problem_id, draw) GROUP BY problem_id""")
def _(spark, sf):
    return B.weight_digests(B.weight_vectors(X.attempts(spark, sf), "problem_id"), "problem_id")


@query("b02_ratio_interval", f"""WITH st AS (SELECT model_key, problem_id, sum(correct::int)::double AS t, count(*)::double AS n FROM attempts GROUP BY ALL), {boot_sql('SELECT * FROM st', ['t', 'n'], ['model_key'])},
 p AS (SELECT model_key, sum(t)/sum(n) AS estimate, count(*) AS clusters FROM st GROUP BY 1)
SELECT model_key, R(any_value(estimate)) AS estimate, any_value(clusters) AS clusters, {CI} FROM (SELECT model_key, t/n AS v FROM reps) JOIN p USING (model_key) GROUP BY model_key""")
def _(spark, sf):
    return B.ratio_interval(X.attempts(spark, sf), F.col("correct").cast("int"), ["model_key"])


@query("b03_mean_of_means_interval", f"""WITH st AS (SELECT model_key, level, problem_id, avg(tokens) AS t, 1.0::double AS n FROM attempts GROUP BY ALL), {boot_sql('SELECT * FROM st', ['t', 'n'], ['model_key', 'level'])},
 p AS (SELECT model_key, level, sum(t)/sum(n) AS estimate, count(*) AS clusters FROM st GROUP BY ALL)
SELECT model_key, level, R(any_value(estimate)) AS estimate, any_value(clusters) AS clusters, {CI} FROM (SELECT model_key, level, t/n AS v FROM reps) JOIN p USING (model_key, level) GROUP BY model_key, level""")
def _(spark, sf):
    return B.mean_of_means_interval(X.attempts(spark, sf), F.col("tokens"), ["model_key", "level"])


@query("b08_slope_interval", f"""WITH m AS (SELECT model_key, problem_id, level, avg(tokens) AS y FROM attempts GROUP BY ALL),
 st AS (SELECT model_key, problem_id, count(y) AS sn, sum(level)::double AS sx, sum(y) AS sy, sum(level*level)::double AS sxx, sum(level*y) AS sxy FROM m GROUP BY ALL),
 {boot_sql('SELECT * FROM st', ['sn', 'sx', 'sy', 'sxx', 'sxy'], ['model_key'])},
 p AS (SELECT model_key, (sum(sn)*sum(sxy) - sum(sx)*sum(sy))/(sum(sn)*sum(sxx) - sum(sx)*sum(sx)) AS slope, count(*) AS clusters FROM st GROUP BY 1)
SELECT model_key, R(any_value(slope)) AS slope, any_value(clusters) AS clusters, {CI} FROM (SELECT model_key, CASE WHEN sn*sxx - sx*sx > 1e-9 THEN (sn*sxy - sx*sy)/(sn*sxx - sx*sx) END AS v FROM reps) JOIN p USING (model_key) GROUP BY model_key""")
def _(spark, sf):
    return B.slope_interval(X.attempts(spark, sf), "level", "tokens", ["model_key"])


@query("b09_spearman_interval", f"""WITH t AS (SELECT problem_id, round(avg(tax), 12) AS x, avg(correct::int) AS y FROM attempts GROUP BY 1),
 {picks_sql('SELECT problem_id FROM t')}, r AS (SELECT draw, x, y FROM picks JOIN t USING (problem_id)),
 q AS (SELECT draw, {MR.format(k='draw', v='x')} AS a, {MR.format(k='draw', v='y')} AS b FROM r), v AS (SELECT draw, corr(a, b) AS v FROM q GROUP BY 1)
SELECT {CI} FROM v""")
def _(spark, sf):
    t = X.attempts(spark, sf).groupBy("problem_id").agg(F.round(F.avg("tax"), 12).alias("x"), F.avg(F.col("correct").cast("double")).alias("y"))
    return B.spearman_interval(t, "x", "y", "problem_id")


@query("b11_within_problem_interval", f"""WITH {WITHIN}, st AS (SELECT problem_id, auroc*failures AS t, failures::double AS n FROM per), {boot_sql('SELECT * FROM st', ['t', 'n'], [])}
SELECT R((SELECT sum(t)/sum(n) FROM st)) AS estimate, (SELECT count(*) FROM st) AS clusters, {CI} FROM (SELECT t/n AS v FROM reps)""")
def _(spark, sf):
    per = D.within_problem(X.attempts(spark, sf), "tokens", "correct")
    return B.ratio_interval(per, F.col("auroc"), weight=F.col("failures"))


@query("b12_permutation_null", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY run_id) AS i FROM attempts),
 d AS (SELECT problem_id, p, correct AS y, row_number() OVER (PARTITION BY p, problem_id ORDER BY H('perm:'||p||':'||run_id), run_id) AS i FROM attempts, (SELECT unnest(range(12)) AS p)),
 j AS (SELECT p, problem_id, tokens, y::int AS y FROM t JOIN d USING (problem_id, i)), h AS (SELECT p, problem_id, tokens, sum(y) AS pos, sum(1-y) AS neg FROM j GROUP BY ALL),
 c AS (SELECT *, sum(neg) OVER (PARTITION BY p, problem_id ORDER BY tokens) AS b FROM h), a AS (SELECT p, problem_id, sum(pos*(b - neg/2.0))/(sum(pos)*sum(neg)) AS auroc, sum(neg) AS f FROM c GROUP BY ALL HAVING sum(pos)*sum(neg) > 0),
 s AS (SELECT p, sum(auroc*f)/sum(f) AS v FROM a GROUP BY 1)
SELECT count(*) AS permutations, R(min(v)) AS null_min, R(max(v)) AS null_max FROM s""")
def _(spark, sf):
    per = B.permuted_aurocs(X.attempts(spark, sf), 12, "tokens")
    stat = per.groupBy("permutation").agg((F.sum(F.col("auroc") * F.col("negatives")) / F.sum("negatives")).alias("v"))
    return stat.agg(F.count(F.lit(1)).alias("permutations"), F.min("v").alias("null_min"), F.max("v").alias("null_max"))


@query("b13_decision_flags", f"""WITH st AS (SELECT level, problem_id, sum(correct::int - 0.335)::double AS t, count(*)::double AS n FROM attempts GROUP BY ALL), {boot_sql('SELECT * FROM st', ['t', 'n'], ['level'])},
 p AS (SELECT level, sum(t)/sum(n) AS estimate FROM st GROUP BY 1), c AS (SELECT level, any_value(estimate) AS e, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM (SELECT level, t/n AS v FROM reps) JOIN p USING (level) GROUP BY level)
SELECT level, R(e) AS estimate, R(lo) AS ci_low, R(hi) AS ci_high, lo > 0 OR hi < 0 AS excludes_zero, CASE WHEN lo > 0 THEN 'positive' WHEN hi < 0 THEN 'negative' ELSE 'inconclusive' END AS outcome, e > 0 AND lo > 0 AS meets_criterion FROM c""")
def _(spark, sf):
    ci = B.ratio_interval(X.attempts(spark, sf), F.col("correct").cast("int") - F.lit(0.335), ["level"])
    return B.decision_flags(ci).drop("clusters", "used_draws", "skipped_draws")
