"""Queries over the attempts view: pass rates, discrimination, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.operators import aggregates as A
from retrials.operators import discrimination as D
from retrials.operators import resampling as B
from retrials.plans import fixtures as X
from retrials.plans import jobs
from retrials.plans.registry import query

LOO = """loo AS (SELECT a.*, (s - correct::int) / (k - 1) AS loo_rate, k, s / k AS problem_rate FROM attempts a JOIN
  (SELECT problem_id, sum(correct::int) AS s, count(*) AS k FROM attempts GROUP BY 1) t USING (problem_id) WHERE k >= 2)"""

# Bootstrap slots over clusters c(problem_id): picks(draw, problem_id), one row per slot.
def picks_sql(clusters: str, draws: int = 2000, seed: str = "b") -> str:
    return f"""idx AS (SELECT problem_id, row_number() OVER (ORDER BY H('c:'||problem_id), problem_id) AS slot, count(*) OVER () AS slots FROM ({clusters})),
  picks AS (SELECT draw, p.problem_id FROM (
    SELECT draw, H('{seed}:'||draw||':'||slot) % slots + 1 AS pick FROM idx, (SELECT unnest(range({draws})) AS draw)) s
    JOIN idx p ON p.slot = s.pick)"""


AUROC = """SELECT {keys} I(sum(pos)) AS positives, I(sum(neg)) AS negatives,
    CASE WHEN sum(pos)*sum(neg) > 0 THEN sum(pos*(below - neg/2.0)) / (sum(pos)::double*sum(neg)) END AS auroc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY {part} ORDER BY {score}) AS below FROM
    (SELECT {keys} {score}, sum(({label})::int) AS pos, sum(1-({label})::int) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY {keys} {score}))
  {group}"""


def auroc_sql(src: str, score: str, label: str, keys: str = "") -> str:
    """Tie-aware AUROC of ``score`` per ``keys`` as SQL."""
    part = keys or "1"
    return AUROC.format(src=src, score=score, label=label, keys=keys + "," if keys else "", part=part,
                        group=f"GROUP BY {keys}" if keys else "")


@query("a01_loo_pass_rate", f"WITH {LOO} SELECT run_id, problem_id, R(loo_rate) AS loo_rate FROM loo")
def _(spark, sf):
    return A.loo_pass_rate(X.attempts(spark, sf)).select("run_id", "problem_id", "loo_rate")


@query("a02_loo_from_larger_table", """
WITH t AS (SELECT problem_id, sum(correct::int) AS s, count(*) AS k FROM attempts GROUP BY 1)
SELECT run_id, R((s - correct::int)/(k-1)) AS loo_rate, I(k) AS k FROM attempts JOIN t USING (problem_id) WHERE model_key = 'm_F' AND k >= 2""")
def _(spark, sf):
    rows = X.attempts(spark, sf)
    part = rows.where("model_key = 'm_F'")
    return A.loo_pass_rate(part, totals=A.pass_totals(rows)).select("run_id", "loo_rate", "k")


@query("a03_problem_rate_on_rows", """
SELECT run_id, R(avg(correct::int) OVER (PARTITION BY problem_id)) AS problem_rate FROM attempts""")
def _(spark, sf):
    return A.with_problem_rate(X.attempts(spark, sf)).select("run_id", "problem_rate")


@query("a04_attempt_count_distribution", """
SELECT I(k) AS k, count(*) AS problems, I(sum(k)) AS attempts, R(sum(s)/sum(k)) AS base_rate,
  count(*) FILTER (s = 0) AS all_fail, count(*) FILTER (s = k) AS all_pass, count(*) FILTER (s > 0 AND s < k) AS intermediate
FROM (SELECT problem_id, sum(correct::int) AS s, count(*) AS k FROM attempts GROUP BY 1) GROUP BY 1""")
def _(spark, sf):
    return A.k_distribution(X.attempts(spark, sf))


@query("a04_pass_rate_bands", """
WITH t AS (SELECT least(s*10//k, 9) AS band, count(*) AS n FROM (SELECT sum(correct::int) AS s, count(*) AS k FROM attempts GROUP BY problem_id) GROUP BY 1)
SELECT I(b) AS band, I(coalesce(n, 0)) AS problems FROM (SELECT unnest(range(10)) AS b) LEFT JOIN t ON band = b""")
def _(spark, sf):
    return A.pass_rate_bands(X.attempts(spark, sf))


@query("a05_seed_consistency", """
SELECT model_key, problem_id, level, category, I(sum(correct::int)) AS successes, count(DISTINCT seed) AS seeds
FROM seeded GROUP BY ALL""")
def _(spark, sf):
    return A.seed_consistency(X.seeded(spark, sf))


@query("a06_seed_instability", """
SELECT problem_id, min(level) AS level, min(category) AS category, count(DISTINCT seed) AS seeds, I(sum(correct::int)) AS correct_seeds,
  R(avg(correct::int)) AS success_rate, R(1 - avg(correct::int)) AS failure_rate,
  R(CASE WHEN avg(correct::int) > 0 AND avg(correct::int) < 1 THEN
    -(avg(correct::int)*ln(avg(correct::int)) + (1-avg(correct::int))*ln(1-avg(correct::int)))/ln(2) ELSE 0 END) AS seed_instability,
  R(avg(discount)) AS mean__discount, R(stddev_pop(discount)) AS sd__discount, R(avg(tax)) AS mean__tax, R(stddev_pop(tax)) AS sd__tax
FROM seeded GROUP BY problem_id""")
def _(spark, sf):
    return A.seed_instability(X.seeded(spark, sf), ["discount", "tax"])


@query("a07_cell_means", """
WITH p AS (SELECT model_key, level, problem_id, avg(correct::int) AS correct, avg(tokens) AS tokens, avg(tax) AS tax FROM attempts GROUP BY ALL)
SELECT model_key, level, metric, R(avg(value)) AS mean, count(*) AS problems
FROM (UNPIVOT p ON correct, tokens, tax INTO NAME metric VALUE value) GROUP BY ALL""")
def _(spark, sf):
    return A.cell_means(X.attempts(spark, sf), ["model_key", "level"], ["correct", "tokens", "tax"])


@query("a08_level_slopes", """
WITH p AS (SELECT model_key, level, problem_id, avg(correct::int) AS correct, avg(tokens) AS tokens FROM attempts GROUP BY ALL)
SELECT model_key, metric, R(regr_slope(value, level)) AS slope_per_level, count(value) AS problems
FROM (UNPIVOT p ON correct, tokens INTO NAME metric VALUE value) GROUP BY ALL""")
def _(spark, sf):
    return A.level_slopes(X.attempts(spark, sf), ["correct", "tokens"])


@query("a08_level_slope_difference", """
WITH p AS (SELECT level, problem_id, avg(correct::int) FILTER (model_key='m_F') AS lc, avg(correct::int) FILTER (model_key='m_O') AS rc,
    avg(tokens) FILTER (model_key='m_F') AS lt, avg(tokens) FILTER (model_key='m_O') AS rt FROM attempts GROUP BY ALL)
SELECT 'correct' AS metric, R(regr_slope(rc, level) - regr_slope(lc, level)) AS difference, count(*) AS pairs FROM p WHERE lc IS NOT NULL AND rc IS NOT NULL
UNION ALL
SELECT 'tokens', R(regr_slope(rt, level) - regr_slope(lt, level)), count(*) FROM p WHERE lt IS NOT NULL AND rt IS NOT NULL""")
def _(spark, sf):
    return A.level_slope_difference(X.attempts(spark, sf), ["correct", "tokens"], "m_F", "m_O")


@query("a09_condition_summary", """
SELECT dataset, model_key, count(*) AS rows, count(DISTINCT problem_id) AS problems, R(avg(correct::int)) AS mean_correct, R(avg(tokens)) AS mean_tokens
FROM attempts GROUP BY GROUPING SETS ((), (dataset), (dataset, model_key))""")
def _(spark, sf):
    return A.condition_summary(X.attempts(spark, sf), [[], ["dataset"], ["dataset", "model_key"]], ["correct", "tokens"])


@query("a10_paired_conditions", """
WITH w AS (SELECT problem_id, mseed, max(correct::int) FILTER (model_key='m_F') AS l, max(correct::int) FILTER (model_key='m_O') AS r FROM seeded GROUP BY ALL)
SELECT count(*) AS pairs, R(avg(l)) AS left_mean, R(avg(r)) AS right_mean, R(avg(r - l)) AS mean_difference FROM w WHERE l IS NOT NULL AND r IS NOT NULL""")
def _(spark, sf):
    pairs = A.paired_conditions(X.seeded(spark, sf, mseed=True), ["problem_id", "mseed"], "model_key", "m_F", "m_O", "correct")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg("left_value").alias("left_mean"),
                     F.avg("right_value").alias("right_mean"), F.avg("difference").alias("mean_difference"))


@query("e01_auroc", f"WITH {LOO}, m AS ({auroc_sql('loo', 'loo_rate', 'correct')}) SELECT R(auroc) AS auroc, positives, negatives FROM m")
def _(spark, sf):
    return D.auroc(A.loo_pass_rate(X.attempts(spark, sf)), "loo_rate", "correct")


@query("b04_difficulty_ceiling", f"""
WITH {LOO}, m AS ({auroc_sql('loo', 'loo_rate', 'correct')}), o AS ({auroc_sql('loo', 'problem_rate', 'correct')}),
  {picks_sql('SELECT DISTINCT problem_id FROM loo')},
  hist AS (SELECT problem_id, loo_rate, sum(correct::int) AS pos, sum(1-correct::int) AS neg FROM loo GROUP BY ALL),
  d AS (SELECT draw, loo_rate, sum(pos) AS pos, sum(neg) AS neg FROM picks JOIN hist USING (problem_id) GROUP BY ALL),
  v AS (SELECT draw, CASE WHEN sum(pos)*sum(neg) > 0 THEN sum(pos*(below - neg/2.0))/(sum(pos)::double*sum(neg)) END AS value FROM
    (SELECT *, sum(neg) OVER (PARTITION BY draw ORDER BY loo_rate) AS below FROM d) GROUP BY draw)
SELECT (SELECT count(DISTINCT problem_id) FROM loo) AS problems, (SELECT count(*) FROM loo) AS attempts,
  R((SELECT avg(correct::int) FROM loo)) AS base_rate, R((SELECT auroc FROM m)) AS auroc_loo, R((SELECT auroc FROM o)) AS auroc_upper,
  R(quantile_cont(value, 0.025)) AS ci_low, R(quantile_cont(value, 0.975)) AS ci_high,
  count(value) AS used_draws, count(*) FILTER (value IS NULL) AS skipped_draws FROM v""")
def _(spark, sf):
    return jobs.difficulty_ceiling(X.attempts(spark, sf))
