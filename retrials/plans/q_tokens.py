"""Queries over the token and vector views."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.operators import paths as V
from retrials.operators import resampling as B
from retrials.operators import sampling as M
from retrials.operators import signals as S
from retrials.operators.discrimination import auroc
from retrials.operators.text import surface_counts
from retrials.plans import fixtures as X
from retrials.plans.registry import query

P = X.PREFIXES


def scoped(spark, sf, steps=False):
    return materialize(S.analysis_window(materialize(X.tokens(spark, sf, steps))))


def cut(spark, sf, steps=False):
    return S.prefix_rows(scoped(spark, sf, steps), P)


def runs(spark, sf):
    return scoped(spark, sf).groupBy("run_id", "problem_id", "model_key", "level", "correct").agg(F.max("n").alias("n"))


RUNS = "runs AS (SELECT run_id, problem_id, model_key, level, correct, max(n) AS n FROM scoped GROUP BY ALL)"
SER = """ser AS (SELECT run_id, prefix_length, {s} AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id, prefix_length) AS m
  FROM cut WHERE {s} IS NOT NULL WINDOW w AS (PARTITION BY run_id, prefix_length ORDER BY rn)),
  lagged AS (SELECT *, v - lag(v) OVER w AS d, lag(v) OVER w AS l1, lag(v, 4) OVER w AS l4 FROM ser WINDOW w AS (PARTITION BY run_id, prefix_length ORDER BY i))"""


@query("p01_analysis_window", "SELECT run_id, token_index, rn, n FROM scoped")
def _(spark, sf):
    return scoped(spark, sf).select("run_id", "token_index", "rn", "n")


@query("p02_prefix_rows", "SELECT prefix_length, count(*) AS rows, count(DISTINCT run_id) AS runs, R(avg(s1)) AS mean_s1 FROM cut GROUP BY 1")
def _(spark, sf):
    return cut(spark, sf).groupBy("prefix_length").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("run_id").alias("runs"), F.avg("s1").alias("mean_s1"))


@query("p03_fixed_cohort", "SELECT prefix_length, count(DISTINCT run_id) AS runs, R(avg(s1)) AS mean_s1 FROM cut WHERE n >= 64 GROUP BY 1")
def _(spark, sf):
    rows = S.prefix_rows(S.survivors(scoped(spark, sf), 64), P)
    return rows.groupBy("prefix_length").agg(F.countDistinct("run_id").alias("runs"), F.avg("s1").alias("mean_s1"))


@query("p06_relative_prefixes", """
SELECT run_id, n, I(k) AS k, I(least(n, greatest(16, round_even(n*k/8, 0)))) AS prefix_tokens
FROM (SELECT DISTINCT run_id, n FROM scoped WHERE n >= 32), (SELECT unnest(range(1, 9)) AS k)""")
def _(spark, sf):
    return S.relative_prefixes(scoped(spark, sf), 8, 16, 32)


@query("p07_generated_prefix", """
SELECT run_id, token_index AS cutoff, token_index + 1 AS prefix_tokens FROM scoped WHERE rn = 32""")
def _(spark, sf):
    t = materialize(X.tokens(spark, sf))
    return S.generated_prefix(t, S.analysis_window(t), 32)


@query("q01_distribution_summary", f"""WITH {SER.format(s='s1')}
SELECT run_id, prefix_length, count(v) AS finite, R(avg(v)) AS mean, R(stddev_pop(v)) AS std, R(min(v)) AS min, R(max(v)) AS max, R(quantile_cont(v, 0.1)) AS p10,
  R(quantile_cont(v, 0.25)) AS p25, R(quantile_cont(v, 0.5)) AS median, R(quantile_cont(v, 0.75)) AS p75, R(quantile_cont(v, 0.9)) AS p90 FROM ser GROUP BY ALL""")
def _(spark, sf):
    s = S.scalar_summary(cut(spark, sf), "s1")
    return s.select("run_id", "prefix_length", "finite", "mean", "std", "min", "max", "p10", "p25", "median", "p75", "p90")


@query("q02_edge_means", f"""WITH {SER.format(s='s3')}
SELECT run_id, prefix_length, R(avg(v) FILTER (i < greatest(1, least(64, m//4)))) AS initial_mean, R(avg(v) FILTER (i >= m - greatest(1, least(64, m//4)))) AS final_mean FROM ser GROUP BY ALL""")
def _(spark, sf):
    return S.scalar_summary(cut(spark, sf, True), "s3").select("run_id", "prefix_length", "initial_mean", "final_mean")


@query("q03_slope", f"WITH {SER.format(s='s2')} SELECT run_id, prefix_length, R(regr_slope(v, i)) AS slope FROM ser GROUP BY ALL")
def _(spark, sf):
    return S.scalar_summary(cut(spark, sf), "s2").select("run_id", "prefix_length", "slope")


@query("q04_theil_sen", f"""WITH {SER.format(s='s1')}
SELECT a.run_id, a.prefix_length, R(quantile_cont((b.v - a.v)/(b.i - a.i), 0.5)) AS robust_slope FROM ser a JOIN ser b
ON a.run_id = b.run_id AND a.prefix_length = b.prefix_length AND a.i < b.i GROUP BY ALL""")
def _(spark, sf):
    return S.theil_sen(cut(spark, sf), "s1")


@query("q05_extreme_steps", f"WITH {SER.format(s='s1')} SELECT run_id, prefix_length, R(max(d)) AS max_rise, R(min(d)) AS max_fall FROM lagged GROUP BY ALL")
def _(spark, sf):
    return S.scalar_summary(cut(spark, sf), "s1").select("run_id", "prefix_length", "max_rise", "max_fall")


@query("q06_autocorrelation", f"""WITH {SER.format(s='s2')}
SELECT run_id, prefix_length, R(CASE WHEN stddev_pop(CASE WHEN l1 IS NOT NULL THEN v END) >= 1e-12 AND stddev_pop(l1) >= 1e-12 THEN corr(v, l1) END) AS autocorr_lag1,
  R(CASE WHEN stddev_pop(CASE WHEN l4 IS NOT NULL THEN v END) >= 1e-12 AND stddev_pop(l4) >= 1e-12 THEN corr(v, l4) END) AS autocorr_lag4 FROM lagged GROUP BY ALL""")
def _(spark, sf):
    return S.scalar_summary(cut(spark, sf), "s2").select("run_id", "prefix_length", "autocorr_lag1", "autocorr_lag4")


@query("q07_spectrum", """
WITH f AS (SELECT run_id, s1 AS v, row_number() OVER (PARTITION BY run_id ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS m FROM scoped WHERE s1 IS NOT NULL),
 c AS (SELECT run_id, m, median(v) AS mid FROM f WHERE m >= 63 GROUP BY ALL),
 d AS (SELECT f.run_id, median(abs(v - mid)) AS mad FROM f JOIN c USING (run_id) GROUP BY ALL),
 g AS (SELECT unnest(range(256)) AS j),
 x AS (SELECT run_id, m, mid, mad, j, floor(j*(m-1)/255.0) AS k, j*(m-1)/255.0 - floor(j*(m-1)/255.0) AS fr FROM c JOIN d USING (run_id), g),
 y AS (SELECT x.run_id, j, ((a.v + fr*(coalesce(b.v, a.v) - a.v)) - mid)/mad * (0.5 - 0.5*cos(2*pi()*j/255)) AS y FROM x
   JOIN f a ON a.run_id = x.run_id AND a.i = k LEFT JOIN f b ON b.run_id = x.run_id AND b.i = k + 1 WHERE mad >= 1e-12),
 pw AS (SELECT run_id, q, q/256.0 AS fq, power(sum(y*cos(2*pi()*j*q/256)), 2) + power(sum(y*sin(2*pi()*j*q/256)), 2) AS p FROM y, (SELECT unnest(range(1, 129)) AS q) GROUP BY run_id, q),
 t AS (SELECT *, p/sum(p) OVER (PARTITION BY run_id) AS s, sum(fq*p) OVER (PARTITION BY run_id)/sum(p) OVER (PARTITION BY run_id) AS ce FROM pw),
 o AS (SELECT run_id, coalesce(sum(s) FILTER (fq <= 0.10), 0) AS lo, coalesce(sum(s) FILTER (fq > 0.10 AND fq <= 0.25), 0) AS mi, coalesce(sum(s) FILTER (fq > 0.25), 0) AS hi,
   arg_max(fq, p) AS dom, max(ce) AS ce, sqrt(sum((fq-ce)*(fq-ce)*s)) AS bw, -sum(s*ln(s)) FILTER (s > 0)/ln(129) AS en, exp(avg(ln(p + 1e-20)))/(avg(p) + 1e-20) AS fl FROM t GROUP BY 1)
SELECT r.run_id, R(lo) AS low_energy_ratio, R(mi) AS mid_energy_ratio, R(hi) AS high_energy_ratio, R(dom) AS dominant_frequency, R(ce) AS centroid, R(bw) AS bandwidth,
  R(en) AS entropy, R(fl) AS flatness FROM (SELECT DISTINCT run_id FROM scoped) r LEFT JOIN o USING (run_id)""")
def _(spark, sf):
    return S.spectrum(scoped(spark, sf), "s1")


@query("q08_step_geometry", """
SELECT run_id, prefix_length, R(sum(s3)) AS path_length, R(sqrt(sum(s3*s3))) AS net_proxy, R(avg(s3)) AS mean_velocity, R(var_pop(s3)) AS velocity_variance,
  R(avg(s2)) AS mean_drift, R(max(s2)) AS max_drift, R(var_pop(s2)) AS drift_variance, R(CASE WHEN sum(s3) > 0 THEN sqrt(sum(s3*s3))/sum(s3) END) AS efficiency FROM cut GROUP BY ALL""")
def _(spark, sf):
    return S.step_geometry(cut(spark, sf, True), "s3", "s2")


@query("q12_feature_table")
def _(spark, sf):
    t = materialize(X.tokens(spark, sf, True))
    ended = F.when(F.col("run_id") % 4 == 0, "max_new_tokens").otherwise("eos").alias("finish_reason")
    meta = t.select("run_id", "problem_id", "model_key", "level", "correct", ended).distinct()
    docs = X.table(spark, sf, "documents")
    surface = surface_counts(docs.select(F.col("doc_id").alias("problem_id"), "text"), "text").drop("text")
    return S.feature_table(t, meta, surface, P, ["s1", "s2", "s3"], ["s1"], "s3", "s2", X.vectors(spark, sf), "finish_reason")


@query("q12_prefix_geometry", f"""
WITH pf AS (SELECT unnest({[*P]}) AS p UNION ALL SELECT NULL),
 j AS (SELECT v.run_id, s.rn, s.n, list_transform(vec, lambda x: cast(x AS double)) AS w FROM vectors v JOIN scoped s ON s.run_id = v.run_id AND s.token_index = v.token_index),
 k AS (SELECT *, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2 FROM j WINDOW o AS (PARTITION BY run_id ORDER BY rn)),
 e AS (SELECT run_id, rn, n, unnest(w) AS w, unnest(p1) AS p, unnest(p2) AS pp FROM k),
 s AS (SELECT run_id, rn, n, sqrt(sum(p*p)) AS np, sqrt(sum((w-p)*(w-p))) AS nd, sqrt(sum((p-pp)*(p-pp))) AS na, sum((p-pp)*(w-p)) AS ab FROM e GROUP BY ALL),
 f AS (SELECT s.*, pf.p AS prefix_length, CASE WHEN ab IS NOT NULL THEN acos(greatest(-1, least(1, ab/greatest(na*nd, 1e-12)))) END AS angle FROM s JOIN pf ON pf.p IS NULL OR (rn <= pf.p AND pf.p <= n)),
 g AS (SELECT run_id, prefix_length, count(*) AS states, sum(nd/greatest(np, 1e-12)) AS pl, avg(angle) AS am, var_pop(angle) AS av, min(rn) AS a, max(rn) AS b FROM f GROUP BY ALL),
 z AS (SELECT g.run_id, g.prefix_length, unnest(ka.w) AS f, unnest(kb.w) AS l FROM g JOIN k ka ON ka.run_id = g.run_id AND ka.rn = a JOIN k kb ON kb.run_id = g.run_id AND kb.rn = b),
 nt AS (SELECT run_id, prefix_length, sqrt(sum((l-f)*(l-f)))/greatest(sqrt(sum(f*f)), 1e-12) AS net FROM z GROUP BY ALL)
SELECT g.run_id, I(g.prefix_length) AS prefix_length, states, R(CASE WHEN states >= 2 THEN net END) AS normalized_net_displacement, R(pl) AS sparse_path_length,
 R(CASE WHEN pl > 0 THEN net/pl END) AS trajectory_efficiency, R(am) AS turning_angle_mean, R(av) AS turning_angle_variance
FROM g JOIN nt ON nt.run_id = g.run_id AND nt.prefix_length IS NOT DISTINCT FROM g.prefix_length""")
def _(spark, sf):
    return V.prefix_geometry(X.vectors(spark, sf), scoped(spark, sf), P)


@query("q13_stream_summary", """
WITH o AS (SELECT run_id, prefix_length, count(s1) c1, count(s3) c3, avg(s1) AS a1, stddev_pop(s1) AS b1, avg(s2) AS a2, avg(s3) AS a3, stddev_pop(s3) AS b3 FROM cut GROUP BY ALL),
 """ + SER.format(s='s1').replace("ser AS", "e1 AS").replace("lagged AS", "g1 AS").replace("FROM ser", "FROM e1") + ", "
      + SER.format(s='s2').replace("ser AS", "e2 AS").replace("lagged AS", "g2 AS").replace("FROM ser", "FROM e2") + ", "
      + SER.format(s='s3').replace("ser AS", "e3 AS").replace("lagged AS", "g3 AS").replace("FROM ser", "FROM e3") + """,
 sl1 AS (SELECT run_id, prefix_length, regr_slope(v, i) AS v FROM e1 GROUP BY ALL), sl3 AS (SELECT run_id, prefix_length, regr_slope(v, i) AS v FROM e3 GROUP BY ALL),
 mr AS (SELECT run_id, prefix_length, max(d) AS v FROM g2 GROUP BY ALL)
SELECT run_id, prefix_length, R(a1) AS s1_mean, R(b1) AS s1_std, R(CASE WHEN c1 < 3 THEN 0 ELSE sl1.v END) AS s1_slope, R(a2) AS s2_mean, R(coalesce(mr.v, 0)) AS s2_max_rise,
  R(a3) AS s3_mean, R(b3) AS s3_std, R(CASE WHEN c3 < 3 THEN 0 ELSE sl3.v END) AS s3_slope
FROM o JOIN sl1 USING (run_id, prefix_length) JOIN mr USING (run_id, prefix_length) LEFT JOIN sl3 USING (run_id, prefix_length)""")
def _(spark, sf):
    return S.stream_summary(materialize(cut(spark, sf, True)), "s1", "s2", "s3")


BINS = """bins AS (SELECT run_id, problem_id, model_key, level, correct, least((rn-1)*10//n, 9) AS time_bin, avg(s1) AS s1, avg(s2) AS s2 FROM scoped GROUP BY ALL)"""
IDS = ["run_id", "problem_id", "model_key", "level", "correct"]


@query("q14_time_bins", f"WITH {BINS} SELECT run_id, time_bin, R(s1) AS s1, R(s2) AS s2 FROM bins")
def _(spark, sf):
    return S.time_bins(scoped(spark, sf), ["s1", "s2"], 10, IDS).select("run_id", "time_bin", "s1", "s2")


@query("a38_binned_dynamics", f"""WITH {BINS}, p AS (SELECT model_key, level, correct, time_bin, problem_id, avg(s1) AS s1, avg(s2) AS s2 FROM bins GROUP BY ALL)
SELECT model_key, level, correct, time_bin, signal, R(avg(value)) AS mean, count(value) AS problems FROM (UNPIVOT p ON s1, s2 INTO NAME signal VALUE value) GROUP BY ALL""")
def _(spark, sf):
    return S.binned_summary(S.time_bins(scoped(spark, sf), ["s1", "s2"], 10, IDS), ["s1", "s2"])


@query("q15_largest_rise", """
WITH d AS (SELECT run_id, rn, n, s1, s1 - lag(s1) OVER (PARTITION BY run_id ORDER BY rn) AS d FROM scoped),
 m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY d DESC, rn) AS k FROM d WHERE d IS NOT NULL), l AS (SELECT run_id, arg_max(s1, rn) AS f FROM scoped GROUP BY 1)
SELECT run_id, R(d) AS maximum_rise, R(rn/n) AS relative_position, R(s1) AS value_after, R(f) AS final_value, f < s1 AS recovered FROM m JOIN l USING (run_id) WHERE k = 1""")
def _(spark, sf):
    return S.largest_rise(scoped(spark, sf), "s1")


Z = """obs AS (SELECT run_id, problem_id, model_key, correct, prefix_length, n AS full_length, avg(s1) AS s1, avg(s2) AS s2 FROM cut GROUP BY ALL),
 lg AS (SELECT * FROM (UNPIVOT obs ON s1, s2 INTO NAME feature VALUE value)),
 ch AS (SELECT 'at_risk' AS cohort, * FROM lg UNION ALL SELECT 'fixed', * FROM lg WHERE full_length >= 64),
 st AS (SELECT cohort, model_key, feature, prefix_length, avg(value) AS mu, stddev_samp(value) AS sd FROM ch GROUP BY ALL),
 b AS (SELECT cohort, model_key, feature, arg_min(mu, prefix_length) AS mu, arg_min(sd, prefix_length) AS sd FROM st GROUP BY ALL),
 z AS (SELECT ch.*, (value - mu)/nullif(sd, 0) AS z FROM ch JOIN b USING (cohort, model_key, feature))"""


def z_table(spark, sf):
    c = cut(spark, sf)
    obs = c.groupBy("run_id", "problem_id", "model_key", "correct", "prefix_length", F.col("n").alias("full_length")).agg(F.avg("s1").alias("s1"), F.avg("s2").alias("s2"))
    return S.standardised_from_first(obs, ["s1", "s2"], ["run_id", "problem_id", "model_key", "correct"], 64)


@query("q18_standardised_long", f"WITH {Z} SELECT run_id, cohort, feature, prefix_length, R(value) AS value, R(z) AS z FROM z")
def _(spark, sf):
    return z_table(spark, sf).select("run_id", "cohort", "feature", "prefix_length", "value", "z")


@query("a33_correctness_separation", f"""WITH {Z} SELECT cohort, model_key, prefix_length, feature, R(avg(z) FILTER (NOT correct) - avg(z) FILTER (correct)) AS difference, count(z) AS runs FROM z GROUP BY ALL""")
def _(spark, sf):
    return S.separation(z_table(spark, sf))


@query("b10_two_sample_interval", f"""WITH {Z}, s AS (SELECT correct::int AS side, problem_id, sum(z) AS t, count(z) AS n FROM z WHERE cohort = 'fixed' AND feature = 's1' AND prefix_length = 32 AND z IS NOT NULL GROUP BY ALL),
 x AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY H('c:'||problem_id), problem_id) AS slot, count(*) OVER (PARTITION BY side) AS slots FROM s),
 k AS (SELECT side, draw, H('b:'||side||':'||draw||':'||slot) % slots + 1 AS slot FROM x, (SELECT unnest(range(2000)) AS draw)),
 r AS (SELECT side, draw, sum(t)/sum(n) AS v FROM k JOIN x USING (side, slot) GROUP BY ALL),
 v AS (SELECT draw, max(v) FILTER (side = 0) - max(v) FILTER (side = 1) AS v FROM r GROUP BY 1)
SELECT R((SELECT sum(t) FILTER (side=0)/sum(n) FILTER (side=0) - sum(t) FILTER (side=1)/sum(n) FILTER (side=1) FROM s)) AS difference,
 R(quantile_cont(v, 0.025)) AS ci_low, R(quantile_cont(v, 0.975)) AS ci_high, count(v) AS used_draws, count(*) FILTER (v IS NULL) AS skipped_draws FROM v""")
def _(spark, sf):
    z = z_table(spark, sf).where("cohort = 'fixed' and feature = 's1' and prefix_length = 32")
    return B.two_sample_interval(z, "z", "correct")


@query("a32_prefix_signal_by_outcome", """
WITH p AS (SELECT run_id, model_key, level, correct, prefix_length, avg(s1) AS v FROM cut GROUP BY ALL)
SELECT model_key, level, correct, prefix_length, count(*) AS runs, R(avg(v)) AS mean FROM p GROUP BY GROUPING SETS ((model_key, correct, prefix_length), (model_key, level, correct, prefix_length))""")
def _(spark, sf):
    return S.prefix_signal_by_outcome(cut(spark, sf), "s1")


@query("a37_coverage_and_savings", f"""WITH {RUNS}
SELECT I(p) AS prefix_length, count(*) AS trajectories, count(DISTINCT problem_id) AS problems, R(avg(greatest(n-p, 0))) AS mean_remaining, R(sum(greatest(n-p, 0))/sum(n)) AS savings_fraction,
 R(count(*)/(SELECT count(*) FROM runs)) AS coverage FROM runs, prefixes WHERE n >= p GROUP BY 1""")
def _(spark, sf):
    return S.coverage(runs(spark, sf), P)


@query("l14_success_panel", f"WITH {RUNS} SELECT run_id, I(p) AS forecast_token, correct, R(ln(1+p)) AS time_log1p FROM runs, prefixes WHERE n >= p")
def _(spark, sf):
    return S.success_panel(runs(spark, sf), P).select("run_id", "forecast_token", "correct", "time_log1p")


@query("l15_future_length_label", f"WITH {RUNS} SELECT run_id, I(p) AS forecast_token, (n >= 64)::int::bigint AS long_run FROM runs, prefixes WHERE n >= p")
def _(spark, sf):
    return S.future_length_label(S.success_panel(runs(spark, sf), P), 64).select("run_id", "forecast_token", "long_run")


# ---- vectors
D64 = "list_transform(vec, lambda x: cast(x AS double))"
VEC = f"""v AS (SELECT *, {D64} AS w, lag({D64}) OVER (PARTITION BY run_id ORDER BY token_index) AS p, lag({D64}, 2) OVER (PARTITION BY run_id ORDER BY token_index) AS pp FROM vectors),
 e AS (SELECT run_id, token_index, vec_id, unnest(w) AS w, unnest(p) AS p, unnest(pp) AS pp FROM v),
 s AS (SELECT run_id, token_index, vec_id, sqrt(sum(w*w)) AS nw, sqrt(sum(p*p)) AS np, sqrt(sum((w-p)*(w-p))) AS nd, sum(w*p) AS wp,
   sqrt(sum((p-pp)*(p-pp))) AS na, sum((p-pp)*(w-p)) AS ab FROM e GROUP BY ALL)"""


@query("s08_states_left_join", """
WITH r AS (SELECT DISTINCT run_id FROM vectors UNION SELECT 1000 + label FROM embeddings)
SELECT r.run_id, count(vec_id) AS states, max(len(vec)) AS dimension FROM r LEFT JOIN vectors USING (run_id) GROUP BY 1""")
def _(spark, sf):
    from retrials.sources.attempts import states_of
    v = X.vectors(spark, sf)
    want = v.select("run_id").union(X.table(spark, sf, "embeddings").select((F.col("label") + 1000).cast("long"))).distinct()
    return states_of(want, v).groupBy("run_id").agg(F.count("vec_id").alias("states"), F.max(F.when(F.col("vec").isNotNull(), F.size("vec"))).alias("dimension"))


@query("q09_path_geometry", f"""WITH {VEC}, fl AS (SELECT run_id, arg_min({D64}, token_index) AS f, arg_max({D64}, token_index) AS l FROM vectors GROUP BY 1),
 u AS (SELECT run_id, unnest(f) AS f, unnest(l) AS l FROM fl), nt AS (SELECT run_id, sqrt(sum((l-f)*(l-f)))/greatest(sqrt(sum(f*f)), 1e-12) AS net FROM u GROUP BY 1),
 g AS (SELECT run_id, count(*) AS states, sum(nd/greatest(np, 1e-12)) AS pl, avg(CASE WHEN ab IS NOT NULL THEN acos(greatest(-1, least(1, ab/greatest(na*nd, 1e-12)))) END) AS am, var_pop(CASE WHEN ab IS NOT NULL THEN acos(greatest(-1, least(1, ab/greatest(na*nd, 1e-12)))) END) AS av FROM s GROUP BY 1)
SELECT run_id, states, R(pl) AS sparse_path_length, R(CASE WHEN states >= 2 THEN net END) AS net_displacement, R(am) AS turning_angle_mean, R(av) AS turning_angle_variance,
 R(CASE WHEN pl > 0 THEN net/pl END) AS trajectory_efficiency FROM g JOIN nt USING (run_id)""", )
def _(spark, sf):
    return V.path_geometry(materialize(X.vectors(spark, sf)))


@query("q10_step_signals", f"""WITH {VEC} SELECT vec_id, R(nw) AS hidden_norm, R(nd/greatest(np, 1e-12)) AS relative_step,
 R(CASE WHEN wp IS NOT NULL THEN 1 - greatest(-1, least(1, wp/(greatest(nw, 1e-12)*greatest(np, 1e-12)))) END) AS cosine_drift FROM s""")
def _(spark, sf):
    return V.step_signals(materialize(X.vectors(spark, sf))).select("vec_id", "hidden_norm", "relative_step", "cosine_drift")


@query("q11_anchor_pooled", f"""WITH n AS (SELECT run_id, count(*) AS n FROM vectors GROUP BY 1),
 e AS (SELECT run_id, a AS anchor, unnest({D64}) AS x, unnest(range(len(vec))) AS e FROM vectors JOIN n USING (run_id), (SELECT unnest([4, 8, 16]) AS a) WHERE token_index < a AND token_index >= a - 4 AND n >= a)
SELECT run_id, I(anchor) AS anchor, I(e) AS element, R(avg(x)) AS value FROM e GROUP BY ALL""")
def _(spark, sf):
    pooled = V.anchor_pooled(materialize(X.vectors(spark, sf)), (4, 8, 16))
    return pooled.select("run_id", "anchor", F.posexplode("mean_vec").alias("element", "value"))


def path2(spark, sf):
    return materialize(X.vectors(spark, sf)).select("run_id", "token_index", (F.col("run_id") * 7 % 3 == 0).alias("correct"), F.get("vec", F.lit(0)).cast("double").alias("x"), F.get("vec", F.lit(1)).cast("double").alias("y"))


MARKS = """pt AS (SELECT run_id, token_index AS t, run_id*7%3 = 0 AS correct, cast(vec[1] AS double) AS x, cast(vec[2] AS double) AS y, lead(token_index) OVER w AS t1, lead(cast(vec[1] AS double)) OVER w AS x1,
   lead(cast(vec[2] AS double)) OVER w AS y1, max(token_index) OVER (PARTITION BY run_id) AS b FROM vectors WINDOW w AS (PARTITION BY run_id ORDER BY token_index)),
 mk AS (SELECT run_id, correct, I(k) AS landmark, CASE WHEN t1 IS NULL THEN x ELSE x + (k/4.0*greatest(b,1) - t)*(x1 - x) END AS x, CASE WHEN t1 IS NULL THEN y ELSE y + (k/4.0*greatest(b,1) - t)*(y1 - y) END AS y
   FROM pt, (SELECT unnest(range(5)) AS k) WHERE CASE WHEN t1 IS NULL THEN b = 0 OR k/4.0*greatest(b,1) >= t ELSE k/4.0*greatest(b,1) >= t AND k/4.0*greatest(b,1) < t1 END)"""


@query("q16_landmark_paths", f"WITH {MARKS} SELECT run_id, correct, landmark, R(x) AS x, R(y) AS y FROM mk")
def _(spark, sf):
    return V.at_landmarks(path2(spark, sf), 5)


@query("q17_path_kinematics", f"""WITH {MARKS}, st AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS s FROM mk WINDOW w AS (PARTITION BY run_id ORDER BY landmark)),
 kn AS (SELECT correct, landmark, sqrt(power(x-x0, 2) + power(y-y0, 2)) AS displacement, sum(s) OVER (PARTITION BY run_id ORDER BY landmark) AS cumulative FROM st)
SELECT correct, landmark, measure, R(quantile_cont(value, 0.5)) AS median, R(quantile_cont(value, 0.25)) AS q25, R(quantile_cont(value, 0.75)) AS q75
FROM (UNPIVOT kn ON displacement, cumulative INTO NAME measure VALUE value) GROUP BY ALL""")
def _(spark, sf):
    return V.kinematic_bands(V.kinematics(V.at_landmarks(path2(spark, sf), 5)), ["correct"])


@query("k14_problem_centred", f"""WITH e AS (SELECT vec_id, problem_id, unnest({D64}) AS x, unnest(range(len(vec))) AS e FROM vectors)
SELECT vec_id, I(e) AS element, R(x - avg(x) OVER (PARTITION BY problem_id, e)) AS value FROM e""")
def _(spark, sf):
    return V.centred(X.vectors(spark, sf)).select("vec_id", F.posexplode("centred").alias("element", "value"))


@query("m12_fair_state_quota", """
WITH r AS (SELECT run_id, vec_id, row_number() OVER (PARTITION BY run_id ORDER BY H('quota:'||vec_id), vec_id) AS r FROM vectors), n AS (SELECT count(DISTINCT run_id) AS n FROM vectors)
SELECT run_id, vec_id, I((r-1)//greatest(200//n, 1)) AS pass_number FROM r, n ORDER BY pass_number, run_id, H('quota:'||vec_id) LIMIT 200""")
def _(spark, sf):
    return M.fair_quota(materialize(X.vectors(spark, sf)), "quota", 200).select("run_id", "vec_id", "pass_number")


@query("e10_cross_anchor_consistency", """
WITH a AS (SELECT problem_id, correct, vec[1] AS s1, vec[2] AS s2, vec_id FROM vectors),
 f AS (SELECT problem_id, 1 AS k, sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)/count(*) AS auroc FROM (SELECT problem_id, s1 AS s FROM a WHERE correct) p JOIN (SELECT problem_id, s1 AS s FROM a WHERE NOT correct) n USING (problem_id) GROUP BY 1),
 g AS (SELECT problem_id, sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)/count(*) AS auroc FROM (SELECT problem_id, s2 AS s FROM a WHERE correct) p JOIN (SELECT problem_id, s2 AS s FROM a WHERE NOT correct) n USING (problem_id) GROUP BY 1),
 r AS (SELECT rank() OVER (ORDER BY f.auroc) + (count(*) OVER (PARTITION BY f.auroc) - 1)/2.0 AS x, rank() OVER (ORDER BY g.auroc) + (count(*) OVER (PARTITION BY g.auroc) - 1)/2.0 AS y FROM f JOIN g USING (problem_id))
SELECT R(corr(x, y)) AS rho, count(*) AS n FROM r""")
def _(spark, sf):
    from retrials.operators.discrimination import spearman, within_problem
    v = materialize(X.vectors(spark, sf)).select("problem_id", "correct", F.get("vec", F.lit(0)).alias("s1"), F.get("vec", F.lit(1)).alias("s2"))
    a = within_problem(v, "s1", "correct").select("problem_id", F.col("auroc").alias("a"))
    b = within_problem(v, "s2", "correct").select("problem_id", F.col("auroc").alias("b"))
    return spearman(a.join(b, "problem_id"), "a", "b")
