"""Queries over predictions: calibration, paired metric differences, ECDF index, blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.operators import discrimination as D
from retrials.operators import joins as J
from retrials.operators import policies as P
from retrials.operators import resampling as B
from retrials.operators import sampling as M
from retrials.operators.text import surface_counts
from retrials.plans import fixtures as X
from retrials.plans.q_attempts import auroc_sql, picks_sql
from retrials.plans.registry import query


def pred(spark, sf):
    return materialize(X.predictions(spark, sf).drop("text"))


AP = """SELECT {k} sum(pos*tp/seen)/nullif(sum(pos), 0) AS ap FROM (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS seen FROM {src} WINDOW w AS (PARTITION BY {p} ORDER BY {s} DESC)) {g}"""
BIN = "(" + " + ".join(f"({{p}} >= {k * 0.1!r}e0)::int" for k in range(1, 10)) + ")"


@query("e02_average_precision", "WITH h AS (SELECT p3, sum(y) AS pos, sum(1-y) AS neg FROM predictions GROUP BY 1), a AS (" + AP.format(k="", src="h", p="1", s="p3", g="") + ") SELECT R(ap) AS average_precision FROM a")
def _(spark, sf):
    return D.average_precision(pred(spark, sf), "p3", "y")


@query("e03_proper_scores", """SELECT model_key, count(*) AS n, R(avg((p2-y)*(p2-y))) AS brier, R(avg(-(y*ln(least(greatest(p2, 1e-7), 1-1e-7)) + (1-y)*ln(1-least(greatest(p2, 1e-7), 1-1e-7))))) AS log_loss FROM predictions GROUP BY 1""")
def _(spark, sf):
    return D.proper_scores(pred(spark, sf), "p2", "y", ["model_key"])


@query("e04_calibration_error", f"WITH b AS (SELECT model_key, {BIN.format(p='p2')} AS bin, count(*) AS n, avg(p2) AS f, avg(y) AS o FROM predictions GROUP BY ALL) SELECT model_key, R(sum(n*abs(f-o))/sum(n)) AS ece FROM b GROUP BY 1")
def _(spark, sf):
    return D.calibration_error(pred(spark, sf), "p2", "y", 10, ["model_key"])


@query("e05_reliability_curve", f"SELECT I({BIN.format(p='p1')}) AS bin, count(*) AS n, R(avg(p1)) AS mean_forecast, R(avg(y)) AS observed_rate FROM predictions GROUP BY 1")
def _(spark, sf):
    return D.reliability(pred(spark, sf), "p1", "y")


@query("e06_risk_coverage", "SELECT run_id, row_number() OVER w AS rank, R(row_number() OVER w/(SELECT count(*) FROM predictions)) AS coverage, R(1 - sum(y) OVER (ORDER BY p3 DESC, run_id)/row_number() OVER w) AS risk FROM predictions WINDOW w AS (ORDER BY p3 DESC, run_id)")
def _(spark, sf):
    return D.risk_coverage(pred(spark, sf), "p3", "y", "run_id")


def metric_ctes(score: str, name: str) -> str:
    """Per-draw AUROC, average precision and ECE of one score on the shared picks."""
    return f"""h{name} AS (SELECT problem_id, {score} AS s, sum(y) AS pos, sum(1-y) AS neg FROM predictions GROUP BY ALL),
  d{name} AS (SELECT draw, s, sum(pos) AS pos, sum(neg) AS neg FROM picks JOIN h{name} USING (problem_id) GROUP BY ALL),
  u{name} AS (SELECT draw, CASE WHEN sum(pos)*sum(neg) > 0 THEN sum(pos*(b - neg/2.0))/(sum(pos)*sum(neg)) END AS v FROM (SELECT *, sum(neg) OVER (PARTITION BY draw ORDER BY s) AS b FROM d{name}) GROUP BY 1),
  a{name} AS ({AP.format(k='draw,', src='d' + name, p='draw', s='s', g='GROUP BY draw')}),
  e{name} AS (SELECT draw, sum(abs(sp - sy))/sum(n) AS v FROM (SELECT draw, bin, sum(sp) AS sp, sum(sy) AS sy, sum(n) AS n FROM picks JOIN (SELECT problem_id, {BIN.format(p=score)} AS bin, sum({score}) AS sp, sum(y) AS sy, count(*) AS n FROM predictions GROUP BY ALL) USING (problem_id) GROUP BY ALL) GROUP BY 1)"""


PICKS = picks_sql("SELECT DISTINCT problem_id FROM predictions")
CIV = "R(quantile_cont(v, 0.025)) AS ci_low, R(quantile_cont(v, 0.975)) AS ci_high, count(v) AS used_draws, count(*) FILTER (v IS NULL) AS skipped_draws"


@query("b04_metric_intervals", f"""WITH {PICKS}, {metric_ctes('p3', 'x')} SELECT 'auroc' AS metric, {CIV} FROM ux UNION ALL SELECT 'average_precision', {CIV} FROM (SELECT ap AS v FROM ax) UNION ALL SELECT 'ece', {CIV} FROM ex
 UNION ALL SELECT 'brier', {CIV} FROM (SELECT draw, sum(t)/sum(n) AS v FROM picks JOIN (SELECT problem_id, sum((p3-y)*(p3-y)) AS t, count(*) AS n FROM predictions GROUP BY 1) USING (problem_id) GROUP BY 1)""")
def _(spark, sf):
    p = pred(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [B.metric_interval(p, "p3", "y", m).withColumn("metric", F.lit(m)) for m in ("auroc", "average_precision", "ece", "brier")])


@query("b05_paired_metric_difference", f"""WITH {PICKS}, {metric_ctes('p1', 'l')}, {metric_ctes('p2', 'r')}
SELECT 'auroc' AS metric, {CIV} FROM (SELECT ur.v - ul.v AS v FROM ul JOIN ur USING (draw)) UNION ALL SELECT 'ece', {CIV} FROM (SELECT er.v - el.v AS v FROM el JOIN er USING (draw))""")
def _(spark, sf):
    p = pred(spark, sf)
    return B.paired_metric_difference(p, "p1", "p2", "y").withColumn("metric", F.lit("auroc")).unionByName(
        B.paired_metric_difference(p, "p1", "p2", "y", "ece").withColumn("metric", F.lit("ece")))


@query("j05_aligned_predictions", "SELECT research_split, count(*) AS rows, R(avg(p1 - p2)) AS mean_difference FROM predictions GROUP BY 1")
def _(spark, sf):
    p = pred(spark, sf)
    both = J.align_predictions(p.select("run_id", "problem_id", "y", "p1", "research_split"), p.select("run_id", "problem_id", "y", "p2"), ["run_id", "problem_id", "y"])
    return both.groupBy("research_split").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("p1") - F.col("p2")).alias("mean_difference"))


@query("j09_ecdf_lookup", "WITH r AS (SELECT model_key, p1 FROM predictions WHERE research_split = 'train') SELECT run_id, R((SELECT count(*) FROM r WHERE r.model_key = p.model_key AND r.p1 <= p.p1)/(SELECT count(*) FROM r WHERE r.model_key = p.model_key)) AS percentile FROM predictions p")
def _(spark, sf):
    p = pred(spark, sf)
    return J.ecdf_lookup(p, p.where("research_split = 'train'"), ["model_key"], "p1").select("run_id", "percentile")


BLOCKS = {"size": ("characters", "words"), "digits": ("numbers",), "marks": ("operators", "p2")}
FEATURES = [f for fs in BLOCKS.values() for f in fs]


def index_rows(spark, sf):
    p = X.predictions(spark, sf)
    return materialize(surface_counts(p, "text").drop("text"))


IX = r"""ix AS (SELECT run_id, model_key, research_split, length(text)::double AS characters, len(regexp_extract_all(text, '\S+'))::double AS words, -len(regexp_extract_all(text, '-?\d+(?:\.\d+)?'))::double AS numbers,
  len(regexp_extract_all(text, '[+\-*/=<>]'))::double AS operators, abs(p2) AS p2 FROM predictions JOIN documents ON doc_id = run_id),
 lx AS (SELECT * FROM (UNPIVOT ix ON characters, words, numbers, operators, p2 INTO NAME feature VALUE value)), tr AS (SELECT * FROM lx WHERE research_split = 'train')"""


@query("r01_train_references", f"WITH {IX}, c AS (SELECT model_key, feature, value, count(*) AS n FROM tr GROUP BY ALL) SELECT model_key, feature, R(value) AS value, R(sum(n) OVER (PARTITION BY model_key, feature ORDER BY value)/sum(n) OVER (PARTITION BY model_key, feature)) AS cdf FROM c")
def _(spark, sf):
    return P.fit_references(index_rows(spark, sf), FEATURES, F.col("research_split") == "train", negative=("numbers",), absolute=("p2",))


SCORED = """sc AS (SELECT l.run_id, l.model_key, feature, (SELECT count(*) FROM tr t WHERE t.model_key = l.model_key AND t.feature = l.feature AND t.value <= l.value)/(SELECT count(*) FROM tr t WHERE t.model_key = l.model_key AND t.feature = l.feature) AS p FROM lx l),
 bk AS (SELECT run_id, model_key, CASE WHEN feature IN ('characters', 'words') THEN 'size' WHEN feature = 'numbers' THEN 'digits' ELSE 'marks' END AS b, avg(p) AS v FROM sc GROUP BY ALL),
 us AS (SELECT run_id, model_key, max(v) FILTER (b='size') AS block_size, max(v) FILTER (b='digits') AS block_digits, max(v) FILTER (b='marks') AS block_marks, avg(v) AS u FROM bk GROUP BY ALL)"""


@query("r02_uncertainty_index", f"WITH {IX}, {SCORED} SELECT run_id, model_key, R(block_size) AS block_size, R(block_digits) AS block_digits, R(block_marks) AS block_marks, R(u) AS uncertainty_score FROM us")
def _(spark, sf):
    return P.uncertainty_index(index_rows(spark, sf), "run_id", BLOCKS, F.col("research_split") == "train", negative=("numbers",), absolute=("p2",))


@query("m14_low_high_strata", f"WITH {IX}, {SCORED}, r AS (SELECT us.run_id, us.model_key, row_number() OVER (PARTITION BY us.model_key ORDER BY round(u, 9), us.run_id) AS r, count(*) OVER (PARTITION BY us.model_key) AS n FROM us) SELECT run_id, model_key, CASE WHEN r <= n//2 THEN 'low' WHEN r > n - n//2 THEN 'high' ELSE 'unassigned' END AS uncertainty_stratum FROM r")
def _(spark, sf):
    s = P.uncertainty_index(index_rows(spark, sf), "run_id", BLOCKS, F.col("research_split") == "train", negative=("numbers",), absolute=("p2",))
    s = materialize(s.withColumn("uncertainty_score", F.round("uncertainty_score", 9)))
    return M.low_high_strata(s, ["model_key"], "uncertainty_score", "run_id").select("run_id", "model_key", "uncertainty_stratum")


@query("r14_extension_manifest")
def _(spark, sf):
    rows = index_rows(spark, sf)
    scored = P.uncertainty_index(rows, "run_id", BLOCKS, F.col("research_split") == "train", negative=("numbers",), absolute=("p2",))
    marked = materialize(scored.join(rows.select("run_id", "problem_id", "words"), "run_id").withColumn(
        "exclusion_reason", F.when(F.col("words") < 512, "reasoning_shorter_than_anchor")))
    strata = M.low_high_strata(marked.where("exclusion_reason is null"), ["model_key"], "uncertainty_score", "run_id").select("run_id", "uncertainty_stratum")
    out = marked.join(strata, "run_id", "left")
    odd = F.when(F.col("uncertainty_stratum") == "unassigned", "odd_cell_median_unassigned").otherwise(F.col("exclusion_reason"))
    return out.withColumn("exclusion_reason", odd).withColumn("uncertainty_stratum", F.coalesce("uncertainty_stratum", F.lit("ineligible"))).groupBy(
        "model_key", "uncertainty_stratum", "exclusion_reason").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("problem_id").alias("problems"), F.avg("uncertainty_score").alias("mean_score"))


def _deltas(p, base, pairs, keys):
    """Paired AUROC differences, one interval per named candidate, as rows."""
    parts = [B.paired_metric_difference(p, base, c, "y").withColumn(keys, F.lit(n)) for n, c in pairs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("k19_block_increment", f"""WITH {PICKS}, {metric_ctes('p1', 'b')}, {metric_ctes('p2', 'c')}, {metric_ctes('p3', 'd')}
SELECT 'with_hash' AS block, {CIV} FROM (SELECT uc.v - ub.v AS v FROM ub JOIN uc USING (draw)) UNION ALL SELECT 'with_rounding', {CIV} FROM (SELECT ud.v - ub.v AS v FROM ub JOIN ud USING (draw))""")
def _(spark, sf):
    return _deltas(pred(spark, sf), "p1", {"with_hash": "p2", "with_rounding": "p3"}, "block")


SWEEP = (1000, 2000, 8000)


@query("a42_forecast_sweep", f"WITH {PICKS}, {metric_ctes('p2', 'b')}, " + ", ".join(metric_ctes(f"least(1.0, n_chars/{t})", f"s{t}") for t in SWEEP).replace("FROM predictions", "FROM (SELECT p.*, n_chars FROM predictions p JOIN documents ON doc_id = run_id)") + " "
       + " UNION ALL ".join(f"SELECT I({t}) AS prefix_length, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE n_chars >= {t}) AS rows_reaching, {CIV} FROM (SELECT us{t}.v - ub.v AS v FROM ub JOIN us{t} USING (draw))" for t in SWEEP))
def _(spark, sf):
    p = pred(spark, sf)
    for t in SWEEP:
        p = p.withColumn(f"f{t}", F.least(F.lit(1.0), F.col("n_chars") / t))
    p = materialize(p)
    out = _deltas(p, "p2", {str(t): f"f{t}" for t in SWEEP}, "prefix_length").withColumn("prefix_length", F.col("prefix_length").cast("long"))
    reach = p.select(F.explode(F.filter(F.array(*[F.lit(t).cast("long") for t in SWEEP]), lambda t: F.col("n_chars") >= t)).alias("prefix_length")).groupBy("prefix_length").agg(F.count(F.lit(1)).alias("rows_reaching"))
    return out.join(reach, "prefix_length", "left").withColumn("rows_reaching", F.coalesce("rows_reaching", F.lit(0)))
