"""Queries of predictors, probes and controllers (iterative fits: rows-only checks, save the exact steps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.operators import labels as L
from retrials.operators import models as K
from retrials.operators import policies as P
from retrials.operators import signals as S
from retrials.plans import fixtures as X
from retrials.plans.q_arms import COSTS, arms
from retrials.plans.q_probes import _labels, _panel
from retrials.plans.q_tokens import scoped
from retrials.plans.registry import query

FEATURES = ["price", "discount", "tax", "tokens"]


def frame(spark, sf):
    rows = X.attempts(spark, sf).join(X.problem_splits(spark, sf).select("problem_id", "research_split"), "problem_id")
    return materialize(rows.withColumn("discount", F.when(F.col("tokens") % 3 != 0, F.col("discount"))))


def by_problem(c):
    k = F.col(c) % 5
    return F.when(k < 3, "train").when(k == 3, "validation").otherwise("test")


@query("k02_scaled_features", """
WITH t AS (SELECT run_id, tokens, tax, CASE WHEN tokens % 3 <> 0 THEN discount END AS discount, research_split FROM attempts JOIN problem_splits USING (problem_id)), tr AS (SELECT * FROM t WHERE research_split = 'train'),
 m AS (SELECT median(discount) AS md FROM tr), s AS (SELECT avg(coalesce(discount, md)) AS mu, stddev_pop(coalesce(discount, md)) AS sd FROM tr, m), x AS (SELECT avg(tax) AS mu, stddev_pop(tax) AS sd FROM tr)
SELECT run_id, R((coalesce(discount, md) - s.mu)/s.sd) AS discount, R((tax - x.mu)/x.sd) AS tax FROM t, m, s, x""")
def _(spark, sf):
    rows = frame(spark, sf)
    stats = {r.feature: (r.median, r.mean, r.sd) for r in K.numeric_statistics(rows.where("research_split = 'train'"), ["discount", "tax"]).collect()}
    return K.scaled(rows.select("run_id", "discount", "tax"), stats)


@query("k03_logistic_regression")
def _(spark, sf):
    rows = frame(spark, sf)
    return K.fit_predict(rows.where("research_split = 'train'"), rows.where("research_split = 'test'"), "correct", FEATURES, ["category"]).select("run_id", K.P)


@query("k04_tree_models")
def _(spark, sf):
    rows = frame(spark, sf)
    tr, te = rows.where("research_split = 'train'"), rows.where("research_split = 'test'")
    both = K.tree_predictions(tr, te, "correct", FEATURES)
    return K.fit_predict(tr, both, "correct", FEATURES, kind="prior").select("run_id", "boosted", "forest", F.col(K.P).alias("prior"))


@query("k05_platt_calibration")
def _(spark, sf):
    rows = frame(spark, sf)
    s = materialize(K.fit_predict(rows.where("research_split = 'train'"), rows.where("research_split <> 'train'"), "correct", FEATURES))
    return K.platt(s.where("research_split = 'validation'"), s.where("research_split = 'test'"), "correct").select("run_id", K.P, "calibrated", "was_nan")


@query("k06_split_evaluation")
def _(spark, sf):
    return K.evaluate(frame(spark, sf), "correct", FEATURES, ["category"])


@query("k07_ablation_grid")
def _(spark, sf):
    sets = {"cost": ["price", "tokens"], "all": FEATURES}
    return K.ablation_grid(frame(spark, sf), "correct", sets, {"logistic": {}, "prior": {}})


def early(spark, sf):
    rows = scoped(spark, sf)
    s = S.scalar_summary(S.prefix_rows(rows, X.PREFIXES), "s1").select("run_id", "prefix_length", "mean", "std", "slope", "max_rise")
    ids = rows.groupBy("run_id", "problem_id", "model_key", "correct").agg(F.max("n").alias("n"))
    return materialize(s.join(ids, "run_id").withColumn("research_split", by_problem("problem_id")))


EARLY = ["mean", "std", "slope", "max_rise"]


@query("k08_early_prediction_grid")
def _(spark, sf):
    rows = early(spark, sf)
    cells = {(sc, p): rows.where(F.col("prefix_length") == p).where(F.lit(True) if sc == "pooled" else F.col("model_key") == sc)
             for sc in ("pooled", "m0", "m1") for p in (16, 48)}
    return K.grid(cells, ["scope", "prefix_length"], "correct", EARLY)


@query("k08_paired_contrasts")
def _(spark, sf):
    rows = early(spark, sf)
    sets = {"level": ["mean"], "spread": ["mean", "std"], "shape": EARLY}
    return K.contrast_grid({("pooled", p): rows.where(F.col("prefix_length") == p) for p in (16, 48)}, ["scope", "prefix_length"], "correct", sets, "level")


@query("k09_future_length_grid")
def _(spark, sf):
    rows = early(spark, sf).withColumn("long_run", (F.col("n") >= 63).cast("long"))
    return K.grid({(p,): rows.where(F.col("prefix_length") == p) for p in (8, 32)}, ["prefix_length"], "long_run", EARLY)


@query("k10_forecast_grid")
def _(spark, sf):
    lab = _labels(spark, sf)
    panel = materialize(_panel(spark, sf))
    hz = L.horizon_table(panel, lab, [512]).withColumn("target", F.col("within_horizon"))
    hd = L.hazard_table(panel, lab).withColumn("target", F.col("in_bin"))
    keep = ["problem_id", "run_id", "forecast_token", "observed_token_count", "target"]

    def shape(df):
        return df.select(*keep).withColumn("research_split", by_problem("problem_id")).withColumn("time_log1p", F.log1p(F.col("forecast_token").cast("double")))

    return K.grid({("horizon_512",): shape(hz), ("hazard",): shape(hd)}, ["table"], "target", ["time_log1p", "observed_token_count"])


@query("k11_group_out_of_fold")
def _(spark, sf):
    return K.group_oof(frame(spark, sf), "correct", FEATURES).select("run_id", "fold", K.P)


@query("k12_nested_platt")
def _(spark, sf):
    return K.nested_platt(early(spark, sf).where("prefix_length = 32"), "correct", EARLY).select("run_id", "fold", K.P, "calibrated")


@query("k13_vector_probe")
def _(spark, sf):
    return K.probe_oof(materialize(X.vectors(spark, sf)), "correct", "vec").select("vec_id", "fold", K.P)


@query("k14_centred_probe")
def _(spark, sf):
    from retrials.operators.paths import centred
    return K.probe_oof(materialize(centred(X.vectors(spark, sf))), "correct", "centred").select("vec_id", "fold", K.P)


@query("k15_problem_oracle")
def _(spark, sf):
    return K.problem_oracle(materialize(X.vectors(spark, sf)))


@query("k16_plane_coordinates")
def _(spark, sf):
    return K.plane_coordinates(materialize(X.vectors(spark, sf)), F.col("problem_id") < 6).select("vec_id", "run_id", "token_index", "x", "y")


@query("k17_transfer")
def _(spark, sf):
    return K.transfer(frame(spark, sf), "model_key", "correct", FEATURES)


@query("k18_coefficient_ranking")
def _(spark, sf):
    return K.coefficients(frame(spark, sf), "correct", FEATURES)


@query("k20_confirmatory_endpoint")
def _(spark, sf):
    return K.confirmatory(early(spark, sf).where("prefix_length = 32"), "correct", ["mean"], ["std", "slope"])


def controller(spark, sf):
    return arms(spark, sf).withColumn("noise", F.col("branch_index") % 7)


@query("r09_arm_response_models")
def _(spark, sf):
    rows = controller(spark, sf)
    p = K.arm_responses(rows.where("problem_id % 5 < 3"), rows.where("problem_id % 5 >= 3"), ["uncertainty_score", "level", "noise"])
    return P.with_utilities(p, F.lit(0.2), COSTS).select("source_run_id", "p_short", "p_medium", "p_long", "selected_arm")


@query("r11_cross_fitted_arms")
def _(spark, sf):
    return K.cross_fitted_arms(controller(spark, sf), ["uncertainty_score", "level"], 2).select("source_run_id", "fold", "p_short", "p_medium", "p_long")
