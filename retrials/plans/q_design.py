"""Queries of sampling, audits, joins, eligibility and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.functions.keys import hash60, run_identity
from retrials.functions.lineage import materialize, shared_folder
from retrials.operators import contracts as C
from retrials.operators import joins as J
from retrials.operators import sampling as M
from retrials.plans import fixtures as X
from retrials.plans.registry import query
from retrials.sources import attempts as SA
from retrials.sources import integrity as SI
from retrials.sources import problems as SP

LV = (1, 2, 3, 4, 5)


def HR(seed: str, strata: str = "level", src: str = "problems", salt: bool = True) -> str:
    """Rows of ``src`` with their hash rank r and group size n per level."""
    key = f"'{seed}:'||level||':'||problem_id" if salt else f"'{seed}:'||problem_id"
    return f"(SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY H({key}), problem_id) AS r, count(*) OVER (PARTITION BY {strata}) AS n FROM {src})"


SPLIT = "CASE WHEN r <= round_even(n*0.6, 0) THEN 'train' WHEN r <= round_even(n*0.6, 0) + round_even(n*0.2, 0) THEN 'validation' ELSE 'test' END"


def probs(spark, sf):
    return X.problems(spark, sf).select("problem_id", "level")


@query("m01_level_balanced_sample", f"SELECT problem_id, level FROM {HR('m1')} WHERE r <= 20")
def _(spark, sf):
    return M.balanced_sample(probs(spark, sf), "m1", 20, LV)


@query("m02_balanced_with_fill", f"""WITH h AS {HR('m2')} SELECT problem_id, level, 'level' AS origin FROM h WHERE r <= 20
UNION ALL (SELECT problem_id, level, 'fill' FROM h WHERE r > 20 ORDER BY H('m2:fill:'||problem_id), problem_id LIMIT 3)""")
def _(spark, sf):
    return M.balanced_with_fill(probs(spark, sf), "m2", 103)


@query("m03_nested_sample", f"SELECT problem_id, level, r <= 10 AS in_base FROM {HR('m1')} WHERE r <= 30")
def _(spark, sf):
    return M.nested_sample(probs(spark, sf), "m1", 10, 30, LV)


@query("m04_problem_split", f"SELECT problem_id, {SPLIT} AS research_split FROM {HR('m4', '1', salt=False)}")
def _(spark, sf):
    return M.split_by_problem(probs(spark, sf), "m4").select("problem_id", "research_split")


@query("m05_stratified_split", "SELECT problem_id, level, research_split FROM problem_splits")
def _(spark, sf):
    return X.problem_splits(spark, sf)


@query("m06_shards", "SELECT problem_id, I((row_number() OVER (ORDER BY problem_id) - 1) % 7) AS shard FROM problems")
def _(spark, sf):
    return M.shards(probs(spark, sf), ["problem_id"], 7).select("problem_id", "shard")


@query("m07_fixed_per_problem", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY H('m7:'||problem_id||':'||run_id), run_id) AS r FROM attempts), w AS (SELECT problem_id, sum(correct::int) BETWEEN 8 AND 10 AS in_band FROM attempts GROUP BY 1)
SELECT run_id, problem_id, in_band FROM r JOIN w USING (problem_id) WHERE r <= 5 OR in_band""")
def _(spark, sf):
    return M.fixed_per_problem(X.attempts(spark, sf), "m7", 5, 8, 10).select("run_id", "problem_id", "in_band")


@query("m08_success_screen", "SELECT problem_id, count(DISTINCT seed) AS seeds, I(sum(correct::int)) AS successes FROM seeded WHERE seed <= 6 GROUP BY 1 HAVING sum(correct::int) BETWEEN 1 AND 5")
def _(spark, sf):
    return M.success_screen(X.seeded(spark, sf), 6, 1, 5)


@query("m09_supplement_screen", f"""SELECT problem_id, level, count(DISTINCT model_key) AS models, I(sum(correct::int)) AS solved FROM attempts WHERE problem_id NOT IN (SELECT problem_id FROM {HR('m1')} WHERE r <= 20)
GROUP BY ALL HAVING count(DISTINCT model_key) = 2 AND sum(correct::int) BETWEEN 3 AND 9""")
def _(spark, sf):
    dev = M.balanced_sample(probs(spark, sf), "m1", 20, LV)
    return M.complete_panel(X.attempts(spark, sf), 2, dev, 3, 9)


@query("m10_common_cohort_with_pilot", f"""WITH c AS (SELECT * FROM {HR('m10', src="(SELECT * FROM problems WHERE problem_id IN (SELECT problem_id FROM attempts GROUP BY 1 HAVING count(DISTINCT model_key) = 2))")} WHERE r <= 15)
SELECT problem_id, level, problem_id = first_value(problem_id) OVER (PARTITION BY level ORDER BY H('m10p:'||level||':'||problem_id), problem_id) AS is_pilot FROM c""")
def _(spark, sf):
    common = J.common_to_all(X.attempts(spark, sf), "problem_id", "model_key")
    pool = probs(spark, sf).join(common, "problem_id", "left_semi")
    return M.first_per_level(materialize(M.balanced_sample(pool, "m10", 15, LV)), "m10p")


@query("m11_representative_run", "SELECT problem_id, arg_min(run_id, (seed, run_id)) AS run_id, min(seed) AS seed FROM seeded WHERE model_key = 'm_O' GROUP BY 1")
def _(spark, sf):
    rows = X.seeded(spark, sf).where("model_key = 'm_O'").select("problem_id", "seed", "run_id")
    return M.representative(rows, ["problem_id"], ["seed", "run_id"])


@query("m13_evenly_spaced", """WITH r AS (SELECT run_id, correct, row_number() OVER (PARTITION BY correct ORDER BY level, tokens, run_id) AS r, count(*) OVER (PARTITION BY correct) AS n FROM attempts)
SELECT run_id, correct, r AS rank FROM r WHERE r - 1 IN (SELECT floor(j*(n-1)/19) FROM (SELECT unnest(range(20)) AS j))""")
def _(spark, sf):
    rows = materialize(X.attempts(spark, sf).select("run_id", "correct", "level", "tokens"))
    return M.evenly_spaced(rows, ["correct"], ["level", "tokens", "run_id"], 20).select("run_id", "correct", "rank")


@query("m15_problem_folds", """WITH m AS (SELECT problem_id, I(CASE WHEN min(correct::int) = max(correct::int) THEN min(correct::int) ELSE 2 END) AS class_mix FROM attempts GROUP BY 1)
SELECT problem_id, class_mix, I((row_number() OVER (PARTITION BY class_mix ORDER BY H('m15:'||problem_id), problem_id) - 1) % 5) AS fold FROM m""")
def _(spark, sf):
    return M.problem_folds(X.attempts(spark, sf), "m15", 5)


@query("m16_sample_folds", "SELECT run_id, I((row_number() OVER (PARTITION BY problem_id, correct ORDER BY H('m16:'||run_id), run_id) - 1) % 5) AS fold FROM attempts")
def _(spark, sf):
    return M.sample_folds(X.attempts(spark, sf), "m16", 5).select("run_id", "fold")


M17 = f"""hist AS (SELECT problem_id FROM {HR('m1')} WHERE r <= 20), fresh AS (SELECT * FROM problems WHERE problem_id NOT IN (SELECT problem_id FROM hist)),
 pn AS (SELECT problem_id, level FROM {HR('pn', src='fresh')} WHERE r <= 25), ps AS (SELECT problem_id, level, {SPLIT} AS research_split, 'confirmation' AS panel FROM {HR('ps', src='pn')}),
 rest AS (SELECT * FROM fresh WHERE problem_id NOT IN (SELECT problem_id FROM pn) AND level = 5), hd AS (SELECT problem_id, level, 'challenge' AS research_split, 'challenge' AS panel FROM {HR('hd', src='rest')} WHERE r <= 40)"""


def panels(spark, sf):
    p = materialize(probs(spark, sf))
    hist = materialize(M.balanced_sample(p, "m1", 20, LV))
    return M.confirmation_and_challenge(p, hist, 25, LV, 5, 40, {"panel": "pn", "split": "ps", "hard": "hd"})


@query("m17_confirmation_and_challenge", f"WITH {M17} SELECT * FROM ps UNION ALL SELECT * FROM hd")
def _(spark, sf):
    return panels(spark, sf)


@query("m17_panel_counts", f"WITH {M17} SELECT panel, level, research_split, count(*) AS problems FROM (SELECT * FROM ps UNION ALL SELECT * FROM hd) GROUP BY ALL")
def _(spark, sf):
    return panels(spark, sf).groupBy("panel", "level", "research_split").agg(F.count(F.lit(1)).alias("problems"))


@query("m18_subset_by_ids", f"SELECT problem_id, level, research_split FROM problem_splits WHERE problem_id IN (SELECT problem_id FROM {HR('m18')} WHERE r <= 5)")
def _(spark, sf):
    ids = materialize(M.balanced_sample(probs(spark, sf), "m18", 5, LV))
    return M.subset_by_ids(materialize(X.problem_splits(spark, sf)), ids)


@query("m19_level_subset_split", f"WITH s AS (SELECT problem_id, level FROM {HR('m19')} WHERE r <= 30 AND level IN (1, 2, 4, 5)) SELECT problem_id, level, {SPLIT} AS research_split FROM {HR('m19s', src='s')}")
def _(spark, sf):
    s = materialize(M.balanced_sample(probs(spark, sf), "m19", 30, (1, 2, 4, 5)))
    return M.split_by_problem(s, "m19s", strata=["level"])


@query("c02_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return C.duplicates(X.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c03_split_overlap", """WITH s AS (SELECT DISTINCT problem_id, CASE WHEN level <= 3 THEN 'train' WHEN tokens < 1000 THEN 'validation' ELSE 'test' END AS s FROM attempts), n AS (SELECT DISTINCT s FROM s)
SELECT a.s AS left_split, b.s AS right_split, (SELECT count(*) FROM s x JOIN s y USING (problem_id) WHERE x.s = a.s AND y.s = b.s) AS shared_problems FROM n a JOIN n b ON a.s < b.s""")
def _(spark, sf):
    split = F.when(F.col("level") <= 3, "train").when(F.col("tokens") < 1000, "validation").otherwise("test")
    return C.split_overlap(X.attempts(spark, sf).select("problem_id", split.alias("research_split")))


@query("c04_missing_by_feature", """WITH t AS (SELECT model_key, s1, s3, CASE WHEN s2 < 50 THEN s2 END AS low FROM tokens)
SELECT model_key, feature, count(*) AS rows, I(sum(m)) AS missing, R(avg(m)) AS missing_rate FROM (SELECT model_key, unnest(['s1', 's3', 'low']) AS feature, unnest([(s1 IS NULL)::int, (s3 IS NULL)::int, (low IS NULL)::int]) AS m FROM t) GROUP BY ALL""")
def _(spark, sf):
    t = X.tokens(spark, sf, True).withColumn("low", F.when(F.col("s2") < 50, F.col("s2")).when(F.col("s2") < 75, F.lit(float("nan"))))
    return C.missing_by_feature(t, "model_key", ["s1", "s3", "low"])


@query("c05_design_balance", """WITH p AS (SELECT model_key, level, problem_id, count(*) AS n, count(DISTINCT mseed) AS k FROM seeded WHERE mseed <= 4 GROUP BY ALL)
SELECT model_key, level, count(*) AS problems, I(sum(n)) AS trajectories, count(*) FILTER (k = 4) AS complete_problems FROM p GROUP BY ALL""")
def _(spark, sf):
    rows = X.seeded(spark, sf, True).drop("seed").withColumnRenamed("mseed", "seed").where("seed <= 4")
    return C.design_balance(rows, 4)


@query("c05_unpaired_keys", "SELECT problem_id, mseed AS seed, count(DISTINCT model_key) AS models FROM seeded GROUP BY ALL HAVING count(DISTINCT model_key) <> 2")
def _(spark, sf):
    return C.unpaired_keys(X.seeded(spark, sf, True).drop("seed").withColumnRenamed("mseed", "seed"), ["problem_id", "seed"], 2)


@query("c06_panel_audit", """WITH e AS (SELECT problem_id, m, s FROM problems, (SELECT unnest(['m_F', 'm_O']) AS m), (SELECT unnest(range(1, 9)) AS s)), o AS (SELECT problem_id, model_key AS m, mseed AS s, count(*) AS c FROM seeded GROUP BY ALL)
SELECT (SELECT count(*) FROM e) AS expected, I((SELECT sum(c) FROM o)) AS observed, (SELECT count(*) FROM e ANTI JOIN o USING (problem_id, m, s)) AS missing, (SELECT count(*) FROM o ANTI JOIN e USING (problem_id, m, s)) AS unexpected, (SELECT count(*) FROM o WHERE c > 1) AS duplicate_keys""")
def _(spark, sf):
    seen = X.seeded(spark, sf, True).select("problem_id", "model_key", F.col("mseed").alias("seed"))
    want = probs(spark, sf).select("problem_id", F.explode(F.array(F.lit("m_F"), F.lit("m_O"))).alias("model_key")).select(
        "problem_id", "model_key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("seed"))
    return C.panel_audit(seen, want, ["problem_id", "model_key", "seed"])


@query("c08_completion_counters", """SELECT kind, value, count(*) AS n FROM (SELECT unnest(['correct', 'finish_reason', 'dataset', 'model_key']) AS kind, unnest([cast(correct AS varchar), finish_reason, dataset, model_key]) AS value FROM attempts) GROUP BY ALL""")
def _(spark, sf):
    return C.completion_counters(X.attempts(spark, sf), ["correct", "finish_reason", "dataset", "model_key"])


@query("c09_pilot_audit", """WITH p AS (SELECT model_key, level, count(*) AS attempts, count(DISTINCT problem_id) AS problems, avg(correct::int) AS r, quantile_cont(tokens, 0.5) AS md, max(tokens) AS mx, sum(tokens) AS s FROM attempts GROUP BY ALL)
SELECT model_key, level, attempts, problems, R(r) AS accuracy, R(md) AS median_tokens, mx AS max_tokens, I(floor(s*1000/problems)) AS projected_tokens, r > 0 AND r < 1 AS both_labels FROM p""")
def _(spark, sf):
    from retrials.operators.audits import pilot_audit
    return pilot_audit(X.attempts(spark, sf), 1000)


@query("c10_metadata_agreement", """SELECT l_partkey AS problem_id, count(DISTINCT l_linestatus) AS sources, count(DISTINCT (least(l_linenumber, 2), l_returnflag = 'R')) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT (least(l_linenumber, 2), l_returnflag = 'R')) > 1""")
def _(spark, sf):
    line = X.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("problem_id"), F.col("l_linestatus").alias("model_key"),
                                                 F.least("l_linenumber", F.lit(2)).alias("level"), (F.col("l_returnflag") == "R").alias("category"))
    return C.disagreeing(line, "problem_id", ["level", "category"], "model_key")


@query("j01_one_to_one", "SELECT problem_id, level, category FROM problems")
def _(spark, sf):
    p = X.problems(spark, sf)
    return J.one_to_one(p.select("problem_id", "level"), p.select("problem_id", "category"), ["problem_id"])


@query("j02_full_coverage", "SELECT problem_id, level, count(*) AS attempts FROM attempts GROUP BY ALL")
def _(spark, sf):
    per = materialize(X.attempts(spark, sf).groupBy("problem_id").agg(F.count(F.lit(1)).alias("attempts")))
    return J.full_coverage(per, probs(spark, sf), ["problem_id"])


@query("j02_one_sided_keys", "SELECT problem_id, 'right' AS side FROM problems WHERE problem_id NOT IN (SELECT problem_id FROM attempts GROUP BY 1 HAVING count(*) >= 25)")
def _(spark, sf):
    per = X.attempts(spark, sf).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")
    return J.one_sided_keys(per, probs(spark, sf), ["problem_id"])


@query("j03_many_to_one", "SELECT level, count(*) AS attempts FROM attempts GROUP BY 1")
def _(spark, sf):
    rows = J.many_to_one(X.attempts(spark, sf).drop("level"), probs(spark, sf), ["problem_id"], "level")
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("attempts"))


@query("j04_paired_self_join", """SELECT dataset, count(*) AS pairs, R(avg(b - a)) AS mean_difference FROM (SELECT dataset, problem_id, mseed, max(correct::int) FILTER (model_key='m_F') AS a, max(correct::int) FILTER (model_key='m_O') AS b FROM seeded GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from retrials.operators.aggregates import paired_conditions
    rows = paired_conditions(X.seeded(spark, sf, True), ["dataset", "problem_id", "mseed"], "model_key", "m_F", "m_O", "correct")
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("pairs"), F.avg("difference").alias("mean_difference"))


@query("j06_common_to_all", "SELECT problem_id FROM attempts WHERE mode = 'R' GROUP BY 1 HAVING count(DISTINCT finish_reason) = 3")
def _(spark, sf):
    return J.common_to_all(X.attempts(spark, sf).where("mode = 'R'"), "problem_id", "finish_reason")


@query("j07_exclusion_join", f"SELECT problem_id, level FROM problems WHERE problem_id NOT IN (SELECT problem_id FROM {HR('m1')} WHERE r <= 20)")
def _(spark, sf):
    return probs(spark, sf).join(M.balanced_sample(probs(spark, sf), "m1", 20, LV).select("problem_id"), "problem_id", "left_anti")


@query("p04_complete_seeds", """WITH a AS (SELECT * FROM seeded WHERE seed <= 4), w AS (SELECT x.*, p FROM a x, (SELECT unnest([200, 400, 800]) AS p) WHERE tokens >= p), c AS (SELECT problem_id, p FROM w GROUP BY ALL HAVING count(DISTINCT seed) = 4)
SELECT I(p) AS prefix_length, count(DISTINCT problem_id) AS problems, count(*) AS attempts, R(count(DISTINCT problem_id)/(SELECT count(DISTINCT problem_id) FROM a)) AS coverage FROM w JOIN c USING (problem_id, p) GROUP BY 1""")
def _(spark, sf):
    from retrials.operators.audits import complete_seed_coverage
    return complete_seed_coverage(X.seeded(spark, sf).where("seed <= 4"), 4, (200, 400, 800))


@query("p05_mid_band", "SELECT run_id, problem_id FROM attempts WHERE problem_id IN (SELECT problem_id FROM attempts GROUP BY 1 HAVING avg(correct::int) >= 0.3 AND avg(correct::int) < 0.5)")
def _(spark, sf):
    from retrials.operators.audits import mid_band
    return mid_band(X.attempts(spark, sf), 0.3, 0.5).select("run_id", "problem_id")


@query("p10_resume", "SELECT problem_id, model_key, seed FROM seeded WHERE NOT (tokens % 2 = 0 AND correct)")
def _(spark, sf):
    rows = materialize(X.seeded(spark, sf).select("problem_id", "model_key", "seed", "tokens", "correct"))
    done = rows.where("tokens % 2 = 0 and correct")
    keys = ["problem_id", "model_key", "seed"]
    return rows.join(done.select(*keys), keys, "left_anti").select(*keys)


@query("s12_run_identity", "SELECT run_id, substr(sha256('exp|'||model_key||'|'||dataset||'|'||problem_id||'|'||tokens), 1, 24) AS identity FROM attempts")
def _(spark, sf):
    c = F.col
    return X.attempts(spark, sf).select("run_id", run_identity("exp", c("model_key"), c("dataset"), c("problem_id"), c("tokens")).alias("identity"))


def _folder(spark):
    import uuid
    return f"{shared_folder(spark).rstrip('/')}/retrials/{uuid.uuid4().hex}"


def bundle(spark, sf):
    p = X.problems(spark, sf).join(X.problem_splits(spark, sf).select("problem_id", "research_split"), "problem_id")
    return p.select(F.col("problem_id").cast("string").alias("problem_id"), F.lit("math").alias("dataset"), F.col("problem_id").alias("source_index"), "problem", "level", "category", "research_split")


@query("s01_problem_bundle", "SELECT cast(problem_id AS varchar) AS problem_id, p.level, category, research_split FROM problems p JOIN problem_splits USING (problem_id)")
def _(spark, sf):
    root = _folder(spark)
    SP.write_problems(bundle(spark, sf), root + "/problems", root + "/splits")
    return SP.read_problems(spark, root + "/problems").select("problem_id", "level", "category", "research_split")


@query("s02_split_counts", "SELECT level, research_split, count(*) AS problems FROM problem_splits GROUP BY ALL")
def _(spark, sf):
    root = _folder(spark)
    SP.write_problems(bundle(spark, sf), root + "/problems", root + "/splits")
    return SP.split_counts(SP.read_problems(spark, root + "/problems"))


@query("s03_committed_attempts", "SELECT user_id AS run_id, count(*) AS events FROM events WHERE user_id % 4 <> 0 GROUP BY 1")
def _(spark, sf):
    root = _folder(spark)
    runs = X.table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("events"))
    # A directory per run, marked complete for three runs of four.
    meta = runs.select(F.concat(F.lit("g"), F.col("run_id") % 4).alias("g"), "run_id", "events")
    meta.write.partitionBy("g").json(root)
    _rename_outputs(spark, root, "metadata")
    done = [f"{root}/g=g{k}" for k in (1, 2, 3)]
    for d in done:
        _touch(spark, f"{d}/complete.json")
    return SA.read_attempts(spark, root, "run_id long, events long").select("run_id", "events")


def _fs(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _touch(spark, path):
    fs, p, _ = _fs(spark, path)
    out = fs.create(p)
    out.writeBytes("{}")
    out.close()


def _rename_outputs(spark, root, stem):
    fs, p, jvm = _fs(spark, root)
    for i, d in enumerate(fs.listStatus(p)):
        if d.isDirectory():
            for k, f in enumerate(fs.listStatus(d.getPath())):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(d.getPath(), f"{stem}_{k}.json"))


@query("s04_token_series", "SELECT model_key, count(*) AS tokens, R(avg(s1)) AS mean_s1 FROM tokens0 GROUP BY 1")
def _(spark, sf):
    t = materialize(X.tokens(spark, sf))
    meta = t.select("run_id", "model_key").distinct()
    return SA.load_tokens(t.drop("model_key"), meta).groupBy("model_key").agg(F.count(F.lit(1)).alias("tokens"), F.avg("s1").alias("mean_s1"))


@query("s05_prefix_tables", "SELECT prefix_length, count(*) AS rows, R(avg(m)) AS mean FROM (SELECT run_id, prefix_length, avg(s1) AS m FROM cut GROUP BY ALL) GROUP BY 1")
def _(spark, sf):
    from retrials.operators.signals import analysis_window, prefix_rows
    root = _folder(spark)
    rows = prefix_rows(materialize(analysis_window(materialize(X.tokens(spark, sf)))), X.PREFIXES)
    feats = materialize(rows.groupBy("run_id", "prefix_length").agg(F.avg("s1").alias("m")))
    for p in X.PREFIXES:
        feats.where(F.col("prefix_length") == p).drop("prefix_length").write.parquet(f"{root}/features_prefix_{p}.parquet")
    return SA.read_prefix_tables(spark, root).groupBy("prefix_length").agg(F.count(F.lit(1)).alias("rows"), F.avg("m").alias("mean"))


@query("s06_pruned_shards", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return SA.read_shards(spark, [f"{sf}/lineitem.parquet"], ["l_partkey"]).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("s07_rollouts", "SELECT conv_id AS problem, I(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS sample, I(length(text)) AS characters FROM conversations")
def _(spark, sf):
    c = X.table(spark, sf, "conversations")
    packed = c.groupBy(F.col("conv_id").alias("problem")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text).alias("samples"))
    return SA.explode_rollouts(packed, ["problem"]).select("problem", "sample", F.length("text").alias("characters"))


@query("s07_rollout_archives", """SELECT cast(conv_id AS varchar) AS problem, cast(max(n) OVER (PARTITION BY conv_id) AS varchar) AS reference, I(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS sample, I(length(text)) AS characters
 FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def _(spark, sf):
    from retrials.sources.archives import read_rollout_archives, write_rollout_archives
    root = _folder(spark)
    c = X.table(spark, sf, "conversations")
    packed = c.groupBy(F.col("conv_id").alias("problem")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text).alias("samples"), F.count(F.lit(1)).alias("gt_answer"))
    write_rollout_archives(packed, root)
    return read_rollout_archives(spark, root).select("problem", "reference", "sample", F.length("text").cast("long").alias("characters"))


@query("s10_file_audit")
def _(spark, sf):
    found = SI.file_manifest(spark, sf, "*.parquet")
    claimed = found.where("file <> 'region.parquet'").withColumn("size_bytes", F.when(F.col("file") == "nation.parquet", 1).otherwise(F.col("size_bytes")))
    return SI.audit_files(found, claimed)


@query("s11_file_manifest")
def _(spark, sf):
    return SI.file_manifest(spark, sf, "*.parquet")
