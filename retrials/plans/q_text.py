"""Queries of the text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrials.functions.keys import hash60
from retrials.operators import sampling as M
from retrials.operators import text as Q
from retrials.plans import fixtures as X
from retrials.plans.registry import query

RAW = """word AS (SELECT doc_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS problem, cast(n_chars AS varchar) AS ref FROM documents)"""


def corpora(spark, sf):
    d = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("source_index"), F.col("text").alias("question"),
        F.concat(F.lit("worked #### 0 then #### "), F.col("n_chars").cast("string"), F.lit(" ")).alias("answer"))
    p = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("source_index"), F.col("p_name").alias("problem"),
        F.concat(F.lit("so \\boxed{1} and \\boxed{"), F.col("p_size").cast("string"), F.lit("}")).alias("solution"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("answer"),
        F.concat(F.lit("Level "), (F.col("p_size") % 7).cast("string")).alias("level"), F.col("p_type").alias("type"))
    a = Q.canonical_word_problems(d, "gsm8k", "words", "train")
    return a.unionByName(Q.canonical_math_problems(p, "math", "numbers", "test"))


CANON = """canon AS (SELECT 'gsm8k_'||lpad(cast(doc_id AS varchar), cast(greatest(5, length(cast(doc_id AS varchar))) AS int), '0')||'_'||substr(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 12) AS problem_id,
   'gsm8k' AS dataset, doc_id AS source_index, cast(n_chars AS varchar) AS reference_answer, cast(NULL AS bigint) AS level, cast(NULL AS varchar) AS category FROM documents
 UNION ALL SELECT 'math_'||lpad(cast(p_partkey AS varchar), cast(greatest(5, length(cast(p_partkey AS varchar))) AS int), '0')||'_'||substr(sha256(p_name), 1, 12), 'math', p_partkey, cast(p_size AS varchar),
   CASE WHEN p_size % 7 BETWEEN 1 AND 5 THEN I(p_size % 7) END, p_type FROM part)"""


@query("tj1_canonical_problems", f"WITH {CANON} SELECT problem_id, dataset, source_index, reference_answer, level, category FROM canon")
def _(spark, sf):
    return corpora(spark, sf).select("problem_id", "dataset", "source_index", "reference_answer", "level", "category")


@query("tj1_corpus_counts", f"WITH {CANON} SELECT dataset, level, category, count(*) AS problems, count(DISTINCT problem_id) AS ids FROM canon GROUP BY ALL")
def _(spark, sf):
    return Q.corpus_counts(corpora(spark, sf))


@query("t05_contest_records", """
SELECT 'harp_'||lpad(cast(p_partkey AS varchar), cast(greatest(5, length(cast(p_partkey AS varchar))) AS int), '0')||'_'||substr(sha256((2000 + p_partkey % 20)||'|'||p_brand||'|'||p_size||'|'||p_name), 1, 12) AS problem_id,
 CASE WHEN p_size % 3 = 0 THEN 'second' ELSE 'first' END AS reference_solution, I(1 + p_size % 6) AS level, p_type AS category, 'external_test' AS research_split FROM part""")
def _(spark, sf):
    p = X.table(spark, sf, "part")
    raw = p.select(F.col("p_partkey").alias("source_index"), (2000 + F.col("p_partkey") % 20).alias("year"), F.col("p_brand").alias("contest"),
                   F.col("p_size").alias("number"), F.col("p_name").alias("problem"), F.col("p_retailprice").cast("string").alias("answer"),
                   (1 + F.col("p_size") % 6).alias("level"), F.col("p_type").alias("subject"),
                   F.when(F.col("p_size") % 3 == 0, " ").otherwise("first").alias("solution_1"), F.lit("second").alias("solution_2"))
    return Q.canonical_contest_problems(raw, "harp", "contests", "all").select("problem_id", "reference_solution", "level", "category", "research_split")


ANS = r"""ans AS (SELECT doc_id, dataset, problem_id, reference_answer, text,
  regexp_extract_all(text, '\\boxed\{([^{}]*)\}', 1)[-1] AS bx, regexp_extract_all(text, '####\s*([^\n]+)', 1)[-1] AS gs,
  regexp_extract_all(text, '(?i)final\s+answer\s*(?:is|:)\s*([^\n]+)', 1)[-1] AS f1, regexp_extract_all(text, '(?i)answer\s*(?:is|:)\s*([^\n]+)', 1)[-1] AS f2 FROM graded_text),
 gr AS (SELECT *, trim(coalesce(bx, gs, f1, f2)) AS predicted_answer, CASE WHEN bx IS NOT NULL THEN 'boxed' WHEN gs IS NOT NULL THEN 'gsm_marker' WHEN coalesce(f1, f2) IS NOT NULL THEN 'text_marker' ELSE 'missing' END AS extraction_status FROM ans),
 vd AS (SELECT *, coalesce(predicted_answer = reference_answer, false) AS correct, CASE WHEN predicted_answer IS NULL THEN 'missing_answer' ELSE 'numeric' END AS verification_method FROM gr)"""


def graded(spark, sf):
    return Q.grade(X.graded_text(spark, sf))


@query("tj2_grade_attempts", f"WITH {ANS} SELECT doc_id, correct, predicted_answer, extraction_status, verification_method FROM vd")
def _(spark, sf):
    g = graded(spark, sf)
    return g.select("doc_id", *[F.col("verification." + c).alias(c) for c in ("correct", "predicted_answer", "extraction_status", "verification_method")])


@query("tj2_grade_summary", f"WITH {ANS} SELECT problem_id, extraction_status, verification_method, count(*) AS attempts, count(*) FILTER (correct) AS correct, R(avg(correct::int)) AS accuracy FROM vd GROUP BY ALL".replace("count(*) FILTER (correct) AS correct, R(avg(correct::int))", "count(*) FILTER (vd.correct) AS correct, R(avg(vd.correct::int))"))
def _(spark, sf):
    return Q.grade_summary(graded(spark, sf), ["problem_id"])


@query("t08_split_reasoning", r"""
WITH p AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '</think>' WHEN 1 THEN '[/THINK]' END AS m FROM graded_text),
 s AS (SELECT *, CASE WHEN m IS NOT NULL THEN length(text) - length(m) - (strpos(reverse(text), reverse(m)) - 1) END AS k, strpos(text, chr(92)||'boxed{') AS bx FROM p)
SELECT doc_id, CASE WHEN m = '</think>' THEN 'think_tag' WHEN m = '[/THINK]' THEN 'mistral_think_tag' WHEN bx > 0 THEN 'boxed_boundary' ELSE 'unknown' END AS boundary,
 I(length(regexp_replace(CASE WHEN m IS NOT NULL THEN substr(text, length(m), k - length(m) + 1) WHEN bx > 0 THEN left(text, bx - 1) ELSE text END, '^\s+|\s+$', '', 'g'))) AS reasoning_length,
 regexp_replace(CASE WHEN m IS NOT NULL THEN substr(text, k + length(m) + 1) WHEN bx > 0 THEN substr(text, bx) ELSE '' END, '^\s+|\s+$', '', 'g') AS final_part FROM s""")
def _(spark, sf):
    return Q.split_reasoning(X.graded_text(spark, sf)).select("doc_id", "boundary", F.length("reasoning").alias("reasoning_length"), "final_part")


VALUES = """CASE p_partkey % 7 WHEN 0 THEN p_size||'%' WHEN 1 THEN p_size||'/4' WHEN 2 THEN '$'||p_size||',000.$' WHEN 3 THEN chr(92)||'text{'||p_size||'}' WHEN 4 THEN p_size||'/0'
  WHEN 5 THEN ' '||p_size||chr(92)||',000'||chr(92)||'% ' ELSE p_name END"""


@query("t10_numeric_values", f"""SELECT p_partkey, {VALUES} AS raw, R(CASE p_partkey % 7 WHEN 0 THEN p_size/100 WHEN 1 THEN p_size/4 WHEN 2 THEN p_size*1000 WHEN 3 THEN p_size WHEN 5 THEN p_size*10 END) AS value,
 CASE p_partkey % 7 WHEN 0 THEN p_size||'%' WHEN 1 THEN p_size||'/4' WHEN 2 THEN p_size||',000' WHEN 3 THEN cast(p_size AS varchar) WHEN 4 THEN p_size||'/0' WHEN 5 THEN p_size||'000'||chr(92)||'%' ELSE replace(p_name, ' ', '') END AS plain,
 CASE WHEN p_partkey % 7 IN (4, 6) THEN NULL ELSE (CASE p_partkey % 7 WHEN 0 THEN p_size/100 WHEN 1 THEN p_size/4 WHEN 2 THEN p_size*1000 WHEN 3 THEN p_size WHEN 5 THEN p_size*10 END) = p_size/4 END AS equals_quarter FROM part""")
def _(spark, sf):
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 7
    raw = (F.when(k == 0, F.concat(s, F.lit("%"))).when(k == 1, F.concat(s, F.lit("/4"))).when(k == 2, F.concat(F.lit("$"), s, F.lit(",000.$")))
           .when(k == 3, F.concat(F.lit("\\text{"), s, F.lit("}"))).when(k == 4, F.concat(s, F.lit("/0")))
           .when(k == 5, F.concat(F.lit(" "), s, F.lit("\\,000\\% "))).otherwise(F.col("p_name")))
    p = X.table(spark, sf, "part").select("p_partkey", "p_size", raw.alias("raw"))
    return p.select("p_partkey", "raw", Q.numeric_value(F.col("raw")).alias("value"), Q.plain_answer(F.col("raw")).alias("plain"),
                    Q.numbers_equal(Q.numeric_value(F.col("raw")), F.col("p_size") / 4).alias("equals_quarter"))


@query("t13_multiple_choice", """
WITH t AS (SELECT doc_id, text||chr(10)||CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'Final answer is: **('||chr((65 + doc_id % 4)::int)||')' END AS text, chr((65 + doc_id % 3)::int) AS gold FROM documents),
 l AS (SELECT doc_id, gold, regexp_extract(right(text, 500), '(?i)final answer is\\s*:?\\s*\\**\\(?([A-D])\\)?', 1) AS x FROM t)
SELECT doc_id, CASE WHEN x <> '' THEN upper(x) END AS letter, x <> '' AS parsed, x <> '' AND upper(x) = gold AS correct FROM l""")
def _(spark, sf):
    d = X.table(spark, sf, "documents")
    tail = F.when(F.col("doc_id") % 5 == 4, "").otherwise(F.concat(F.lit("Final answer is: **("), F.char(65 + F.col("doc_id") % 4), F.lit(")")))
    t = d.select("doc_id", F.concat("text", F.lit("\n"), tail).alias("text"), F.char(65 + F.col("doc_id") % 3).alias("gold"))
    return Q.letter_grade(t, "text", "gold").select("doc_id", "letter", "parsed", "correct")


@query("t20_self_check", """SELECT 'numeric' AS verification_method, count(*) AS records, I(0) AS failures FROM documents""")
def _(spark, sf):
    c = Q.self_check(X.graded_text(spark, sf).select("doc_id", "reference_answer"))
    return c.groupBy(F.col("verification.verification_method").alias("verification_method")).agg(
        F.count(F.lit(1)).alias("records"), F.sum((~F.col("verification.correct")).cast("long")).alias("failures"))


@query("t21_terminal_outcomes", """
SELECT finish_reason, correct, finish_reason = 'eos' AS normal_completion, finish_reason <> 'eos' AS noncompletion, NOT correct AND finish_reason = 'eos' AS wrong_completion,
 NOT correct OR finish_reason <> 'eos' AS needs_intervention, count(*) AS rows FROM attempts GROUP BY ALL""")
def _(spark, sf):
    rows = X.attempts(spark, sf)
    flags = Q.terminal_outcomes(F.col("correct"), F.col("finish_reason"))
    out = rows.select("finish_reason", "correct", *[c.alias(n) for n, c in flags.items()])
    return out.groupBy("finish_reason", "correct", *flags).agg(F.count(F.lit(1)).alias("rows"))


SURF = r"""sc AS (SELECT doc_id, lang, length(text) AS characters, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '-?\d+(?:\.\d+)?')) AS numbers,
  len(regexp_extract_all(text, '[+\-*/=<>]')) AS operators, len(regexp_extract_all(text, '=')) AS equations FROM documents)"""


@query("t14_surface_counts", f"WITH {SURF} SELECT doc_id, I(characters) AS characters, I(words) AS words, I(numbers) AS numbers, I(operators) AS operators, I(equations) AS equations FROM sc")
def _(spark, sf):
    return Q.surface_counts(X.table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query("tj3_surface_profile", f"""WITH {SURF}, w AS (SELECT lang, cast(characters AS double) AS characters, cast(words AS double) AS words, cast(numbers AS double) AS numbers, cast(operators AS double) AS operators, cast(equations AS double) AS equations FROM sc)
SELECT lang, metric, count(*) AS texts, R(avg(value)) AS mean, R(max(value)) AS max, R(quantile_cont(value, 0.25)) AS p25, R(quantile_cont(value, 0.5)) AS median, R(quantile_cont(value, 0.75)) AS p75
FROM (UNPIVOT w ON characters, words, numbers, operators, equations INTO NAME metric VALUE value) GROUP BY ALL""")
def _(spark, sf):
    return Q.surface_profile(X.table(spark, sf, "documents"), "text", "lang")


NORM = """dn AS (SELECT doc_id AS id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents),
 bn AS (SELECT item_id AS id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM benchmark)"""


def SH(src: str, name: str) -> str:
    return f"""{name} AS (SELECT DISTINCT id, unnest(CASE WHEN norm = '' THEN [] WHEN len(w) < 5 THEN [norm] ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS g
   FROM (SELECT id, norm, string_split(norm, ' ') AS w FROM {src}))"""


def overlap_sql(t: float, norm: str = NORM) -> str:
    return f"""WITH {norm}, {SH('dn', 'ds')}, {SH('bn', 'bs')}, dc AS (SELECT id, count(*) AS n FROM ds GROUP BY 1), bc AS (SELECT id, count(*) AS n FROM bs GROUP BY 1),
 ex AS (SELECT dn.id, min(bn.id) AS match_id FROM dn JOIN bn USING (norm) GROUP BY 1),
 pr AS (SELECT ds.id, bs.id AS b, count(*) AS o FROM ds JOIN bs USING (g) WHERE ds.id NOT IN (SELECT id FROM ex) GROUP BY ALL),
 j AS (SELECT pr.id, b, o/(dc.n + bc.n - o) AS s FROM pr JOIN dc ON dc.id = pr.id JOIN bc ON bc.id = b),
 bst AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, b) AS k FROM j WHERE s >= {t})
SELECT id, 'exact' AS reason, R(1) AS similarity, match_id FROM ex UNION ALL SELECT id, 'near', R(s), b FROM bst WHERE k = 1"""


def pair(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return d, X.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


@query("tj4_overlap_audit", overlap_sql(0.92))
def _(spark, sf):
    return Q.overlap_audit(*pair(spark, sf), 0.92)


# Documents that someone has labelled, against all the others: both kinds of overlap occur.
LABELLED = NORM.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))").replace("item_id AS id", "doc_id AS id").replace(
    "FROM benchmark)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")


@query("tj4_overlap_labelled", overlap_sql(0.92, LABELLED))
def _(spark, sf):
    d, seen = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), X.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return Q.overlap_audit(d.join(seen, "id", "left_semi"), d.join(seen, "id", "left_anti"), 0.92)


@query("tj4_overlap_audit_loose", overlap_sql(0.2))
def _(spark, sf):
    return Q.overlap_audit(*pair(spark, sf), 0.2)


@query("tj4_retained_corpus", "WITH a AS (" + overlap_sql(0.3) + ") SELECT doc_id AS id, I(length(text)) AS characters FROM documents WHERE doc_id NOT IN (SELECT id FROM a)")
def _(spark, sf):
    d, b = pair(spark, sf)
    return Q.retained(d, Q.overlap_audit(d, b, 0.3)).select("id", F.length("text").alias("characters"))


@query("t16_shingles", f"WITH {NORM}, {SH('bn', 'bs')} SELECT id, g AS shingle FROM bs")
def _(spark, sf):
    b = X.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.explode(Q.shingles(Q.normalised(F.col("text")))).alias("shingle"))


SEG = r"""rt AS (SELECT run_id, string_agg(token_text, '' ORDER BY token_index) AS t FROM token_text GROUP BY 1),
 mk AS (SELECT run_id, strpos(t, '</think>') - 1 AS c, strpos(t, '<think>') - 1 AS o, t FROM rt),
 bxs AS (SELECT *, CASE WHEN strpos(substr(t, (CASE WHEN c >= 0 THEN c + 8 ELSE 0 END) + 1), chr(92)||'boxed{') > 0 THEN (CASE WHEN c >= 0 THEN c + 8 ELSE 0 END) + strpos(substr(t, (CASE WHEN c >= 0 THEN c + 8 ELSE 0 END) + 1), chr(92)||'boxed{') - 1 END AS b FROM mk),
 of AS (SELECT *, sum(length(token_text)) OVER (PARTITION BY run_id ORDER BY token_index) AS e FROM token_text),
 sg AS (SELECT of.run_id, token_index, segment, CASE WHEN b IS NOT NULL AND e > b THEN 'final_answer'
   WHEN (o >= 0 AND e - length(token_text) < o + 7 AND e > o) OR (c >= 0 AND e - length(token_text) < c + 8 AND e > c) THEN 'special'
   WHEN e - length(token_text) >= CASE WHEN o >= 0 THEN o + 7 ELSE 0 END AND (c < 0 OR e - length(token_text) < c) THEN 'thinking' ELSE 'solution' END AS ns FROM of JOIN bxs USING (run_id))"""


@query("tj5_segments", f"WITH {SEG} SELECT run_id, token_index, ns AS new_segment FROM sg")
def _(spark, sf):
    from retrials.functions.lineage import materialize
    return Q.segment_tokens(materialize(X.token_text(spark, sf))).select("run_id", "token_index", "new_segment")


@query("tj5_segment_counts", f"WITH {SEG} SELECT run_id, ns AS new_segment, count(*) AS tokens FROM sg GROUP BY ALL")
def _(spark, sf):
    from retrials.functions.lineage import materialize
    s = Q.segment_tokens(materialize(X.token_text(spark, sf)), chunk=256)
    return s.groupBy("run_id", "new_segment").agg(F.count(F.lit(1)).alias("tokens"))


@query("t19_resegmentation", f"WITH {SEG} SELECT CASE WHEN run_id % 10 = 0 THEN 'skipped_budgeted' WHEN same THEN 'unchanged' ELSE 'changed' END AS action, count(*) AS runs FROM (SELECT run_id, bool_and(segment = ns) AS same FROM sg GROUP BY 1) GROUP BY 1")
def _(spark, sf):
    from retrials.functions.lineage import materialize
    return Q.segment_changes(Q.segment_tokens(materialize(X.token_text(spark, sf))), skip=F.col("run_id") % 10 == 0)


@query("p08_prefix_eligibility", """
WITH n AS (SELECT run_id, count(*) AS observed, string_agg(token_text, '' ORDER BY token_index) FILTER (token_index < 500) AS head FROM token_text GROUP BY 1),
 g AS (SELECT run_id, observed, CASE WHEN observed < 500 THEN 'reasoning_shorter_than_anchor' WHEN contains(head, chr(92)||'boxed{'||run_id||'}') THEN 'correct_answer_already_extractable_at_anchor' END AS r FROM n),
 e AS (SELECT run_id, row_number() OVER (PARTITION BY run_id % 2, run_id % 5 ORDER BY H('e:'||run_id) % 1000, run_id) AS k, count(*) OVER (PARTITION BY run_id % 2, run_id % 5) AS c FROM g WHERE r IS NULL)
SELECT g.run_id, observed, CASE WHEN r IS NOT NULL THEN 'ineligible' WHEN k <= c//2 THEN 'low' WHEN k > c - c//2 THEN 'high' ELSE 'unassigned' END AS stratum,
 CASE WHEN r IS NULL AND k > c//2 AND k <= c - c//2 THEN 'odd_cell_median_unassigned' ELSE r END AS exclusion_reason FROM g LEFT JOIN e USING (run_id)""")
def _(spark, sf):
    from retrials.functions.lineage import materialize
    t = materialize(X.token_text(spark, sf))
    ref = t.select("run_id").distinct().withColumn("reference_answer", F.col("run_id").cast("string"))
    e = materialize(Q.prefix_eligibility(t, ref, 500))
    score = e.where("eligible").select("run_id", (F.col("run_id") % 2).alias("m"), (F.col("run_id") % 5).alias("l"), (hash60("e:", F.col("run_id")) % 1000).alias("score"))
    strata = M.low_high_strata(score, ["m", "l"], "score", "run_id", "stratum").select("run_id", "stratum")
    odd = F.col("stratum") == "unassigned"
    return e.join(strata, "run_id", "left").select("run_id", "observed", F.coalesce("stratum", F.lit("ineligible")).alias("stratum"),
                                                   F.when(odd, "odd_cell_median_unassigned").otherwise(F.col("exclusion_reason")).alias("exclusion_reason"))
