"""The fixture views of ``fixtures.py`` as SQL text, for the side-by-side check."""

_LINE = (
    "'r:'||l_orderkey||':'||l_partkey||':'||l_suppkey||':'||l_linenumber||':'||I(l_quantity)||':'"
    "||I(round(l_extendedprice*100))||':'||I(round(l_discount*100))||':'||I(round(l_tax*100))"
)

VIEWS: dict[str, str] = {
    "attempts": f"""
  SELECT H({_LINE}) AS run_id, l_partkey AS problem_id, 'm_'||l_linestatus AS model_key,
    I(1 + p_size % 5) AS level, p_type AS category,
    CASE WHEN l_linenumber % 2 = 1 THEN 'math' ELSE 'gsm8k' END AS dataset,
    l_returnflag = 'R' AS correct, l_returnflag AS mode,
    CASE l_linenumber WHEN 7 THEN 'max_new_tokens' WHEN 6 THEN 'answer_reserve' ELSE 'eos' END AS finish_reason,
    I(l_quantity * 40) AS tokens, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "seeded": """
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY run_id) AS seed,
    row_number() OVER (PARTITION BY problem_id, model_key ORDER BY run_id) AS mseed
  FROM attempts""",
    "problems": """
  SELECT p_partkey AS problem_id, p_name AS problem, I(1 + p_size % 5) AS level, p_type AS category FROM part""",
    "problem_splits": """
  SELECT problem_id, level, CASE WHEN r <= round_even(n*0.6, 0) THEN 'train'
      WHEN r <= round_even(n*0.6, 0) + round_even(n*0.2, 0) THEN 'validation' ELSE 'test' END AS research_split
  FROM (SELECT problem_id, level,
          row_number() OVER (PARTITION BY level ORDER BY H('split:'||level||':'||problem_id), problem_id) AS r,
          count(*) OVER (PARTITION BY level) AS n FROM problems)""",
    "tokens0": """
  SELECT user_id AS run_id, user_id // 5 AS problem_id, 'm'||(user_id % 2) AS model_key,
    user_id % 3 = 0 AS correct, I(1 + user_id % 5) AS level, value AS s1,
    cast(json_extract(props, '$.k') AS double) AS s2,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS token_index,
    count(*) OVER (PARTITION BY user_id) AS n_tokens
  FROM events""",
    "tokens": """
  SELECT *, abs(s1 - lag(s1) OVER (PARTITION BY run_id ORDER BY token_index)) AS s3,
    CASE WHEN run_id % 7 = 0 OR token_index >= n_tokens - 5 THEN 'solution' ELSE 'thinking' END AS segment
  FROM tokens0""",
    # Analysis window: thinking rows when a run has any, else its solution rows.
    "scoped": """
  SELECT run_id, problem_id, model_key, correct, level, token_index, s1, s2, s3,
    row_number() OVER (PARTITION BY run_id ORDER BY token_index) AS rn,
    count(*) OVER (PARTITION BY run_id) AS n
  FROM (SELECT *, max(CASE WHEN segment='thinking' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id) AS any_t FROM tokens)
  WHERE segment = CASE WHEN any_t = 1 THEN 'thinking' ELSE 'solution' END""",
    "prefixes": "SELECT unnest([8, 16, 32, 48, 64]) AS p",
    "cut": "SELECT scoped.*, I(p) AS prefix_length FROM scoped JOIN prefixes ON rn <= p AND n >= p",
    "probes": """
  SELECT l_partkey AS run_id, l_partkey // 2 AS problem_id, 'm'||(l_partkey % 2) AS model_key,
    I(64 * power(2, l_linenumber - 1)) AS anchor,
    I(sum(CASE WHEN l_quantity <= 7*l_linenumber THEN 1 ELSE 0 END)) AS successes, count(*) AS continuations
  FROM lineitem GROUP BY ALL""",
    "base_probes": """
  SELECT l_partkey AS run_id, l_partkey // 2 AS problem_id, 'm'||(l_partkey % 2) AS model_key,
    I(64 * power(2, l_linenumber - 1)) AS anchor,
    I(sum(CASE WHEN l_quantity <= 7*l_linenumber THEN 1 ELSE 0 END)) AS successes, count(*) AS continuations
  FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL""",
    "extra_probes": """
  SELECT l_partkey AS run_id, l_partkey // 2 AS problem_id, 'm'||(l_partkey % 2) AS model_key,
    I(64 * power(2, l_linenumber - 1)) AS anchor,
    I(sum(CASE WHEN l_quantity <= 7*l_linenumber THEN 1 ELSE 0 END)) AS successes, count(*) AS continuations
  FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY ALL""",
    "restarts": """
  SELECT l_partkey AS run_id, l_partkey // 2 AS problem_id, 'm'||(l_partkey % 2) AS model_key,
    I(512 * power(2, l_linenumber)) AS budget,
    I(sum(CASE WHEN round(l_tax*100) <= 2*l_linenumber - 1 THEN 1 ELSE 0 END)) AS successes, count(*) AS attempts,
    sum(CASE WHEN round(l_tax*100) <= 2*l_linenumber - 1 THEN 1 ELSE 0 END) / count(*) AS rate
  FROM lineitem GROUP BY ALL""",
    # Stable-crossing label per run at threshold 0.75.
    "ladder": """
  SELECT *, successes / continuations AS rate,
    lead(successes / continuations) OVER w AS next_rate, lead(anchor) OVER w AS next_anchor,
    coalesce(lag(anchor) OVER w, 0) AS prev_anchor
  FROM probes WINDOW w AS (PARTITION BY run_id ORDER BY anchor)""",
    "labels_at": """
  SELECT run_id, problem_id, model_key, tau, max(anchor) AS last_anchor,
    min(CASE WHEN rate >= tau AND next_rate >= tau THEN anchor END) AS hit
  FROM ladder, (SELECT unnest([0.5, 0.75, 1.0]) AS tau) GROUP BY ALL""",
    "event_labels": """
  SELECT l.run_id, l.problem_id, l.model_key, hit IS NOT NULL AS event_observed,
    CASE WHEN hit IS NULL THEN last_anchor ELSE prev_anchor END AS interval_lower, hit AS interval_upper,
    hit AS event_time_proxy, CASE WHEN hit IS NULL THEN last_anchor ELSE next_anchor END AS censoring_time,
    hit AS stable_anchor, next_anchor AS stability_anchor
  FROM (SELECT * FROM labels_at WHERE tau = 0.75) l LEFT JOIN ladder d ON d.run_id = l.run_id AND d.anchor = l.hit""",
    "panel": """
  SELECT run_id, list(budget ORDER BY budget) AS bs, list(rate ORDER BY budget) AS rs FROM restarts GROUP BY run_id""",
    "brackets": """
  SELECT run_id, budget AS lo, rate AS r_lo, lead(budget) OVER w AS hi, lead(rate) OVER w AS r_hi,
    min(budget) OVER (PARTITION BY run_id) AS b0, max(budget) OVER (PARTITION BY run_id) AS b1
  FROM restarts WINDOW w AS (PARTITION BY run_id ORDER BY budget)""",
    "advantage": """
  SELECT p.run_id, p.problem_id, p.model_key, p.anchor, p.successes / p.continuations AS rate,
    CASE WHEN p.anchor + 1024 <= b0 OR p.anchor + 1024 >= b1 THEN r_lo
      ELSE r_lo + (log2(p.anchor + 1024) - log2(lo)) / (log2(hi) - log2(lo)) * (r_hi - r_lo) END AS r_hat,
    CASE WHEN p.anchor + 1024 <= b0 OR p.anchor + 1024 >= b1 THEN r_lo ELSE greatest(r_lo, r_hi) END AS r_cons
  FROM probes p JOIN brackets b ON b.run_id = p.run_id AND (
    (p.anchor + 1024 <= b0 AND lo = b0) OR (p.anchor + 1024 >= b1 AND p.anchor + 1024 > b0 AND lo = b1)
    OR (p.anchor + 1024 > b0 AND p.anchor + 1024 < b1 AND lo < p.anchor + 1024 AND p.anchor + 1024 <= hi))""",
    "vectors": """
  SELECT label * 10 + vec_id % 5 AS run_id, label AS problem_id, vec_id, embedding AS vec,
    (vec_id * 7) % 3 = 0 AS correct,
    row_number() OVER (PARTITION BY label * 10 + vec_id % 5 ORDER BY vec_id) - 1 AS token_index
  FROM embeddings""",
    "graded_text": """
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'math' ELSE 'gsm8k' END AS dataset,
    cast(n_chars AS varchar) AS reference_answer, source AS problem_id,
    CASE doc_id % 3 WHEN 0 THEN '<think>'||text||'</think>' WHEN 1 THEN '[THINK]'||text||'[/THINK]' ELSE text END
    || chr(10) || CASE doc_id % 5 WHEN 0 THEN chr(92)||'boxed{'||(n_chars + doc_id % 2)||'}'
      WHEN 1 THEN '#### '||(n_chars + doc_id % 2) WHEN 2 THEN 'final answer is '||(n_chars + doc_id % 2)
      WHEN 3 THEN 'answer: '||(n_chars + doc_id % 2) ELSE '' END AS text
  FROM documents""",
    "spoken": """
  SELECT conv_id, 2*turn + 1 AS part, i AS pos, word || ' ' AS token_text FROM (
    SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i
    FROM conversations) WHERE word <> ''
  UNION ALL SELECT DISTINCT conv_id, -1, 0, '<think>' FROM conversations
  UNION ALL SELECT conv_id, 2*max(turn), 0, CASE WHEN conv_id % 2 = 0 THEN '</th' ELSE '</think>' END FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, 2*max(turn), 1, 'ink>' FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id
  UNION ALL SELECT conv_id, 2*max(turn) + 3, 0, chr(92)||'boxed{'||conv_id||'}' FROM conversations GROUP BY conv_id""",
    "token_text": """
  SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) - 1 AS token_index, token_text,
    CASE WHEN part < 1 THEN 'thinking' ELSE 'solution' END AS segment
  FROM spoken""",
    "predictions": """
  SELECT d.doc_id AS run_id, source AS problem_id, lang AS model_key, quality AS y,
    least(1.0, n_chars / 4000) AS p1, H('p2:'||d.doc_id) % 1000 / 1000 AS p2,
    least(10, (n_chars + 200) // 400) / 10 AS p3,
    CASE WHEN d.doc_id % 5 < 3 THEN 'train' WHEN d.doc_id % 5 = 3 THEN 'validation' ELSE 'test' END AS research_split
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "arm_rows": """
  SELECT l_partkey AS problem_id, l_returnflag, l_linestatus = 'F' AS f, l_quantity AS q,
    row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY H(""" + _LINE + """)) AS branch_index
  FROM lineitem""",
    "arms0": """
  SELECT problem_id, branch_index, problem_id * 1000 + branch_index AS source_run_id, 'm'||(problem_id % 2) AS model_key,
    bool_or(f AND q > 25) FILTER (l_returnflag = 'A') AS short_correct,
    bool_or(f OR q > 40) FILTER (l_returnflag = 'N') AS medium_correct,
    bool_or(f OR q > 20) FILTER (l_returnflag = 'R') AS long_correct,
    I(max(q) FILTER (l_returnflag = 'A')) AS short_tokens, I(4 * max(q) FILTER (l_returnflag = 'N')) AS medium_tokens,
    I(24 * max(q) FILTER (l_returnflag = 'R')) AS long_tokens,
    H('s:'||problem_id||':'||branch_index) % 1000 / 1000 AS uncertainty_score
  FROM arm_rows GROUP BY problem_id, branch_index HAVING count(DISTINCT l_returnflag) = 3""",
    "arms": """
  SELECT a.*, CASE WHEN r <= n // 2 THEN 'low' WHEN r > n - n // 2 THEN 'high' ELSE 'unassigned' END AS uncertainty_stratum
  FROM (SELECT arms0.*, level, row_number() OVER (PARTITION BY model_key, level ORDER BY uncertainty_score, source_run_id) AS r,
      count(*) OVER (PARTITION BY model_key, level) AS n
    FROM arms0 JOIN problems USING (problem_id)) a""",
}
