"""Text rules as column expressions, and the five table-to-table text jobs built on them."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrials.functions.keys import problem_identity
from retrials.functions.lineage import materialize
from retrials.functions.numeric import count_where, rate
from retrials.functions.ordered import index_bucket, quantiles, running_sum
from retrials.operators.aggregates import melt
from retrials.operators.contracts import require_all

# Reasoning markers (opener, closer, name of the boundary) and answer markers.
REASONING = (("<think>", "</think>", "think_tag"), ("[THINK]", "[/THINK]", "mistral_think_tag"), ("<|channel>thought", "<channel|>", "gemma_thought_channel"))
BOXES = ("\\boxed{", "\\fbox{")
# Answer patterns, later ones tried only when the earlier find nothing.
HASH_ANSWER = r"(?U)####\s*([^\n]+)"
TEXT_ANSWERS = (r"(?iU)final\s+answer\s*(?:is|:)\s*([^\n]+)", r"(?iU)answer\s*(?:is|:)\s*([^\n]+)")
LETTER_ANSWER = r"(?i)final answer is\s*:?\s*\**\(?([A-D])\)?"
# What a plain answer loses, and the forms of a number.
OUTER_DOLLARS, WRAPPER, END_MARKS = r"^\$+|\$+$", r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}", r"[.,;]+$"
FRACTION = r"^(-?\d+(?:\.\d+)?)/(-?\d+(?:\.\d+)?)$"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|^[+-]?(?i:inf(?:inity)?|nan)$"
# Finish reasons.
NORMAL_FINISH = ("eos",)
FORCED_FINISH = ("max_new_tokens", "answer_reserve")

# What the surface of a text is counted by.
SURFACE_PATTERNS = {"words": r"\S+", "numbers": r"-?\d+(?:\.\d+)?", "operators": r"[+\-*/=<>]", "equations": "="}

OPENERS, CLOSERS = tuple(o for o, _, _ in REASONING), tuple(c for _, c, _ in REASONING)
_MARK = re.compile(r"\\boxed\{|\\fbox\{|[{}]")


def balanced_boxes(text: str) -> list[str]:
    """Outermost closed boxed contents of one text, in order; an unclosed box hides nothing."""
    stack, spans = [], []
    for m in _MARK.finditer(text):
        if m.group() == "}":
            if stack:
                start, inner = stack.pop()
                if start is not None:
                    spans.append((start, inner, m.start()))
        else:
            stack.append((m.start() if len(m.group()) > 1 else None, m.end()))
    spans.sort()
    out, reach = [], -1
    for start, inner, end in spans:
        if start > reach:
            out.append(text[inner:end].strip())
            reach = end
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _boxes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else balanced_boxes(t))


def boxed_answers(text: Column) -> Column:
    """All balanced boxed contents; only texts with a marker travel to Python."""
    has = F.contains(text, F.lit(BOXES[0])) | F.contains(text, F.lit(BOXES[1]))
    return _boxes(F.when(has, text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))


def final_answer(text: Column, boxes: Column) -> Column:
    """Struct (answer, status): last box, last '####' line, then the two text markers."""
    options = [(F.try_element_at(boxes, F.lit(-1)), "boxed"), (strip(_last(text, HASH_ANSWER)), "gsm_marker")]
    options += [(strip(_last(text, p)), "text_marker") for p in TEXT_ANSWERS]
    picks = [F.when(a.isNotNull(), F.struct(a.alias("answer"), F.lit(s).alias("status"))) for a, s in options]
    missing = F.struct(F.lit(None).cast("string").alias("answer"), F.lit("missing").alias("status"))
    return F.coalesce(*picks, missing)


def _last_index(text: Column, marker: str) -> Column:
    """0-based start of the last occurrence, -1 when absent."""
    at = F.locate(marker[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - len(marker) - (at - 1)).otherwise(F.lit(-1))


def _drop_first(text: Column, marker: str) -> Column:
    at = F.locate(marker, text)
    cut = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + len(marker)))
    return F.when(at > 0, cut).otherwise(text)


def split_reasoning(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds reasoning, final_part and boundary: cut at the last closing marker, else the last box."""
    t = F.col(text)
    staged = df.withColumns({f"__c{k}": _last_index(t, m) for k, (_, m, _) in enumerate(REASONING)})
    staged = staged.withColumn("__box", F.greatest(*[_last_index(t, m) for m in BOXES]))
    best = F.greatest(*[F.col(f"__c{k}") for k in range(len(REASONING))])
    reasoning = final = status = None
    for k, (o, c, name) in enumerate(REASONING):
        here = (best >= 0) & (F.col(f"__c{k}") == best)
        head = _drop_first(F.substr(t, F.lit(1), best), o)
        tail = F.substr(t, best + 1 + len(c))
        reasoning = F.when(here, head) if reasoning is None else reasoning.when(here, head)
        final = F.when(here, tail) if final is None else final.when(here, tail)
        status = F.when(here, name) if status is None else status.when(here, name)
    box = F.col("__box")
    reasoning = reasoning.when(box >= 0, F.substr(t, F.lit(1), box)).otherwise(t)
    final = final.when(box >= 0, F.substr(t, box + 1)).otherwise(F.lit(""))
    status = status.when(box >= 0, "boxed_boundary").otherwise("unknown")
    return staged.select(*df.columns, strip(reasoning).alias("reasoning"), strip(final).alias("final_part"), status.alias("boundary"))


def plain_answer(value: Column) -> Column:
    """Answer without dollar signs, text wrappers, thin spaces, blanks and trailing marks."""
    v = F.regexp_replace(strip(value), OUTER_DOLLARS, "")
    v = F.regexp_replace(v, WRAPPER, "$1")
    v = F.replace(F.replace(v, F.lit("\\,"), F.lit("")), F.lit(" "), F.lit(""))
    return F.regexp_replace(v, END_MARKS, "")


def numeric_value(value: Column) -> Column:
    """Number, percentage or fraction as double; NULL when it is none or divides by zero."""
    v = F.replace(F.replace(plain_answer(value), F.lit(","), F.lit("")), F.lit("\\%"), F.lit("%"))
    percent = F.endswith(v, F.lit("%"))
    v = F.when(percent, F.substr(v, F.lit(1), F.length(v) - 1)).otherwise(v)
    parts = F.try_divide(F.regexp_extract(v, FRACTION, 1).try_cast("double"), F.regexp_extract(v, FRACTION, 2).try_cast("double"))
    x = F.when(v.rlike(FRACTION), parts).when(v.rlike(NUMBER), v.try_cast("double"))
    return F.when(percent, x / 100).otherwise(x)


def numbers_equal(a: Column, b: Column) -> Column:
    """Equality within 1e-9, relative or absolute; NULL if either is NULL, NaN equals nothing."""
    close = F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a) | F.isnan(b), False).otherwise((a == b) | close)


def grade(df: DataFrame, text: str = "text", reference: str = "reference_answer") -> DataFrame:
    """Adds the verification struct: missing, then numeric, then normalised-string comparison."""
    staged = df.withColumn("__boxes", boxed_answers(F.col(text)))
    staged = staged.withColumn("__a", final_answer(F.col(text), F.col("__boxes")))
    answer, ref = F.col("__a.answer"), F.col(reference)
    staged = staged.withColumn("__num", numbers_equal(numeric_value(answer), numeric_value(ref)))
    num = F.col("__num")
    correct = F.when(answer.isNull(), False).when(num.isNotNull(), num).otherwise(plain_answer(answer) == plain_answer(ref))
    method = F.when(answer.isNull(), "missing_answer").when(num.isNotNull(), "numeric").otherwise("normalized_string")
    verdict = F.struct(
        F.coalesce(correct, F.lit(False)).alias("correct"), answer.alias("predicted_answer"), ref.alias("reference_answer"),
        F.col("__a.status").alias("extraction_status"), method.alias("verification_method"), F.lit(None).cast("string").alias("error"),
    )
    return staged.select(*df.columns, verdict.alias("verification"))


def grade_summary(graded: DataFrame, groups: Sequence[str]) -> DataFrame:
    v = "verification."
    return graded.groupBy(*groups, F.col(v + "extraction_status").alias("extraction_status"), F.col(v + "verification_method").alias("verification_method")).agg(
        F.count(F.lit(1)).alias("attempts"), count_where(F.col(v + "correct")).alias("correct"), rate(F.col(v + "correct")).alias("accuracy")
    )


def letter_grade(df: DataFrame, text: str, reference: str) -> DataFrame:
    """Multiple choice: the first letter named in the last 500 characters; none is incorrect."""
    letter = F.upper(F.regexp_extract(F.right(F.col(text), F.lit(500)), LETTER_ANSWER, 1))
    parsed = letter != ""
    return df.select("*", F.when(parsed, letter).alias("letter"), parsed.alias("parsed"), (parsed & (letter == F.upper(F.col(reference)))).alias("correct"))


def self_check(problems: DataFrame) -> DataFrame:
    """Grade every reference answer against itself."""
    shown = F.concat(F.lit("Final answer: \\boxed{"), F.col("reference_answer"), F.lit("}"))
    return grade(problems.withColumn("__t", shown), "__t").drop("__t")


def terminal_outcomes(correct: Column, finish: Column) -> dict[str, Column]:
    """Endpoint flags; an unknown finish reason is an error, never a default."""
    known = finish.isin(*NORMAL_FINISH, *FORCED_FINISH)
    forced = F.when(known, finish.isin(*FORCED_FINISH)).otherwise(F.raise_error(F.concat(F.lit("unknown finish_reason: "), finish)).cast("boolean"))
    return {"normal_completion": ~forced, "noncompletion": forced, "wrong_completion": ~correct & ~forced,
            "needs_intervention": ~correct | forced}


def surface_counts(df: DataFrame, text: str) -> DataFrame:
    """Characters, whitespace tokens, numbers, operators and equality signs."""
    t = F.col(text)
    return df.select(
        "*", F.length(t).cast("long").alias("characters"), *[F.regexp_count(t, F.lit(p)).cast("long").alias(n) for n, p in SURFACE_PATTERNS.items()])


SURFACE = ("characters", "words", "numbers", "operators", "equations")


def surface_profile(df: DataFrame, text: str, group: str) -> DataFrame:
    """Distribution of every surface count by group."""
    long = melt(surface_counts(df.select(group, text), text), [group], SURFACE)
    base = long.groupBy(group, "metric").agg(F.count(F.lit(1)).alias("texts"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return base.join(quantiles(long, [group, "metric"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}), [group, "metric"])


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def shingles(norm: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` tokens; a shorter text is one shingle, an empty one none."""
    words = F.filter(F.split(norm, " "), lambda w: w != "")

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(many)

    # Bound to a lambda variable the words are split once per text, not once per shingle.
    return F.array_distinct(F.get(F.transform(F.array(words), runs), 0))


def _sets(norm: Column) -> Column:
    """Hashes of a normalised text's shingles."""
    return F.transform(shingles(norm), lambda x: F.xxhash64(x))


def _rare_first(sets: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """(rid, n, key) for the rarest shingles of each set, enough to meet any partner at ``threshold``.

    Two sets with Jaccard >= t share an element among the first n - ceil(t*n) + 1 of each
    in any common order.  Shingles that only one side has come first and pair with nothing, then the ``common``
    ones by rarity, so that boilerplate stays out of those prefixes; a set whose prefix is full before is dropped.
    """
    hits = sets.select("rid", F.explode("s").alias("key")).join(common, "key").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("o"))
    size = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    left = (F.greatest(size, F.lit(1)) - (F.col("n") - F.size("o"))).cast("int")
    ranked = hits.join(sets.select("rid", "n"), "rid").withColumn("p", left).where("p > 0")
    return ranked.select("rid", "n", F.explode(F.slice("o", F.lit(1), F.col("p"))).alias("p")).select("rid", "n", F.col("p.key").alias("key"))


def _of_size(sets: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """The sets that are neither too small nor too large for every one of the ``other`` ones."""
    ends = other.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return sets.where((F.col("n") >= ends.select("lo").scalar() * threshold - 1e-9) & (F.col("n") * threshold - 1e-9 <= ends.select("hi").scalar()))


def _near_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) for all pairs of (id, s, n) rows with Jaccard >= threshold."""
    b = materialize(right.withColumn("rid", F.monotonically_increasing_id()))
    a = materialize(_of_size(left, b, threshold).withColumn("rid", F.monotonically_increasing_id()))
    b = _of_size(b, a, threshold)
    known = materialize(b.select(F.explode("s").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("fb")))
    # of the left side's shingles only those that the right side has are counted; a short list of them is broadcast by Spark itself
    seen = a.select(F.explode("s").alias("key")).join(known.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("fa"))
    common = materialize(seen.join(known, "key").select("key", (F.col("fa") + F.col("fb")).alias("f")))
    pa = _rare_first(a, common, threshold).select(F.col("rid").alias("a_rid"), F.col("n").alias("ln"), "key")
    pb = _rare_first(b, common, threshold).select(F.col("rid").alias("b_rid"), F.col("n").alias("rn"), "key")
    size_ok = (F.least("ln", "rn") >= F.greatest("ln", "rn") * threshold - 1e-9)
    pairs = materialize(pa.join(pb, "key").where(size_ok).select("a_rid", "b_rid").distinct())

    def paired(sets: DataFrame, rid: str, ident: str, s: str) -> DataFrame:
        """Only sets in a pair are shuffled on."""
        return sets.join(pairs.select(F.col(rid).alias("rid")).distinct(), "rid", "left_semi").select(F.col("rid").alias(rid), F.col("id").alias(ident), F.col("s").alias(s))

    full = pairs.join(paired(a, "a_rid", "left_id", "ls"), "a_rid").join(paired(b, "b_rid", "right_id", "rs"), "b_rid")
    shared = F.size(F.array_intersect("ls", "rs"))
    j = shared / (F.size("ls") + F.size("rs") - shared)
    return full.select("left_id", "right_id", j.alias("similarity")).where(F.col("similarity") >= threshold)


def near_matches(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) for all pairs of (id, norm) rows with Jaccard >= threshold."""
    def sets(df: DataFrame) -> DataFrame:
        return df.select("id", _sets(F.col("norm")).alias("s")).withColumn("n", F.size("s")).where("n > 0")

    return _near_sets(sets(left), sets(right), threshold)


def overlap_audit(corpus: DataFrame, against: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Rows of ``corpus`` (id, text) that repeat ``against``: reason, similarity and best match.

    Copies of one normalised text are collapsed before any pairing and fanned out at the end; texts of a size that
    nothing in ``against`` can match are not shuffled.
    """
    def read(df: DataFrame) -> DataFrame:
        norm = df.select("id", normalised(F.col("text")).alias("norm"))
        return materialize(norm.select("id", F.sha2("norm", 256).alias("k"), _sets(F.col("norm")).alias("s")).withColumn("n", F.size("s")))

    own, ref = read(corpus), read(against)
    known = materialize(ref.groupBy("k").agg(F.min("id").alias("match_id")))
    exact = own.select("id", "k").join(known, "k").select("id", F.lit("exact").alias("reason"), F.lit(1.0).alias("similarity"), "match_id")
    refs = materialize(ref.where("n > 0").groupBy("k").agg(F.min("id").alias("id"), F.first("s").alias("s"), F.first("n").alias("n")).drop("k"))
    rest = _of_size(own.where("n > 0"), refs, threshold).join(known, "k", "left_anti")
    texts = rest.groupBy("k").agg(F.first("s").alias("s"), F.first("n").alias("n")).withColumnRenamed("k", "id")
    found = _near_sets(texts, refs, threshold)
    best = materialize(found.groupBy("left_id").agg(F.max(F.struct("similarity", (-F.col("right_id")).alias("r"))).alias("m")))
    near = own.select("id", "k").join(best, F.col("k") == F.col("left_id")).select(
        "id", F.lit("near").alias("reason"), F.col("m.similarity").alias("similarity"), (-F.col("m.r")).alias("match_id")
    )
    return exact.unionByName(near)


def retained(corpus: DataFrame, audit: DataFrame) -> DataFrame:
    return corpus.join(audit.select("id"), "id", "left_anti")


def _first_at(text: Column, markers: Sequence[str], start: Column) -> Column:
    """Struct (at, len) of the earliest marker at or after 1-based ``start`` in a piece, NULL if none."""
    hits = []
    for m in markers:
        p = F.call_function("locate", F.lit(m), text, start)
        hits.append(F.when(p > 0, F.struct(p.cast("long").alias("at"), F.lit(len(m)).cast("long").alias("len"))))
    return F.array_min(F.array_compact(F.array(*hits)))


def segment_tokens(tokens: DataFrame, reasoning: bool = True, chunk: int = 4096) -> DataFrame:
    """Relabel tokens as thinking, solution, final_answer or special from their joined text.

    Markers may straddle tokens.  Instead of joining a whole run into one string, each run is
    cut into overlapping character pieces of bounded size; the first marker of a run is the
    minimum over its pieces.
    """
    size = F.length("token_text").cast("long")
    placed = running_sum(tokens.withColumn("__len", size), ["run_id"], ["token_index"], {"__end": F.col("__len")}, bucket=index_bucket("token_index"))
    placed = placed.withColumn("__start", F.col("__end") - F.col("__len"))
    halo = max(len(m) for m in (*OPENERS, *CLOSERS, *BOXES)) - 1
    c = F.lit(chunk)
    low = F.greatest(F.floor((F.col("__start") - halo) / c), F.lit(0).cast("long"))
    fan = placed.where("__len > 0").select(
        "run_id", "token_index", "token_text", "__start", "__end",
        F.explode(F.sequence(low, F.floor((F.col("__end") - 1) / c))).alias("piece"),
    )
    base = F.col("piece") * c
    first = F.greatest(base - F.col("__start"), F.lit(0).cast("long"))
    last = F.least(F.col("__end"), base + chunk + halo) - F.col("__start")
    part = F.substr(F.col("token_text"), (first + 1).cast("int"), (last - first).cast("int"))
    pieces = materialize(fan.where(last > first).groupBy("run_id", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_index", part.alias("x")))), lambda s: s.x), "").alias("text")
    ))

    def earliest(markers: Sequence[str], rows: DataFrame, start: Column, name: str) -> DataFrame:
        hit = _first_at(F.col("text"), markers, start)
        own = rows.select("run_id", "piece", hit.alias("h")).where(F.col("h.at") <= chunk)
        at = F.col("piece") * chunk + F.col("h.at") - 1
        return own.groupBy("run_id").agg(F.min(F.struct(at.alias("at"), F.col("h.len").alias("len"))).alias(name))

    one = F.lit(1)
    runs = tokens.select("run_id").distinct()
    spans = runs.join(earliest(CLOSERS, pieces, one, "c"), "run_id", "left").join(earliest(OPENERS, pieces, one, "o"), "run_id", "left")
    after = F.coalesce(F.col("c.at") + F.col("c.len"), F.lit(0)) if reasoning else F.lit(0)
    spans = materialize(spans.withColumn("after", after.cast("long")))
    shifted = pieces.join(spans.select("run_id", "after"), "run_id").where(F.col("piece") * chunk + chunk > F.col("after"))
    begin = F.greatest(F.col("after") - F.col("piece") * chunk + 1, F.lit(1).cast("long")).cast("int")
    spans = spans.join(earliest(BOXES, shifted, begin, "b"), "run_id", "left")

    rows = placed.join(spans, "run_id")
    s, e = F.col("__start"), F.col("__end")

    def touches(span: str) -> Column:
        return F.coalesce((s < F.col(f"{span}.at") + F.col(f"{span}.len")) & (e > F.col(f"{span}.at")), F.lit(False))

    # The first token reaching past the box starts the final answer; later tokens follow by offset.
    final = F.coalesce(e > F.col("b.at"), F.lit(False))
    if reasoning:
        begin_think = F.coalesce(F.col("o.at") + F.col("o.len"), F.lit(0))
        thinking = (s >= begin_think) & (F.col("c.at").isNull() | (s < F.col("c.at")))
        special = touches("o") | touches("c")
    else:
        thinking = special = F.lit(False)
    label = F.when(final, "final_answer").when(special, "special").when(thinking, "thinking").otherwise("solution")
    return rows.select(*tokens.columns, label.alias("new_segment"))


def segment_changes(relabelled: DataFrame, skip: Column | None = None) -> DataFrame:
    """Runs by action: skipped, changed or unchanged."""
    same = F.col("segment").eqNullSafe(F.col("new_segment"))
    per = relabelled.groupBy("run_id").agg(F.bool_and(same).alias("same"))
    action = F.when(F.col("same"), "unchanged").otherwise("changed")
    if skip is not None:
        action = F.when(skip, "skipped_budgeted").otherwise(action)
    return per.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("runs"))


def canonical_word_problems(raw: DataFrame, dataset: str, repository: str, split: str) -> DataFrame:
    """Question/answer records: the reference answer follows the last '####'; none is an error."""
    solution = strip(F.col("answer"))
    rows = require_all(raw, F.contains(F.col("answer"), F.lit("####")), "reference answer is missing the #### marker")
    return _canonical(rows, dataset, repository, split, strip(F.col("question")), strip(F.element_at(F.split(solution, "####"), -1)),
                      solution, F.lit(None).cast("long"), F.lit(None).cast("string"))


def canonical_math_problems(raw: DataFrame, dataset: str, repository: str, split: str) -> DataFrame:
    """Problem/solution records: the given answer, else the last box of the solution."""
    given = F.nullif(F.col("answer"), F.lit(""))
    boxed = F.try_element_at(boxed_answers(F.col("solution")), F.lit(-1))
    staged = raw.withColumn("__ref", F.coalesce(strip(given), boxed))
    rows = require_all(staged, F.col("__ref").isNotNull(), "reference solution has no boxed answer")
    level = F.regexp_extract(F.col("level").cast("string"), "([1-5])", 1)
    return _canonical(rows, dataset, repository, split, strip(F.col("problem")), F.col("__ref"), strip(F.col("solution")),
                      F.nullif(level, F.lit("")).cast("long"), F.nullif(strip(F.col("type")), F.lit("")))


def canonical_contest_problems(raw: DataFrame, dataset: str, repository: str, split: str, levels: int = 6) -> DataFrame:
    """Contest records: complete fields required, first non-empty solution_n, identity over the source."""
    p, a, subject = strip(F.col("problem")), strip(F.col("answer")), strip(F.col("subject"))
    ok = (p != "") & (a != "") & F.col("level").between(1, levels) & (subject != "")
    rows = require_all(raw, ok, "contest record misses problem, answer, level or subject")
    columns = sorted(c for c in raw.columns if re.fullmatch(r"solution_\d+", c))
    solution = F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in columns], F.lit(""))
    source = F.concat_ws("|", F.col("year").cast("string"), "contest", F.col("number").cast("string"), p)
    ident = problem_identity(F.lit(dataset), F.col("source_index"), source)
    return _canonical(rows, dataset, repository, split, p, a, solution, F.col("level").cast("long"), subject, ident).withColumn(
        "research_split", F.lit("external_test")
    )


def _canonical(rows, dataset, repository, split, problem, reference, solution, level, category, ident=None) -> DataFrame:
    ident = problem_identity(F.lit(dataset), F.col("source_index"), problem) if ident is None else ident
    return rows.select(
        ident.alias("problem_id"), F.lit(dataset).alias("dataset"), F.lit(repository).alias("source_repository"),
        F.lit(split).alias("source_split"), F.col("source_index").cast("long").alias("source_index"), problem.alias("problem"),
        reference.alias("reference_answer"), solution.alias("reference_solution"), level.alias("level"), category.alias("category"),
    )


def corpus_counts(problems: DataFrame) -> DataFrame:
    return problems.groupBy("dataset", "level", "category").agg(F.count(F.lit(1)).alias("problems"), F.countDistinct("problem_id").alias("ids"))


def prefix_eligibility(tokens: DataFrame, references: DataFrame, anchor: int) -> DataFrame:
    """Why a run may not be extended at the anchor: too short, or its answer already shows."""
    sizes = tokens.groupBy("run_id").agg(F.count(F.lit(1)).alias("observed"))
    head = tokens.where(F.col("token_index") < anchor).groupBy("run_id").agg(   # at most ``anchor`` tokens per run
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_index", "token_text"))), lambda s: s.token_text), "").alias("head")
    )
    graded = grade(sizes.join(head, "run_id").join(references, "run_id"), "head")
    reason = (
        F.when(F.col("observed") < anchor, "reasoning_shorter_than_anchor")
        .when(F.col("verification.correct"), "correct_answer_already_extractable_at_anchor")
    )
    return graded.select(*[c for c in graded.columns if c not in ("head", "verification")], reason.alias("exclusion_reason"), reason.isNull().alias("eligible"))
