"""Bindings of the given tables to the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrials.functions.keys import hash60
from retrials.functions.ordered import position, with_previous
from retrials.operators import sampling

PREFIXES = (8, 16, 32, 48, 64)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


def _line_id():
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    values = [F.col(p) for p in parts] + [
        F.col("l_quantity").cast("long"), _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax"),
    ]
    text = [F.lit("r")]
    for v in values:
        text += [F.lit(":"), v]
    return hash60(*text)


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per attempt: each line of a part is one attempt at that part."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        _line_id().alias("run_id"),
        F.col("l_partkey").alias("problem_id"),
        F.concat(F.lit("m_"), "l_linestatus").alias("model_key"),
        (F.lit(1) + F.col("p_size") % 5).cast("long").alias("level"),
        F.col("p_type").alias("category"),
        F.when(F.col("l_linenumber") % 2 == 1, "math").otherwise("gsm8k").alias("dataset"),
        (F.col("l_returnflag") == "R").alias("correct"),
        F.col("l_returnflag").alias("mode"),
        F.when(F.col("l_linenumber") == 7, "max_new_tokens")
        .when(F.col("l_linenumber") == 6, "answer_reserve").otherwise("eos").alias("finish_reason"),
        (F.col("l_quantity") * 40).cast("long").alias("tokens"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def seeded(spark: SparkSession, sf: str, mseed: bool = False) -> DataFrame:
    """Attempts with an ordinal seed per problem, optionally also per (problem, model)."""
    rows = position(attempts(spark, sf), ["problem_id"], ["run_id"], "seed", hashed=True)
    return position(rows, ["problem_id", "model_key"], ["run_id"], "mseed", hashed=True) if mseed else rows


def problems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("problem_id"), F.col("p_name").alias("problem"),
        (F.lit(1) + F.col("p_size") % 5).cast("long").alias("level"), F.col("p_type").alias("category"),
    )


def problem_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = problems(spark, sf).select("problem_id", "level")
    return sampling.split_by_problem(rows, "split", strata=["level"]).select(
        "problem_id", "level", "research_split"
    )


def tokens(spark: SparkSession, sf: str, steps: bool = False) -> DataFrame:
    """One row per token: a user's events in time order; ``steps`` adds s3 = |step of s1|."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("s1"),
        F.get_json_object("props", "$.k").cast("double").alias("s2"),
    )
    ordered = position(ev, ["run_id"], ["ts", "event_id"]).withColumn("token_index", F.col("position") - 1)
    if steps:
        ordered = with_previous(ordered, ["run_id"], "token_index", {"__p": ("s1", 1)})
        ordered = ordered.withColumn("s3", F.abs(F.col("s1") - F.col("__p"))).drop("__p")
    lengths = ev.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    out = ordered.join(lengths, "run_id")
    solution = (F.col("run_id") % 7 == 0) | (F.col("token_index") >= F.col("n_tokens") - 5)
    kept = ["run_id", "token_index", "s1", "s2", "n_tokens"] + (["s3"] if steps else [])
    return out.select(
        *kept,
        F.floor(F.col("run_id") / 5).alias("problem_id"),
        F.concat(F.lit("m"), (F.col("run_id") % 2).cast("string")).alias("model_key"),
        (F.col("run_id") % 3 == 0).alias("correct"),
        (F.lit(1) + F.col("run_id") % 5).cast("long").alias("level"),
        F.when(solution, "solution").otherwise("thinking").alias("segment"),
    )


def probes(spark: SparkSession, sf: str, part: str = "all") -> DataFrame:
    """Anchor probes per run; ``part`` holds out half of the trials as extra branches."""
    line = table(spark, sf, "lineitem")
    if part != "all":
        line = line.where(F.col("l_suppkey") % 2 == (0 if part == "base" else 1))
    hit = (F.col("l_quantity") <= 7 * F.col("l_linenumber")).cast("long")
    cells = line.groupBy("l_partkey", "l_linenumber").agg(
        F.sum(hit).alias("successes"), F.count(F.lit(1)).alias("continuations")
    )
    return cells.select(
        F.col("l_partkey").alias("run_id"), F.floor(F.col("l_partkey") / 2).alias("problem_id"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 2).cast("string")).alias("model_key"),
        (64 * F.pow(F.lit(2), F.col("l_linenumber") - 1)).cast("long").alias("anchor"),
        "successes", "continuations",
    )


def restarts(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh-restart panel: success counts per run and total budget (a budget a line number)."""
    line = table(spark, sf, "lineitem")
    hit = (F.round(F.col("l_tax") * 100) <= 2 * F.col("l_linenumber") - 1).cast("long")
    cells = line.groupBy("l_partkey", "l_linenumber").agg(
        F.sum(hit).alias("successes"), F.count(F.lit(1)).alias("attempts")
    )
    return cells.select(
        F.col("l_partkey").alias("run_id"), F.floor(F.col("l_partkey") / 2).alias("problem_id"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 2).cast("string")).alias("model_key"),
        (512 * F.pow(F.lit(2), F.col("l_linenumber"))).cast("long").alias("budget"),
        "successes", "attempts", (F.col("successes") / F.col("attempts")).alias("rate"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select(
        (F.col("label") * 10 + F.col("vec_id") % 5).cast("long").alias("run_id"),
        F.col("label").cast("long").alias("problem_id"), "vec_id", F.col("embedding").alias("vec"),
        ((F.col("vec_id") * 7) % 3 == 0).alias("correct"),
    )
    return position(emb, ["run_id"], ["vec_id"]).withColumn("token_index", F.col("position") - 1).drop("position")


def graded_text(spark: SparkSession, sf: str) -> DataFrame:
    """Generated texts with an answer suffix of one of five kinds and a reference answer."""
    d = table(spark, sf, "documents")
    shown = (F.col("n_chars") + F.col("doc_id") % 2).cast("string")
    kind, wrap = F.col("doc_id") % 5, F.col("doc_id") % 3
    suffix = (
        F.when(kind == 0, F.concat(F.lit("\\boxed{"), shown, F.lit("}")))
        .when(kind == 1, F.concat(F.lit("#### "), shown))
        .when(kind == 2, F.concat(F.lit("final answer is "), shown))
        .when(kind == 3, F.concat(F.lit("answer: "), shown)).otherwise(F.lit(""))
    )
    body = (
        F.when(wrap == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>")))
        .when(wrap == 1, F.concat(F.lit("[THINK]"), "text", F.lit("[/THINK]"))).otherwise(F.col("text"))
    )
    return d.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "math").otherwise("gsm8k").alias("dataset"),
        F.col("n_chars").cast("string").alias("reference_answer"), F.col("source").alias("problem_id"),
        F.concat(body, F.lit("\n"), suffix).alias("text"),
    )


def token_text(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a conversation as tokens, with reasoning markers that may straddle tokens."""
    c = table(spark, sf, "conversations")
    words = c.select(
        "conv_id", (2 * F.col("turn") + 1).alias("part"), F.posexplode(F.split("text", " ")).alias("pos", "word")
    ).where("word <> ''").select("conv_id", "part", "pos", F.concat("word", F.lit(" ")).alias("token_text"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    even = F.col("conv_id") % 2 == 0

    def mark(part, pos, text):
        return F.struct(part.cast("long").alias("part"), F.lit(pos).alias("pos"), text.alias("token_text"))

    extra = ends.select("conv_id", F.explode(F.filter(F.array(
        mark(F.lit(-1), 0, F.lit("<think>")),
        mark(2 * F.col("last"), 0, F.when(even, "</th").otherwise("</think>")),
        mark(2 * F.col("last"), 1, F.when(even, "ink>")),
        mark(2 * F.col("last") + 3, 0, F.concat(F.lit("\\boxed{"), F.col("conv_id").cast("string"), F.lit("}"))),
    ), lambda m: m.token_text.isNotNull())).alias("m")).select("conv_id", "m.part", "m.pos", "m.token_text")
    rows = position(words.unionByName(extra), ["conv_id"], ["part", "pos"])
    return rows.select(
        F.col("conv_id").alias("run_id"), (F.col("position") - 1).alias("token_index"), "token_text",
        F.when(F.col("part") < 1, "thinking").otherwise("solution").alias("segment"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    fold = F.col("doc_id") % 5
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("problem_id"), F.col("lang").alias("model_key"),
        F.col("quality").cast("long").alias("y"),
        F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("p1"),
        (hash60("p2:", F.col("doc_id")) % 1000 / 1000).alias("p2"),
        (F.least(F.lit(10).cast("long"), F.expr("(n_chars + 200) div 400")) / 10).alias("p3"),
        F.when(fold < 3, "train").when(fold == 3, "validation").otherwise("test").alias("research_split"),
        "text", "n_chars",
    )


def arms(spark: SparkSession, sf: str) -> DataFrame:
    """Complete three-arm branches with a low/high stratum per model and level."""
    line = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("problem_id"), "l_returnflag", (F.col("l_linestatus") == "F").alias("f"),
        F.col("l_quantity").alias("q"), _line_id().alias("line"),
    )
    rows = position(line, ["problem_id", "l_returnflag"], ["line"], "branch_index", hashed=True)

    def arm(letter, value):
        return F.max(F.when(F.col("l_returnflag") == letter, value))

    f, q = F.col("f"), F.col("q")
    wide = rows.groupBy("problem_id", "branch_index").agg(
        arm("A", f & (q > 25)).alias("short_correct"), arm("N", f | (q > 40)).alias("medium_correct"),
        arm("R", f | (q > 20)).alias("long_correct"),
        arm("A", q).cast("long").alias("short_tokens"), (4 * arm("N", q)).cast("long").alias("medium_tokens"),
        (24 * arm("R", q)).cast("long").alias("long_tokens"),
    ).where("short_tokens is not null and medium_tokens is not null and long_tokens is not null")
    scored = wide.select(
        "*", (F.col("problem_id") * 1000 + F.col("branch_index")).alias("source_run_id"),
        F.concat(F.lit("m"), (F.col("problem_id") % 2).cast("string")).alias("model_key"),
        (hash60("s:", F.col("problem_id"), ":", F.col("branch_index")) % 1000 / 1000).alias("uncertainty_score"),
    ).join(problems(spark, sf).select("problem_id", "level"), "problem_id")
    return sampling.low_high_strata(scored, ["model_key", "level"], "uncertainty_score", "source_run_id")
