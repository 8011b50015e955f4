"""Quality rules with cross-document line frequency, in Spark column expressions only.

A line's *limit* is judged per host: its normalised form is hashed and the distinct documents of
the host that hold it are counted.  A document counts by the hash of its text, so that exact copies
count once and a copied article isn't boilerplate.
A line over the limit is taken out; a document of which too little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import SPACE, stored

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words without ASCII white space, in order."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE)).otherwise(F.array().cast("array<string>"))


def repeated_window_words(words: Column, prefix: str, df: DataFrame, width: int = 8) -> DataFrame:
    """Add ``prefix``: words inside windows of ``width`` words that occur twice or more in the text.

    ``words``: a 64-bit hash of each word.  Windows are compared by a 64-bit hash of those; their starts are sorted by it, never compared pairwise."""
    h, s, p = (f"{prefix}_{x}" for x in "hsp")
    df = df.withColumn(h, F.when(F.size(words) > width, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.get(F.col(s), i)["h"] == F.get(F.col(s), j)["h"]
    df = df.withColumn(p, F.when(F.col(s).isNotNull(), F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
        lambda i: F.get(F.col(s), i)["i"]))))
    total = F.aggregate(
        F.col(p), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct((x + width).alias("end"), (a["n"] + width - F.greatest(a["end"] - x, F.lit(0))).alias("n")), lambda a: a["n"])
    return df.withColumn(prefix, F.coalesce(total, F.lit(0).cast("long"))).drop(h, s, p)


def normalised(line: Column) -> Column:
    """Lower ASCII case, digit runs as 0, white space as one space."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]+", "0"), SPACE, " "), F.lit(" "))


def line_id(line: Column) -> Column:
    """The line's 64-bit hash."""
    return F.xxhash64(line)


def quality_rules(docs: DataFrame, max_docs: int = 10, min_left: float = 0.3, min_words: int = 20,
                  doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, left_words, n_lines_removed, kept, tkey (64-bit hash of the text), bad_lines (their ids).

    A line goes if more than ``max_docs`` distinct texts of its host hold it, however often each
    stands there; a document goes if it fails the base rules
    (under ``min_words`` words, or over 30 % of words in repeated windows) or under ``min_left``
    of its words are left.  Null or empty text: no words, base_failed.
    A null host is a host.  Repeated rows count once for a line, and each gets its row with the same values.  A text is
    taken whole, however long, in one row; ties don't arise.  Other columns of ``docs`` are not read; an empty table gives no rows.
    The texts are read once, into the counts and line hashes that everything else works on."""
    src = docs.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    src = src.withColumn("key", F.xxhash64("text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    # words never reach over a line's end, so one split by lines and words serves every count
    split = src.withColumn("lined", lines).withColumn("parts", F.transform("lined", words_of))
    split = split.withColumn("hashes", F.flatten(F.transform("parts", lambda x: F.transform(x, lambda w: F.xxhash64(w)))))
    stats = repeated_window_words(F.col("hashes"), "n_repeat_words", split).select(
        "id", "host", "key", F.size("hashes").cast("long").alias("n_words"),
        F.length(F.translate(body, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lined") - F.size(F.array_distinct("lined"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform("lined", lambda x, i: F.struct(line_id(normalised(x)).alias("line"), F.size(F.get("parts", i)).alias("words"))).alias("lines"))
    stats = stored(stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "statistics")
    single = (stats.select("id", "host", "key", "lines").dropDuplicates(["id", "host", "key"]).select("id", "host", "key", F.explode("lines").alias("x"))
              .groupBy("id", "host", "key", F.col("x.line").alias("line")).agg(F.sum("x.words").alias("words"), F.count("*").alias("copies")))
    single = stored(single, "lines")
    common = (single.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count("*").alias("docs"))
              .where(F.col("docs") > max_docs).select("host", "line"))
    s, c = single.alias("s"), common.alias("c")
    gone = (s.join(c, F.col("s.host").eqNullSafe(F.col("c.host")) & (F.col("s.line") == F.col("c.line")), "left_semi")
            .groupBy("id", "host", "key").agg(F.sum("words").alias("gone"), F.sum("copies").alias("n_lines"), F.collect_set("line").alias("bad")))
    d, g = stats.drop("lines").alias("d"), gone.alias("g")
    both = d.join(g, F.col("d.id").eqNullSafe(F.col("g.id")) & F.col("d.host").eqNullSafe(F.col("g.host")) & (F.col("d.key") == F.col("g.key")), "left")
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    return both.select(
        F.col("d.id").alias(doc_id), F.col("d.host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        left.alias("left_words"), F.coalesce("n_lines", F.lit(0)).alias("n_lines_removed"),
        (~F.col("base_failed") & (left >= min_left * F.col("n_words"))).alias("kept"), F.col("d.key").alias("tkey"), F.col("bad").alias("bad_lines"))


def clean_documents(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns, without the lines over the limit."""
    v = verdicts.where("kept").select(F.col(doc_id).alias("id"), F.col(host).alias("host"), "tkey", "bad_lines").dropDuplicates(["id", "host", "tkey"]).alias("v")
    d = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(host).alias("host"), F.xxhash64(text).alias("tkey")).alias("d")
    same = (F.col("d.tkey") == F.col("v.tkey")) & F.col("d.id").eqNullSafe(F.col("v.id")) & F.col("d.host").eqNullSafe(F.col("v.host"))
    whole = F.col("row").getField(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: (F.length(F.translate(x, WHITE, "")) == 0) | ~F.array_contains("bad_lines", line_id(normalised(x))))
    cleaned = F.when(F.col("bad_lines").isNull(), whole).otherwise(F.array_join(lines, "\n"))
    return d.join(v, same).select(*(cleaned.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
