"""Toxicity by two class-conditional Kneser-Ney models of the bytes within words.

A *gram* is a byte of a lower-cased word with up to ``ORDER - 1`` symbols before it, a start mark ahead of
the word.  Each class has its own counts of whole grams; below that, both share one Kneser-Ney
model, in which a shorter gram counts by the distinct symbols found before it in all documents, labelled or
not.  What a class has seen rarely is therefore smoothed by the corpus, and where neither
class knows a context, both give the same likelihood and the word says nothing.

A word's log ratio is the sum over its bytes.  A document is judged by its length-normalised
log-likelihoods under both models and by its words that stand out, weighed by a logistic
regression on labelled documents that the models haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import _LOWER, NOT_ALNUM, Words, blocks, byte_views, stored
from retrials.llm.repeated_passages import Filter

ORDER = 6
START = 1
DISCOUNT = 0.75
#: A word counts as standing out by what its log ratio exceeds these by.
MARGINS = (1.5, 3.0, 6.0)
FEATURES = ("mean_ratio", "top_ratio", *(f"{kind}_excess_{i}" for i in range(len(MARGINS)) for kind in ("mean", "log")))
#: Rows kept in a task to send each gram of it about once.
SEEN = 1 << 21


class Texts:
    """The distinct words of some rows, their grams, and where each word stands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True, gaps=NOT_ALNUM)
        self.first, self.rows, self.size = words.first, words.rows(), words.ends - words.starts
        self.key, rep, self.word = np.unique(words.hash, return_index=True, return_inverse=True)
        size = self.size[rep]
        self.begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(self.begin, size)
        symbol = _LOWER[data[np.repeat(words.starts[rep] + words.base, size) + place]].astype(np.uint64) if len(place) else np.zeros(0, np.uint64)
        grams = symbol.copy()
        for j in range(1, ORDER):
            before = np.zeros_like(symbol)
            before[j:] = symbol[:-j] if len(symbol) > j else symbol[:0]
            grams |= np.where(place >= j, before, np.where(place == j - 1, np.uint64(START), np.uint64(0))) << np.uint64(8 * j)
        self.grams, self.of = grams.astype(np.int64), np.repeat(np.arange(len(rep)), size)

    def documents_of_words(self, rows: np.ndarray) -> np.ndarray:
        """In how many of the marked rows each distinct word stands."""
        held = rows[self.rows]
        n = len(self.first)
        return np.bincount(np.unique(self.word[held] * n + self.rows[held]) // n, minlength=len(self.begin))


def _gathered(sample=None):
    """Grams of all rows (id, teaches, text, label), with the documents of each label that hold a word with it.

    Rows of label -1 give grams only.  Without that column the labels are looked up in ``sample``, a broadcast of ids and labels."""
    def labels_of(b: pa.RecordBatch) -> np.ndarray:
        key, teaches = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        if sample is None:
            return np.where(teaches, b.column(3).to_numpy(), -1)
        ids, labels = sample.value
        at = np.minimum(np.searchsorted(ids, key), max(len(ids) - 1, 0))
        return np.where((ids[at] == key) & teaches, labels[at], -1) if len(ids) else np.full(len(key), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            data, offsets = byte_views(b.column(2))
            label = labels_of(b)
            for i, j in blocks(offsets):
                t = Texts(data, offsets[i: j + 1])
                if not len(t.grams):
                    continue
                gram, of = np.unique(t.grams, return_inverse=True)
                n = [np.bincount(of, weights=t.documents_of_words(label[i:j] == k)[t.of], minlength=len(gram)).astype(np.int64) for k in (0, 1)]
                fresh = (n[0] + n[1] > 0) | ~np.isin(gram, seen, assume_unique=True)
                seen = gram if len(seen) > SEEN else np.union1d(seen, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x[fresh]) for x in (gram, *n)], names=["gram", "c0", "c1"])
    return run


def _likely(held):
    """Rows whose id, first in them, the bitmap may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.may_hold(b.column(0).to_numpy().view(np.uint64))))
    return run


def gram_counts(src: DataFrame, known: DataFrame) -> DataFrame:
    """(gram, c0, c1) of the whole corpus: every row of ``src`` (id, teaches, text) tells which grams there are, and every row
    that teaches and whose id is in ``known`` (id, label) counts for its label.  Labels meet their rows in a join, however many there are;
    a bitmap keeps most texts without a label off its shuffle."""
    kind = "gram bigint, c0 bigint, c1 bigint"
    everywhere = src.select("id", F.lit(False).alias("teaches"), "text", F.lit(-1).alias("label")).mapInArrow(_gathered(), kind)
    held = src.sparkSession.sparkContext.broadcast(Filter.of(known, "id"))
    likely = src.where("teaches").select("id", "text").mapInArrow(_likely(held), "id bigint, text string")
    taught = likely.join(known, "id").select("id", F.lit(True).alias("teaches"), "text", "label").mapInArrow(_gathered(), kind)
    return everywhere.unionByName(taught).groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def symbols(key: str) -> Column:
    """How many symbols a packed gram has."""
    return sum((F.when(F.shiftright(key, 8 * j) != 0, 1).otherwise(0) for j in range(ORDER)), F.lit(0))


def shared_backoff(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, shared): likelihood of each wanted gram's last symbol after its context less the first symbol.

    Interpolated Kneser-Ney from one symbol up; a gram counts by the distinct symbols before it in ``grams``."""
    low = lambda n: F.col("gram").bitwiseAND((1 << 8 * n) - 1)
    size = symbols("gram")
    suffixes = F.filter(F.array(*(F.when(size >= n, low(n)) for n in range(2, ORDER + 1))), lambda x: x.isNotNull())
    longer = grams.select(F.explode(suffixes).alias("key")).distinct()
    n = symbols("key")
    shorter = F.col("key").bitwiseAND(sum((F.when(n == i, (1 << 8 * (i - 1)) - 1).otherwise(0) for i in range(2, ORDER + 1)), F.lit(0)).cast("long"))
    kinds = stored(longer.groupBy(shorter.alias("key")).agg(F.count("*").alias("kinds")), "kinds")
    contexts = kinds.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("kinds").alias("total"), F.count("*").alias("followers"))
    steps = F.filter(F.array(*(F.when(size > n, F.struct(F.lit(n).alias("n"), low(n).alias("key"))) for n in range(1, ORDER))), lambda x: x.isNotNull())
    asked = wanted.select("gram", F.explode(steps).alias("x")).select("gram", "x.n", "x.key", F.shiftright("x.key", 8).alias("context"))
    told = asked.join(contexts, "context").join(kinds, "key", "left")
    told = told.select("gram", F.struct("n", (F.greatest(F.coalesce("kinds", F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("own"),
                                        (DISCOUNT * F.col("followers") / F.col("total")).alias("rest")).alias("step"))
    return told.groupBy("gram").agg(F.aggregate(F.array_sort(F.collect_list("step")), F.lit(1 / 256), lambda p, s: s["own"] + s["rest"] * p).alias("shared"))


class Model(NamedTuple):
    """Log ratios of known grams, and of any other symbol after a known context; sorted by key."""

    gram: np.ndarray
    ratio: np.ndarray
    context: np.ndarray
    otherwise: np.ndarray

    def word_ratios(self, t: Texts) -> np.ndarray:
        def look(key, values, wanted):
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            return np.where(key[at] == wanted, values[at], np.nan)
        if not len(self.gram) or not len(t.grams):
            return np.zeros(len(t.begin))
        found = look(self.gram, self.ratio, t.grams)
        lost = np.isnan(found)
        found[lost] = np.nan_to_num(look(self.context, self.otherwise, t.grams[lost] >> 8))
        return np.add.reduceat(found, t.begin)


class Tables(NamedTuple):
    """The same as tables (gram, ratio) and (context, otherwise), for joins."""

    grams: DataFrame
    contexts: DataFrame


def fit_models(counts: DataFrame, min_count: int, max_grams: int) -> Model | Tables:
    """``counts``: (gram, c0, c1) of the whole corpus.  Grams under ``min_count`` count towards their context's backoff only.
    Beyond ``max_grams`` grams the model stays a pair of tables."""
    known = counts.where("c0 + c1 > 0")
    kept = known.where(F.col("c0") + F.col("c1") >= min_count)
    kept = stored(kept, "kept")
    totals = known.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    less = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    own = kept.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum(less("c0")).alias("k0"), F.sum(less("c1")).alias("k1"))
    rest = lambda i: F.when(F.col(f"t{i}") > 0, 1 - F.col(f"k{i}") / F.col(f"t{i}")).otherwise(1.0)
    contexts = stored(totals.join(own, "context").withColumn("g0", rest(0)).withColumn("g1", rest(1)), "contexts")
    p = lambda i: F.when(F.col(f"t{i}") > 0, less(f"c{i}") / F.col(f"t{i}")).otherwise(0.0) + F.col(f"g{i}") * F.col("shared")
    grams = kept.join(shared_backoff(counts, kept), "gram").withColumn("context", F.shiftright("gram", 8)).join(contexts, "context")
    grams = grams.select("gram", F.ln(p(1) / p(0)).alias("ratio"))
    contexts = contexts.select("context", F.ln(F.col("g1") / F.col("g0")).alias("otherwise"))
    if kept.count() > max_grams:
        return Tables(stored(grams, "ratios"), contexts)
    grams, contexts = grams.toArrow().sort_by("gram"), contexts.toArrow().sort_by("context")
    return Model(*(t.column(c).to_numpy() for t, c in ((grams, "gram"), (grams, "ratio"), (contexts, "context"), (contexts, "otherwise"))))


def _measured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_views(b.column(b.num_columns - 1))
            for i, j in blocks(offsets):
                t, n = Texts(data, offsets[i: j + 1]), j - i
                ratio = model.value.word_ratios(t)[t.word]
                add = lambda x, rows=t.rows, n=n: np.bincount(rows, weights=x, minlength=n)
                words, top = np.maximum(np.diff(t.first), 1), np.zeros(n)
                np.maximum.at(top, t.rows, ratio)
                values = [add(ratio) / np.maximum(add(t.size), 1), top]
                for margin in MARGINS:
                    excess = add(np.maximum(ratio - margin, 0))
                    values += [excess / words, np.log1p(excess)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, n) for c in b.columns[:-1]), *(pa.array(x) for x in values)], names=[*b.schema.names[:-1], *FEATURES])
    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of the distinct words of a block."""
    for b in batches:
        data, offsets = byte_views(b.column(0))
        for i, j in blocks(offsets):
            t = Texts(data, offsets[i: j + 1])
            at = pa.array(np.append(t.begin, len(t.grams)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(t.key.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(t.grams))], names=["word", "grams"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row the distinct words and how often each stands in it."""
    for b in batches:
        data, offsets = byte_views(b.column(b.num_columns - 1))
        for i, j in blocks(offsets):
            t, n = Texts(data, offsets[i: j + 1]), j - i
            pair, many = np.unique(t.rows.astype(np.int64) * max(len(t.key), 1) + t.word, return_counts=True)
            row, word = np.divmod(pair, max(len(t.key), 1))
            at = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(at, pa.array(x)) for x in (t.key.view(np.int64)[word], many))
            yield pa.RecordBatch.from_arrays([*(c.slice(i, n) for c in b.columns[:-1]), *lists], names=[*b.schema.names[:-1], "words", "counts"])


def joined_features(src: DataFrame, tables: Tables) -> DataFrame:
    """What ``_measured`` gives for ``src`` (columns, text last), by joins of the distinct words with tables of any size."""
    kept = src.columns[:-1]
    kinds = dict(src.dtypes)
    spelled = src.select(src.columns[-1]).mapInArrow(_spelled, "word bigint, grams array<bigint>").groupBy("word").agg(F.first("grams").alias("grams"))
    grams = spelled.select("word", F.size("grams").alias("size"), F.explode("grams").alias("gram")).withColumn("context", F.shiftright("gram", 8))
    known = grams.join(tables.grams, "gram", "left").join(tables.contexts, "context", "left")
    words = stored(known.groupBy("word", "size").agg(F.sum(F.coalesce("ratio", "otherwise", F.lit(0.0))).alias("ratio")), "words")
    counted = src.mapInArrow(_counted, "".join(f"{c} {kinds[c]}, " for c in kept) + "words array<bigint>, counts array<bigint>")
    rows = stored(counted.withColumn("row", F.monotonically_increasing_id()), "counted")
    each = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("n")).join(words, "word")
    over = [F.sum(F.col("n") * F.greatest(F.col("ratio") - m, F.lit(0.0))) for m in MARGINS]
    sums = each.groupBy("row").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum(F.col("n") * F.col("size"))).alias(FEATURES[0]), F.greatest(F.max("ratio"), F.lit(0.0)).alias(FEATURES[1]), *(
        c.alias(f"{kind}_excess_{i}") for i, x in enumerate(over) for kind, c in (("mean", x / F.sum("n")), ("log", F.log1p(x)))))
    return rows.join(sums, "row", "left").select(*kept, *(F.coalesce(x, F.lit(0.0)).alias(x) for x in FEATURES))


def judged(known: DataFrame) -> Column:
    """The score as a column of the features, fitted on ``known`` (features and label)."""
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:  # nothing to weigh by: the length-normalised ratio decides, at the learnt label's odds
        return 1 / (1 + F.exp(-(F.col(FEATURES[0]) + log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))))
    fitted = LogisticRegression(regParam=1e-3, maxIter=100).fit(known.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*FEATURES)).alias("features")))
    total = F.lit(float(fitted.intercept))
    for w, x in zip(fitted.coefficients.toArray(), FEATURES, strict=True):
        total = total + float(w) * F.col(x)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1,
          min_count: int = 3, max_grams: int = 1 << 19, limit: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, toxic from ``limit`` on), predicted, and the features.

    Learnt from all labelled ids that are not held out, of which a fourth, by a hash of the text,
    weighs the features and the rest fills the class counts; the shared counts and all scores
    cover every document.  A model of at most ``max_grams`` grams is sent to the tasks, a larger one is joined, with the same scores.
    Ids whose crc32 leaves ``held`` modulo ``folds`` are held out: never learnt from.  A null id isn't held out and has no label;
    labels other than 0 and 1, null labels and ids with both labels teach nothing; repeated rows each get their row and each teach.
    Null, empty and wordless texts have zero features, hence one score.  Without labels of both classes the length-normalised ratio stands alone.
    Words are compared by 64-bit hashes within a block of rows.  A very long text is one block.  Other columns are not read; an empty table gives no rows."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    known = (labels.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(~held_out)
             .groupBy(F.xxhash64("doc_id").alias("id")).agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label"))
    known = stored(known, "known")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id)).alias("id"), (F.pmod(F.xxhash64(text), F.lit(4)) > 0).alias("teaches"), F.col(text).alias("text"))
    teaching = src.select("id", (F.col("teaches") & F.col("doc_id").isNotNull() & ~held_out).alias("teaches"), "text")
    counts = stored(gram_counts(teaching, known), "grams")
    model = fit_models(counts, min_count, max_grams)
    features = joined_features(src, model) if isinstance(model, Tables) else src.mapInArrow(
        _measured(spark.sparkContext.broadcast(model)), f"doc_id {kind}, id bigint, teaches boolean, {', '.join(f'{x} double' for x in FEATURES)}")
    features = stored(features, "features")
    weighing = features.where(~F.col("teaches") & F.col("doc_id").isNotNull()).join(known, "id")
    out = features.select("doc_id", held_out.alias("held_out"), judged(weighing).alias("score"), *FEATURES)
    return out.select(F.col("doc_id").alias(doc_id), "held_out", "score", (F.col("score") >= limit).cast("int").alias("predicted"), *FEATURES)
