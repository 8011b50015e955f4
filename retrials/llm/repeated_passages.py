"""Substring dedup on a de Bruijn graph of word windows.

A window of k words is an edge from its first k-1 words to its last k-1.  Edges found in two
documents or more are *repeated*.  Where all occurrences of an edge have one successor and all
occurrences of that have one predecessor, the two lie on one path; each maximal path is compacted to a
row with its places in the documents.  Only the ends of paths travel: an edge is looked up among its
occurrences when a path begins or ends there.  The places of a path are verified against each other by
length and by a hash of all its words before anything is removed.

Two filters of a fixed size keep work off the shuffle and never change a result.  The least hash
among a window's short word runs is its anchor; a window can only repeat if its anchor does.  The
anchors in two documents or more are counted by Spark and set as bits in a bitmap of ``FILTER_BITS`` bits,
which is sent to the tasks; when it fills up, more windows are shuffled than need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import Words, blocks, byte_views, mixed, powers, sliding_min, stored, window_starts, windows

ANCHOR_WORDS = 5
#: 8 MB, whatever the size of the corpus.
FILTER_BITS = 26
_C = np.uint64(0xD1342543DE82EF95)
_C_INVERSE = np.uint64(pow(int(_C), -1, 1 << 64))


class Filter:
    """A bitmap over 64-bit keys that are hashes already: may say yes for other keys, never no for its own."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def of(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> Filter:
        """Two bits a key.  Spark gathers them by 64-bit word; the driver gets 2^bits / 64 words at most."""
        places = F.array(F.shiftrightunsigned(F.col(key), 64 - bits), F.col(key).bitwiseAND((1 << bits) - 1))
        rows = (keys.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
        return Filter(words, bits)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        def is_set(bit):
            return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0

        return is_set(hashes >> np.uint64(64 - self.bits)) & is_set(hashes & np.uint64((1 << self.bits) - 1))


def first_copies(src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, tkey, text): the rows of the smallest id of each text, and (tkey, least id) of the texts that repeat."""
    copies = stored(src.groupBy("tkey").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("tkey", "least", "n"), "copies")
    first = src.join(copies.select("tkey", "least"), "tkey", "left").where(F.col("least").isNull() | (F.col("id") == F.col("least"))).select("id", "tkey", "text")
    return first, copies


def _anchored(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows within one row, and the anchor of each."""
    at = np.flatnonzero(window_starts(words.first, k))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    return at, sliding_min(windows(words.hash, ANCHOR_WORDS), k - ANCHOR_WORDS + 1)[at]


def _anchor_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_views(b.column(2))
            for i, j in blocks(offsets):
                words = Words(data, offsets[i: j + 1])
                at, anchor = _anchored(words, k)
                row = words.rows()[at]
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                pairs = np.unique(np.stack([row[new].astype(np.uint64), anchor[new]], 1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64) if len(at) else np.zeros(0, np.int64))], names=["anchor"])
    return run


def _edge_rows(k: int, anchors, marks=None):
    """Occurrences of the windows whose anchors repeat: with their neighbours, or with their places if ``marks`` is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_views(b.column(2))
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets):
                words = Words(data, offsets[i: j + 1])
                at, anchor = _anchored(words, k)
                held = anchors.value.may_hold(anchor)
                at = at[held]
                if not len(at):
                    continue
                edge = windows(words.hash, k)
                rows = np.searchsorted(words.first, at, "right") - 1
                if marks is None:
                    before = np.where(at > words.first[rows], edge[at - 1], 0)
                    after = np.where(at + k < words.first[rows + 1], edge[np.minimum(at + 1, len(edge) - 1)], 0)
                    cols = [edge[at].view(np.int64), ids[i + rows], before.astype(np.uint64).view(np.int64), after.astype(np.uint64).view(np.int64)]
                    names = ["edge", "id", "before", "after"]
                else:
                    held = marks.value.may_hold(edge[at])
                    at, rows = at[held], rows[held]
                    n = len(words.hash)
                    sums = np.zeros(n + 1, np.uint64)
                    np.cumsum(words.hash * powers(n, _C), out=sums[1:])
                    first = words.first[rows]
                    back = powers(n + 1, _C_INVERSE)[first]
                    upto = [((sums[at + d] - sums[first]) * back).view(np.int64) for d in (0, k - 1, k)]
                    cols = [edge[at].view(np.int64), ids[i + rows], keys[i + rows], at - first, *upto]
                    names = ["edge", "id", "tkey", "place", "sum_start", "sum_before", "sum_end"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each document's marks: its path occurrences (id, tkey, path, source, start, edges, words_hash)."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            opened = None

            def close(stop, total):
                h = (total - opened["sum_start"]) * pow(int(_C_INVERSE), opened["place"], 1 << 64) & ((1 << 64) - 1)  # noqa: B023
                out.append((r["id"], r["tkey"], opened["edge"], opened["source"], opened["place"], stop - opened["place"], h - (h >> 63 << 64)))  # noqa: B023

            for m in sorted(r["marks"], key=lambda m: m["place"]):
                if m["is_start"]:
                    if opened is not None:  # a path runs up to the next start
                        close(m["place"], m["sum_before"])
                    opened = m
                if m["is_end"] and opened is not None:
                    close(m["place"] + 1, m["sum_end"])
                    opened = None
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "tkey", "path", "source", "start", "edges", "words_hash"])


def repeated_paths(first: DataFrame, k: int = 13) -> DataFrame:
    """Occurrences of the compacted paths of repeated edges, verified: id, tkey, path, source (the
    smallest id that holds the path), start (word), edges.  ``first``: (id, tkey, text), each text under one id."""
    sc = first.sparkSession.sparkContext
    seen = first.mapInArrow(_anchor_rows(k), "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    anchors = sc.broadcast(Filter.of(seen, "anchor"))
    edges = first.mapInArrow(_edge_rows(k, anchors), "edge bigint, id bigint, before bigint, after bigint")
    one = lambda lo, hi: (F.col(lo) == F.col(hi)) & (F.col(lo) != 0)
    repeated = edges.groupBy("edge").agg(
        F.min("id").alias("source"), F.max("id").alias("last"), F.min("before").alias("b1"), F.max("before").alias("b2"),
        F.min("after").alias("a1"), F.max("after").alias("a2")).where("last > source")
    repeated = stored(repeated.select("edge", "source", F.when(one("b1", "b2"), F.col("b1")).alias("before"), (~one("a1", "a2")).alias("is_end")), "edges")
    # a path starts where an edge has no single predecessor, or one that has several successors
    forks = repeated.where("is_end").select(F.col("edge").alias("before"), F.lit(True).alias("forks"))
    marks = repeated.join(forks, "before", "left").withColumn("is_start", F.col("before").isNull() | F.col("forks").isNotNull())
    marks = stored(marks.where("is_start or is_end").select("edge", "source", "is_start", "is_end"), "marks")
    wanted = sc.broadcast(Filter.of(marks, "edge"))
    places = first.mapInArrow(_edge_rows(k, anchors, wanted), "edge bigint, id bigint, tkey bigint, place bigint, sum_start bigint, sum_before bigint, sum_end bigint")
    per_doc = places.join(marks, "edge").groupBy("id", "tkey").agg(F.collect_set(F.struct(
        "edge", "source", "is_start", "is_end", "place", "sum_start", "sum_before", "sum_end")).alias("marks"))
    paths = stored(per_doc.mapInArrow(_paths, "id bigint, tkey bigint, path bigint, source bigint, start bigint, edges bigint, words_hash bigint"), "paths")
    sure = paths.groupBy("path").agg(F.min("words_hash").alias("h1"), F.max("words_hash").alias("h2"), F.min("edges").alias("e1"), F.max("edges").alias("e2"))
    sure = sure.where("h1 = h2 and e1 = e2").select("path")
    return paths.join(sure, "path", "left_semi").select("id", "tkey", "path", "source", "start", "edges")


def _cut_words(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts, gone, size, kept = [], [], [], []
                for text, spans, copy in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    words = (text.as_py() or "").encode().split()
                    left = []
                    at = 0
                    for s in sorted((x["start"], x["stop"]) for x in spans.as_py() or ()):
                        left += words[at: s[0]]
                        at = max(at, s[1])
                    left += words[at:]
                    if copy.as_py() and len(words) >= k:
                        left = []
                    size.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, k: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``k`` words that covers it also starts in a document with a smaller
    id; windows are judged on the input.  Ids are integers.  A null id counts as larger than all
    others, so such rows repeat nothing to each other but yield to the rest.  Rows of one id never remove each other's
    words.  Null and empty texts have no words.  Other columns are not read; an empty table gives no rows.
    A later copy of a whole text loses all its words (from ``k`` words on) without a search; of each
    text one document is searched."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    first, copies = first_copies(src.select("id", "tkey", "text"))
    spans = (repeated_paths(first, k).where("id > source").groupBy("tkey")
             .agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("edges") + k - 1).alias("stop")))).alias("spans")))
    known = stored(copies.select("tkey", "least").join(spans, "tkey", "full"), "spans")
    out = src.join(known, "tkey", "left").select("doc_id", "text", "spans", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("copy"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(_cut_words(k), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string").withColumnRenamed("doc_id", doc_id)
