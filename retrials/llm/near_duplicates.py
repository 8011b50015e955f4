"""Near duplicates by SuperMinHash, banding, verification on whole sets and union-find.

SuperMinHash gives each element a random permutation of the slots and the ranks in it plus a
random fraction as values; a slot keeps its least value.  Ranks of one element are never equal, which lowers
the variance; once every slot holds a value below the next rank, no later rank can matter and the
work stops early.  Documents with equal shingle sets are one class; bands, checks and links are
between classes.  Classes that share a band are candidates.  In a few rounds each is checked with the
most alike of its bands' centres, which joins most groups with one check a class; classes whose bands still
hold another component then meet over the rarest shingles of their sets, as many as a linked pair must share one of.  Four bits of each slot make a sketch; a
pair whose sketches agree in fewer slots than a pair at the limit does by five deviations isn't checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import Words, blocks, byte_views, mixed, stored, window_starts, windows
from retrials.llm.graph import components

BANDS, BAND_ROWS = 32, 4
_STEP, _OTHER, _SHORT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in order; a row of fewer than ``k`` words has one, of all its words."""
    ok = window_starts(words.first, k)
    at = np.flatnonzero(ok)
    hashes, rows = windows(words.hash, k)[at], np.searchsorted(words.first, at, "right") - 1
    size = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        if len(short):
            whole = windows(words.hash, n)[words.first[short]] ^ (_SHORT * np.array(n, np.uint64)[None])
            hashes, rows = np.concatenate([hashes, mixed(whole)]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], hashes[new]


def super_minhash(rows: np.ndarray, elements: np.ndarray, n_rows: int, slots: int, chunk: int = 100_000) -> np.ndarray:
    """Signatures (n_rows x slots) of the rows' element sets, rank by rank for all elements at once."""
    sig = np.full((n_rows, slots), np.inf)
    steps = _STEP * np.arange(1, slots + 1, dtype=np.uint64)
    flat = sig.reshape(-1)
    for lo in range(0, len(rows), chunk):
        row, e = rows[lo: lo + chunk], elements[lo: lo + chunk]
        perm = np.tile(np.arange(slots, dtype=np.int16), (len(row), 1))
        for k in range(slots):
            z = mixed(e + steps[k])
            r = (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
            j = k + (mixed(z ^ _OTHER) % np.uint64(slots - k)).astype(np.int64)
            each = np.arange(len(row))
            slot = perm[each, j].astype(np.int64)
            perm[each, j] = perm[:, k]
            np.minimum.at(flat, row * slots + slot, r + k)
            first, last = int(row[0]), int(row[-1])
            open_ = (sig[first: last + 1].max(axis=1) >= k + 1)[row - first]
            if not open_.all():
                row, e, perm = row[open_], e[open_], perm[open_]
                if not len(row):
                    break
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sig), 1))
    for i in range(rows):
        out = mixed(out * _STEP + bits[:, :, i])
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot, sixteen slots a word."""
    bits = mixed(sig.view(np.uint64)) & np.uint64(15)
    return np.bitwise_or.reduce(bits.reshape(len(sig), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def agreeing_slots(a: str, b: str, words: int) -> Column:
    """Slots in which two sketches agree."""
    total = F.lit(16 * words)
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total - F.bit_count(x.bitwiseAND(0x1111111111111111))
    return total


def least_agreement(slots: int, percent: int) -> int:
    """Slots that a pair at the limit agrees in, less five standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(slots * p - 5 * (slots * p * (1 - p)) ** 0.5)


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """From (doc_id, tkey, text): doc_id, tkey, node (64 bits of the set), n_shingles, keys (one a band), sketch.  No words: node null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = byte_views(b.column(2))
            for i, j in blocks(at):
                n = j - i
                row, e = shingles(Words(data, at[i: j + 1], lower=True), k)
                count = np.bincount(row, minlength=n)
                total, mix = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(total, row, mixed(e ^ _OTHER))
                np.bitwise_xor.at(mix, row, mixed(e + _STEP))
                node = mixed(total ^ mixed(mix + count.astype(np.uint64)))
                sig = super_minhash(row, e, n, bands * rows)
                keys, sketch = (pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64)))
                                for x in (band_keys(sig, bands, rows), sketches(sig)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(node.view(np.int64), mask=count == 0), pa.array(count, pa.int64()), keys, sketch],
                    names=["doc_id", "tkey", "node", "n_shingles", "keys", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind}, tkey bigint, node bigint, n_shingles bigint, keys array<bigint>, sketch array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                text = pa.concat_arrays([part.column(2), part.column(3)])
                data, at = byte_views(text)
                row, e = shingles(Words(data, at, lower=True), k)
                first = np.searchsorted(row, np.arange(len(text) + 1))
                n, good = part.num_rows, np.zeros(part.num_rows, bool)
                for i in range(n):
                    x, y = e[first[i]: first[i + 1]], e[first[n + i]: first[n + i + 1]]
                    near = np.searchsorted(x, y)
                    both = int((x[np.minimum(near, len(x) - 1)] == y).sum()) if len(x) else 0
                    good[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.select([0, 1]).filter(pa.array(good))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def listed(texts: DataFrame, k: int) -> DataFrame:
    """(node, shingle) of the distinct shingles of each text of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = byte_views(b.column(1))
            for i, j in blocks(at):
                row, e = shingles(Words(data, at[i: j + 1], lower=True), k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + row)), pa.array(e.view(np.int64))], names=["node", "shingle"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingle bigint")


def overlapping(left: DataFrame, texts: DataFrame, k: int, percent: int, alike: Column) -> DataFrame:
    """Pairs (a, b) of the classes in ``left`` (node, size, label, sketch) that may be linked but have different labels.

    Each set is ordered by how many classes hold a shingle, rarest first.  The first common shingle of a
    linked pair stands among the first size - least overlap + 1 of both sets, and from there on at least the least
    overlap must remain in each.  So only those prefixes meet, and the members of a group of near copies whose own
    shingles fill their prefixes never do.  Shingles of one class only count for the places of the others."""
    pairs = listed(texts.join(left.select("node"), "node", "left_semi"), k)
    held = pairs.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    order = pairs.join(held, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("order"))
    n, m = F.col("size"), F.size("order")
    # the larger set of a pair shares at least percent of itself, the smaller one 2 percent / (100 + percent)
    probe = n - F.ceil(n * percent / 100.0 - 1e-9) + 1
    index = n - F.ceil(n * 2 * percent / (100.0 + percent) - 1e-9) + 1
    prefix = left.join(order, "node").select("node", "size", "label", "sketch", (n - m).alias("own"), index.alias("index"), F.posexplode(
        F.slice("order", F.lit(1), F.greatest(F.least(probe - (n - m), m), F.lit(0)).cast("int"))).alias("at", "first"))
    prefix = stored(prefix.select("node", "size", "label", "sketch", "index", "first.shingle", (F.col("own") + F.col("at")).alias("place")), "prefixes")
    p, q = prefix.where("place < index").alias("p"), prefix.alias("q")
    most = F.least(F.col("p.size") - F.col("p.place"), F.col("q.size") - F.col("q.place"))  # of the overlap, where this shingle is the first of it
    could = 100 * most >= percent * (F.col("p.size") + F.col("q.size") - most)
    smaller = F.struct("p.size", "p.node") < F.struct("q.size", "q.node")
    met = p.join(q, (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.label") != F.col("q.label")) & smaller & could & alike)
    return met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS, rounds: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey (64-bit hash of the text), n_shingles, component_id, n_links, kept.

    Words are lower-cased (A-Z) runs without ASCII white space; shingles are ``k`` words.  Links join
    documents with 100 * |intersection| >= percent * |union|; ``n_links`` counts the confirmed links
    of the document's class that the search used.  A pair at the limit misses every band with a
    chance of (1 - 0.8^4)^32 = 5e-8, and its sketches agree too little with one of 3e-7.  Texts without words (null, empty) link with nothing and are
    their own component.  component_id is the smallest id of the component, null only if all its ids are;
    kept: doc_id is the component_id.  Repeated rows share a class.  Other columns are not read."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    rows = stored(signed(src, k, bands, band_rows), "signed")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("tkey").alias("tkey"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    members = nodes.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(shared, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    candidates = stored(nodes.drop("keys").join(degree, "node"), "candidates")
    texts = stored(src.join(candidates.select("tkey", "node"), "tkey").groupBy("node").agg(F.first("text").alias("text")), "texts")
    placed = members.select("node", "key").join(candidates.drop("tkey"), "node").withColumn("label", F.col("node"))
    words, least = bands * band_rows // 16, least_agreement(bands * band_rows, percent)
    fits = 100 * F.least("p.size", "q.size") >= percent * F.greatest("p.size", "q.size")
    alike = agreeing_slots("p.sketch", "q.sketch", words)
    links = spark.createDataFrame([], "a bigint, b bigint")
    for turn in range(rounds):
        # the centre of a bucket: the class with most company, later any
        rank = F.struct("degree", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"))
        centre = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("node", rank).alias("node")).where("lo <> hi").select("key", "node")
        centre = centre.join(placed.select("node", "size", "sketch", "label").distinct(), "node")
        p, q = placed.alias("p"), centre.alias("q")
        pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.label") != F.col("q.label")) & fits & (alike >= least))
        pairs = pairs.select(F.col("p.node").alias("b"), F.col("q.node").alias("a"), alike.alias("alike")).groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a"))
        links = stored(links.unionByName(confirmed(pairs.select("a", "b"), texts, k, percent)), "links")
        placed = stored(placed.drop("label").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    mixed_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    left = stored(placed.join(mixed_keys, "key").select("node", "size", "label", "sketch").distinct(), "open")
    rest = overlapping(left, texts, k, percent, alike >= least)
    links = links.unionByName(stored(confirmed(rest, texts, k, percent), "links"))
    grouped = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = stored(rows.select("doc_id", "tkey", "node", "n_shingles").join(grouped.join(degree, "node", "left"), "node", "left"), "grouped")
    known = known.withColumn("label", F.coalesce("label", "node"))
    least = known.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = known.join(least, "label", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select(F.col("doc_id").alias(doc_id), "tkey", "n_shingles", component.alias("component_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("doc_id").eqNullSafe(component).alias("kept"))
