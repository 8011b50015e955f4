"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern over consecutive words; only the words under its ones are hashed, so a
substituted word under a nought doesn't hide a match.  Hashes of the benchmark's words under every
mask are looked up among those of the documents, and around each hit the item and the document are
compared word by word along the hit's diagonal.

Benchmark items are the stated query set: they are taken in blocks of at most ``block_words`` words,
and each block is held against all documents.  A block is what is broadcast, so its size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import NOT_ALNUM, Words, blocks, byte_views, mixed

#: Weight 6.  Every stretch of 13 words or more with over 80 % equal words, wherever the others stand, has a
#: place where all words under one of these are equal (from 13 words on that takes up to 77 words to show:
#: a longer stretch has 13 words with two others at most).
MASKS = ("1110111", "111000001011")
_TABLE_BITS = 22
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def masked(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash under ``mask`` for each start."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out *= _MULTIPLIER
            out += hashes[j: j + n]
    return mixed(out)


def whole_masks(n: int, others: int) -> list[str]:
    """Masks over a whole item of ``n`` words: with up to ``others`` words unequal, one reads equal words only.

    The words are cut into two parts more than that, and each choice of ``others`` parts is left unread."""
    if not others:
        return ["1" * n]
    cuts = [n * k // (others + 2) for k in range(others + 3)]
    return ["".join("0" * (b - a) if k in left else "1" * (b - a) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
            for left in combinations(range(others + 2), others)]


class Block:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], masks=MASKS, min_words: int = 13, tolerance: float = 0.2):
        self.ids = [i for i, _ in items]
        self.penalty, self.min_words = (1 - tolerance) / tolerance, min_words
        data, at = byte_views(pa.array([t for _, t in items], pa.string()))
        words = Words(data, at, lower=True, gaps=NOT_ALNUM)
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        most = lambda n: max(k for k in range(n) if n - k > self.penalty * k)  # noqa: E731  words that may differ
        whole = [(n, mask) for n in sorted({len(w) for w in self.words if 0 < len(w) < min_words}) for mask in whole_masks(n, most(n))]
        self.masks = list(masks) + [mask for _, mask in whole]
        sizes = [None] * len(masks) + [n for n, _ in whole]
        seeds, owner, offset = [], [], []
        for k, w in enumerate(self.words):
            for m, (mask, n) in enumerate(zip(self.masks, sizes, strict=True)):
                if len(w) == n or n is None and len(w) >= max(min_words, len(mask)):
                    h = masked(w, mask, m)
                    seeds.append(h)
                    owner.append(np.full(len(h), k))
                    offset.append(np.arange(len(h)))
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.owner = np.concatenate(owner)[order] if seeds else np.zeros(0, int)
        self.offset = np.concatenate(offset)[order] if seeds else np.zeros(0, int)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.seeds >> np.uint64(64 - _TABLE_BITS)] = True

    def find(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, length, matched words) of the best confirmed overlap for each row and item."""
        if not len(self.seeds) or not len(words.hash):
            return []
        near: set[tuple[int, int, int]] = set()
        for m, mask in enumerate(self.masks):
            h = masked(words.hash, mask, m)
            at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            place = np.repeat(at, n)
            seed = np.repeat(lo, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            row = np.searchsorted(words.first, place, "right") - 1
            inside = place + len(mask) <= words.first[row + 1]
            near.update(zip(row[inside].tolist(), self.owner[seed[inside]].tolist(), (place - self.offset[seed])[inside].tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, start in sorted(near):
            found = self.overlap(words.hash, int(words.first[row]), int(words.first[row + 1]), self.words[item], start)
            if found and found[2] > best.get((row, item), (0, 0, 0))[2]:
                best[row, item] = found
        return [(row, item, a - int(words.first[row]), n, hit) for (row, item), (a, n, hit) in sorted(best.items())]

    def overlap(self, doc: np.ndarray, lo: int, hi: int, item: np.ndarray, start: int) -> tuple[int, int, int] | None:
        """A stretch along one diagonal with over 1 - tolerance of its words equal, of ``min_words`` words, or the whole item, or more.

        It is the best-scoring one, 1 for an equal word, -penalty for another, where that is long
        enough, else the longest with a score above 0."""
        a, b = max(lo, start), min(hi, start + len(item))
        least = max(min(self.min_words, len(item)), 1)
        if b - a < least:
            return None
        same = doc[a:b] == item[a - start: b - start]
        total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -self.penalty))])
        low = np.minimum.accumulate(total)
        end = int(np.argmax(total - low))
        begin = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
        if end - begin < least:
            first = np.searchsorted(-low, -total, "right")  # the first place below each end
            end = int(np.argmax(np.arange(len(total)) - first))
            begin = int(first[end])
            if end - begin < least:
                return None
        return a + begin, end - begin, int(same[begin:end].sum())


def item_blocks(benchmark: DataFrame, block_words: int, item_id: str = "item_id", text: str = "text", **options) -> Iterator[Block]:
    """Blocks of items, streamed to the driver one after another; items without text are left out."""
    held, n = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        size = len(r["t"]) // 2 + 1
        if held and n + size > block_words:
            yield Block(held, **options)
            held, n = [], 0
        held.append((r["i"], r["t"]))
        n += size
    if held:
        yield Block(held, **options)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = 1 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", **options) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, first_word, n_words, n_matched, item_words.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII.  Null and empty
    texts overlap nothing; repeated rows give repeated results; null ids are passed on.  Items of under
    ``min_words`` words are found whole, by the same share of equal words.  An empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = src.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word bigint, n_words bigint, n_matched bigint, item_words bigint"
    out = spark.createDataFrame([], schema)
    item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
    for block in item_blocks(benchmark, block_words, item_id, **options):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                data, at = byte_views(b.column(1))
                for i, j in blocks(at):
                    found = block.find(Words(data, at[i: j + 1], lower=True, gaps=NOT_ALNUM))
                    if found:
                        row, item, first, n, hit = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([i + r for r in row])), pa.array([block.ids[k] for k in item], item_type),
                             *(pa.array(x, pa.int64()) for x in (first, n, hit, [len(block.words[k]) for k in item]))],
                            names=["doc_id", "item_id", "first_word", "n_words", "n_matched", "item_words"])

        out = out.unionByName(src.mapInArrow(run, schema))
    return out.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = 1 << 20, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no item; texts are handled as by ``find_overlaps``."""
    for block in item_blocks(benchmark, block_words, **options):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                data, at = byte_views(b.column(b.schema.get_field_index(text)))
                clean = np.ones(b.num_rows, bool)
                for i, j in blocks(at):
                    for row, *_ in block.find(Words(data, at[i: j + 1], lower=True, gaps=NOT_ALNUM)):
                        clean[i + row] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
