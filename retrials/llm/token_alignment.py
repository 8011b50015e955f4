"""Alignment of two tokenizers' tokens over the same text, and how often id pairs end together.

Both tokenise the whole text.  Where a token that begins with a space starts in both at one byte, the
tokens before it share their end there: these anchors cut the document into windows of token ids.  A window's
groups depend on its ids alone, so its alignment is kept in a memo under the tuple of ids and
looked up from then on, and equal windows of one block are looked up once.  Groups end where both sides' byte offsets meet.

Tokens that end together have one's bytes end with the other's.  So the pairs that can ever occur are
counted from the two vocabularies, whatever the corpus: up to ``max_pairs`` of them the table of counts
is sent to the tasks, beyond that documents join it.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import BLOCK_BYTES, blocks, byte_views, mixed, powers, stored

FOLDER = "/opt/tokenizers"
# How byte-level files name their split of the text, and that split's pattern.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts over so many characters go to the tokenizers library, whose split has no limit.
LONG_TEXT = 200_000
MEMO_WINDOWS, MEMO_TOKENS = 200_000, 48
_KINDS = "doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, pairs array<bigint>, times array<int>"


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """The two tokenizers and the bytes of each of their tokens, from the contents of their files."""

    _built: dict[bytes, Tokenizers] = {}

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        symbol = byte_symbols()
        model = json.loads(self.a.to_str())
        entries, merges = model["model"]["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(symbol[c] for c in entry) if all(c in symbol for c in entry) else entry.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        # ids in merge order and GPT-2's split: then ranks give the same tokens, several times faster
        special = {x["id"] for x in model["added_tokens"]}
        low = len(set(entries.values()) - special) - len(merges)
        self.ranks = None
        if model["normalizer"] is None and model["pre_tokenizer"] == PRE_TOKENIZER and all(entries["".join(m)] == low + i for i, m in enumerate(merges)):
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if i not in special}, special_tokens={})
        self.length_a, self.length_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.spaced_a, self.spaced_b = (np.array([x[:1] == b" " for x in side]) for side in (self.bytes_a, self.bytes_b))

    @staticmethod
    def of(byte_level: str, pieces: bytes) -> Tokenizers:
        """One for each pair of files in a worker process."""
        key = hashlib.sha256(byte_level.encode() + pieces).digest()
        if key not in Tokenizers._built:
            Tokenizers._built[key] = Tokenizers(byte_level, pieces)
        return Tokenizers._built[key]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        whole = [" " + t for t in texts]
        if self.ranks is None:
            a = [x.ids for x in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        else:
            a = [self.ranks.encode_ordinary(t) if len(t) <= LONG_TEXT else self.a.encode(t, add_special_tokens=False).ids for t in whole]
        return a, self.b.encode(texts, num_threads=1)

    def possible_pairs(self) -> int:
        """Id pairs of which one's bytes end with the other's: no others can end together."""
        def held(side):
            count: dict[bytes, int] = {}
            for x in side:
                count[x] = count.get(x, 0) + 1
            return count
        a, b = held(self.bytes_a), held(self.bytes_b)
        return (sum(n * b.get(x[i:], 0) for x, n in a.items() for i in range(len(x)))
                + sum(n * a.get(x[i:], 0) for x, n in b.items() for i in range(1, len(x))))


class Block:
    """The tokens of some texts, all groups in order, and the windows that the anchors cut them into.

    Groups are found for the block at once: both sides' bytes are the same, so their running totals meet at the
    shared ends and at each end of a text."""

    def __init__(self, t: Tokenizers, a: list[list[int]], b: list[list[int]]):
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(t.length_a[self.a]), np.cumsum(t.length_b[self.b])
        shared, self.last_a, self.last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        texts = np.cumsum([len(x) for x in a])
        #: groups of text i: group_at[i] to group_at[i + 1]
        self.group_at = np.concatenate([[0], np.searchsorted(self.last_a, texts - 1, "right")])
        begin = np.zeros(len(shared), bool)
        if len(shared):
            first_a, first_b = (np.concatenate([[0], x[:-1] + 1]) for x in (self.last_a, self.last_b))
            begin = t.spaced_a[self.a[first_a]] & t.spaced_b[self.b[first_b]]
            begin[self.group_at[:-1][np.diff(self.group_at) > 0]] = True
        #: first group of each window; windows of text i: window_at[i] to window_at[i + 1]
        self.window = np.flatnonzero(begin)
        self.window_at = np.searchsorted(self.window, self.group_at)
        #: first token of each group and window on both sides, and the number of tokens
        self.groups = [np.concatenate([[0], x + 1]) for x in (self.last_a, self.last_b)]
        self.windows = [x[np.append(self.window, len(shared))] for x in self.groups]


_SCRAMBLED = mixed(np.arange(1 << 17, dtype=np.uint64))


def alike(*sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(one of each kind, the kind of each) of the parts that each side's bounds cut its ids into: parts of one kind have equal ids on every side."""
    n = len(sides[0][1]) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sides, key = [(ids, at, np.diff(at)) for ids, at in sides], np.zeros(n, np.uint64)
    for ids, at, size in sides:
        value = _SCRAMBLED[ids] if ids.max() < len(_SCRAMBLED) else mixed(ids.astype(np.uint64))
        place = np.arange(len(ids)) - np.repeat(at[:-1], size)
        key = mixed(key + np.add.reduceat(value * powers(int(size.max()))[place], at[:-1]) + size.astype(np.uint64))
    _, rep, kind = np.unique(key, return_index=True, return_inverse=True)
    same, like = np.ones(n, bool), rep[kind]
    for ids, at, size in sides:  # equal hashes are confirmed on the ids
        same &= size == size[like]
        flat = np.repeat(at[like] - at[:-1], size) + np.arange(len(ids))
        same &= np.logical_and.reduceat(ids == ids[np.minimum(flat, len(ids) - 1)], at[:-1])
    odd = np.flatnonzero(~same)
    kind[odd] = len(rep) + np.arange(len(odd))
    return np.concatenate([rep, odd]), kind


class Aligner:
    """Writes out groups window by window; the memo starts anew when it is full, which changes no result."""

    def __init__(self, tokenizers: Tokenizers):
        self.t, self.width = tokenizers, len(tokenizers.bytes_b)
        self.memo: dict[tuple[bytes, bytes], str] = {}

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids; none for a text that either side doesn't give back.  Ranks always give the bytes back."""
        a, b = self.t.encode(texts)
        for i, (text, x, y) in enumerate(zip(texts, a, b, strict=True)):
            whole = (" " + text).encode()
            kept = (self.t.ranks is not None or b"".join(map(self.t.bytes_a.__getitem__, x)) == whole) and b"".join(map(self.t.bytes_b.__getitem__, y)) == whole
            if not text or not kept:
                a[i], b[i] = [], []
        return a, b

    def written(self, block: Block) -> list[str]:
        """The groups of each text."""
        rep, kind = alike((block.a, block.groups[0]), (block.b, block.groups[1]))
        at_a, at_b = (x.tolist() for x in block.groups)
        names = [f"{','.join(map(str, block.a[at_a[g]: at_a[g + 1]].tolist()))}|{','.join(map(str, block.b[at_b[g]: at_b[g + 1]].tolist()))}" for g in rep.tolist()]
        groups = list(map(names.__getitem__, kind.tolist()))
        ends = np.append(block.window, len(groups))
        rep, kind = alike((kind, ends))
        ids_a, ids_b, known, out = block.a.astype(np.int32).tobytes(), block.b.astype(np.int32).tobytes(), self.memo, []
        (a, a_end), (b, b_end), (g, g_end) = ((x[rep].tolist(), x[rep + 1].tolist()) for x in (*(4 * x for x in block.windows), ends))
        for i in range(len(rep)):
            key = ids_a[a[i]: a_end[i]], ids_b[b[i]: b_end[i]]  # the tuples of ids, packed
            text = known.get(key)
            if text is None:
                text = ";".join(groups[g[i]: g_end[i]])
                if a_end[i] - a[i] + b_end[i] - b[i] <= 4 * MEMO_TOKENS:
                    if len(known) >= MEMO_WINDOWS:
                        known.clear()
                    known[key] = text
            out.append(text)
        texts, at = list(map(out.__getitem__, kind.tolist())), block.window_at.tolist()
        return [";".join(texts[at[i]: at[i + 1]]) for i in range(len(at) - 1)]


def _aligned(files, keep_groups: bool, most: int = BLOCK_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers.of(*files.value))
        gc.disable()  # the memo is large and holds no cycles
        for b in batches:
            _, offsets = byte_views(b.column(1))
            for i, j in blocks(offsets, most):
                part, n = b.slice(i, j - i), j - i
                a, c = aligner.tokens([x or "" for x in part.column(1).to_pylist()])
                block = Block(aligner.t, a, c)
                groups = aligner.written(block)
                digest = [hashlib.sha256(g.encode()).hexdigest() if x else "" for g, x in zip(groups, a, strict=True)]
                # the links of each text, equal ones counted
                size = np.diff(block.group_at)
                pair = block.a[block.last_a] * aligner.width + block.b[block.last_b]
                row = np.repeat(np.arange(n), size)
                order = np.lexsort((pair, row))
                pair, row = pair[order], row[order]
                new = np.ones(len(pair), bool)
                new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                at = pa.array(np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32))
                counts = [pa.array(x, pa.int64()) for x in ([len(x) for x in a], [len(x) for x in c], size, size)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(groups if keep_groups else [None] * n, pa.string()), pa.array(digest, pa.string()),
                     pa.ListArray.from_arrays(at, pa.array(pair[first])), pa.ListArray.from_arrays(at, pa.array(np.diff(np.append(first, len(pair))).astype(np.int32)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"])
    return run


_CARRIED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256")


def _looked_up(table):
    """Add up, per document, how many links are the best of their B id and the counts of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = table.value
        for b in batches:
            lists = b.column(len(_CARRIED))
            at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            mine, times = lists.flatten().to_numpy(), b.column(len(_CARRIED) + 1).flatten().to_numpy().astype(np.int64)
            where = np.searchsorted(pair, mine)
            sums = [np.concatenate([[0], np.cumsum(times * x[where])]) if len(mine) else np.zeros(1, np.int64) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(_CARRIED)], *(pa.array(s[at[1:]] - s[at[:-1]], pa.int64()) for s in sums)], names=[*_CARRIED, "n_best", "count_sum"])
    return run


def align(docs: DataFrame, folder: str = FOLDER, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model", max_pairs: int = 4_000_000,
          keep_groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).  Documents, one row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups (with ``keep_groups``; ids of A, ``|``, ids of B, groups parted by ``;``) and groups_sha256.  Pairs: a_id, b_id, n_links, best.

    A encodes a space and the text, B adds its own space; special tokens' strings are plain text.  A link is a pair of
    tokens that end at one byte; a pair is best if no pair of its B id has more links, ties included.
    Null and empty texts, and texts that either side doesn't give back byte for byte, have no tokens: zeros and
    an empty digest.  A text without anchors is one window, however long, aligned by one merge of its offsets.
    Repeated rows count each; an empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    with open(f"{folder}/{byte_level}", encoding="utf-8") as f, open(f"{folder}/{pieces}", "rb") as g:
        contents = (f.read(), g.read())
    both = Tokenizers.of(*contents)
    width, kind = len(both.bytes_b), docs.schema[doc_id].dataType.simpleString()
    files = spark.sparkContext.broadcast(contents)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(src.mapInArrow(_aligned(files, keep_groups), _KINDS.format(kind)).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    counted = stored(links.groupBy("pair").agg(F.sum("times").alias("n_links")), "pairs")
    most = counted.groupBy((F.col("pair") % width).alias("b_id")).agg(F.max("n_links").alias("most"))
    pairs = counted.withColumn("b_id", F.col("pair") % width).join(most, "b_id").select(
        "pair", F.floor(F.col("pair") / width).cast("long").alias("a_id"), "b_id", "n_links", (F.col("n_links") == F.col("most")).alias("best"))
    pairs = stored(pairs, "counts")
    if both.possible_pairs() <= max_pairs:
        known = pairs.select("pair", "n_links", "best").toArrow().sort_by("pair")
        table = spark.sparkContext.broadcast((known.column("pair").to_numpy(), known.column("n_links").to_numpy(), known.column("best").to_numpy().astype(np.int64)))
        sums = rows.select(*_CARRIED, "pairs", "times").mapInArrow(
            _looked_up(table), f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, n_best bigint, count_sum bigint")
    else:
        summed = links.join(pairs, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_links")).alias("count_sum"))
        sums = rows.drop("pairs", "times").join(summed.select("row", "n_best", "count_sum"), "row", "left").fillna(0, ["n_best", "count_sum"])
    out = sums.select(F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
    return out, pairs.select("a_id", "b_id", "n_links", "best")

