"""Byte-exact substring dedup on a sparse, distributed suffix array.

A suffix is kept for each *anchor* only: the place of the least hash among the byte runs of a window of
``length`` bytes.  Equal windows have their anchors at equal offsets, so it is enough to compare the
windows of one anchor with those of equal anchors.  Anchors that occur once are dropped (Spark counts them;
a bitmap of fixed size keeps the rest of the corpus off the shuffle).  A suffix carries the bytes of
the windows that it owns.  Suffixes are range-partitioned by their leading tokens, with splitters
that Spark samples; a bucket is sorted by multikey quicksort, token by token and only among ties.
A suffix's longest match with its neighbours limits which of its windows can repeat; the rest are matched by
hash within the run of equal tokens, and every match is confirmed on the bytes.

A range never parts suffixes of equal leading tokens, so no match crosses a boundary between buckets; a
bucket is read in sorted order in parts that end where the tokens change.  Equal suffixes met in
one batch of documents are settled there and one of them travels.  Anchors with over ``hot_rows`` places are
salted by the offset of the window, which equal windows share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import BLOCK_BYTES, blocks, byte_views, mixed, powers, sliding_min, stored
from retrials.llm.repeated_passages import Filter

LEADING_BYTES = 16
SALT_WIDTH = 16
_PLACE_BITS = np.uint64(22)
_BASE = np.uint64(0xF1357AEA2E62A9C5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))


def gram_bytes(length: int) -> int:
    """Bytes that an anchor is hashed from."""
    return max(length * 8 // 25, 1)


def pieces(offsets: np.ndarray, length: int, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first byte, last byte, row bounds, rows, place of the first byte in its row); a row of more than ``most``
    bytes comes in pieces that overlap by ``length - 1`` bytes, so that each window lies whole in one."""
    for i, j in blocks(offsets, most):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= most or j - i > 1:
            yield lo, hi, offsets[i: j + 1] - lo, np.arange(i, j), 0
        else:
            for at in range(lo, max(hi - length + 1, lo + 1), most):
                end = min(at + most + length - 1, hi)
                yield at, end, np.array([0, end - at]), np.array([i]), at - lo


class Windows:
    """The windows of one piece: their starts and the place of each one's anchor."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int):
        n, k = len(data), gram_bytes(length)
        self.length, self.bounds = length, bounds
        if n < length:
            self.starts = self.owner = np.zeros(0, np.int64)
            return
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(n, _BASE), out=self.sums[1:])
        self.back = powers(n + 1, _INVERSE)
        self.gram = mixed((self.sums[k:] - self.sums[:-k]) * self.back[: n - k + 1])
        low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
        placed = (self.gram & ~low) | np.arange(len(self.gram), dtype=np.uint64)
        least = sliding_min(placed, length - k + 1)
        ends = np.repeat(bounds[1:], np.diff(bounds))[: n - length + 1]
        self.starts = np.flatnonzero(np.arange(n - length + 1) + length <= ends)
        self.owner = (least[self.starts] & low).astype(np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, anchor) for each anchor."""
        if not len(self.starts):
            return self.starts, self.starts, self.owner
        new = np.ones(len(self.starts), bool)
        new[1:] = (np.diff(self.owner) != 0) | (np.diff(self.starts) != 1)
        at = np.flatnonzero(new)
        return self.starts[at], self.starts[np.append(at[1:], len(new)) - 1], self.owner[at]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_views(b.column(1))
            for lo, hi, bounds, _, _ in pieces(offsets, length):
                w = Windows(data[lo:hi], bounds, length)
                _, _, anchor = w.runs()
                if len(anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(w.gram[anchor].view(np.int64))], names=["anchor"])
    return run


_SUFFIX = "tkey bigint, start bigint, last bigint, ahead bigint, settled boolean, salt bigint, lead binary, bytes binary"


def _suffix_rows(length: int, anchors, hot):
    """Suffixes of the anchors that repeat; of equal ones in a piece, all are settled and one carries its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = byte_views(b.column(1))
            for lo, hi, bounds, rows, shift in pieces(offsets, length):
                raw = data[lo:hi]
                w = Windows(raw, bounds, length)
                first, last, anchor = w.runs()
                held = anchors.value.may_hold(w.gram[anchor]) if len(anchor) else np.zeros(0, bool)
                first, last, anchor = first[held], last[held], anchor[held]
                if not len(anchor):
                    continue
                salt = np.full(len(anchor), -1)
                salted = hot.value.may_hold(w.gram[anchor])
                if salted.any():
                    parts = [(a, z, p, -1) for a, z, p in zip(first[~salted], last[~salted], anchor[~salted], strict=True)]
                    for a, z, p in zip(first[salted].tolist(), last[salted].tolist(), anchor[salted].tolist(), strict=True):
                        for s in range((p - z) // SALT_WIDTH, (p - a) // SALT_WIDTH + 1):
                            parts.append((max(a, p - s * SALT_WIDTH - SALT_WIDTH + 1), min(z, p - s * SALT_WIDTH), p, s))
                    first, last, anchor, salt = (np.array(x) for x in zip(*parts, strict=True))
                whole = (w.sums[last + length] - w.sums[first]) * w.back[first]
                whole = mixed(mixed(whole + (anchor - first).astype(np.uint64)) + (last - first).astype(np.uint64))
                _, rep, of, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                settled, sent = count[of] > 1, np.zeros(len(anchor), bool)
                sent[rep] = True
                row = np.searchsorted(bounds, first, "right") - 1
                place = first - bounds[row] + shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[rows[row]]), pa.array(place), pa.array(place + last - first), pa.array(anchor - first), pa.array(settled), pa.array(salt),
                     pa.array([raw[p: p + LEADING_BYTES].tobytes() if s else None for p, s in zip(anchor, sent, strict=True)], pa.binary()),
                     pa.array([raw[a: z + length].tobytes() if s else None for a, z, s in zip(first, last, sent, strict=True)], pa.binary())],
                    names=["tkey", "start", "last", "ahead", "settled", "salt", "lead", "bytes"])
    return run


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of ``tokens`` (n x depth): the parts that tie on a token, and only they, are parted by the next."""
    order = np.argsort(tokens[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(tokens[order[1:], 0] != tokens[order[:-1], 0])
    for depth in range(1, tokens.shape[1]):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        token = tokens[order[at], depth]
        moved = np.lexsort((token, group[at]))
        order[at] = order[at][moved]
        token = token[moved]
        new = np.zeros(len(order), np.int64)
        inner = np.flatnonzero(np.diff(at) == 1) + 1
        new[at[inner]] = (token[inner] != token[inner - 1]) & same[at[inner] - 1]
        new[1:] |= ~same
        group = np.cumsum(new)
    return order


def repeated_runs(texts: list[bytes], ahead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the suffixes that occur in another of them too, as (suffix, first, last) window start within the suffix's bytes.

    ``ahead``: bytes before the anchor."""
    n, left = len(texts), length - gram_bytes(length)
    size = np.array([len(t) for t in texts])
    # one row a suffix, its anchor in column ``left``
    grid = np.zeros((n, left + (length + 7) // 8 * 8), np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    col = np.arange(len(flat)) - np.repeat(begin - (left - ahead), size)
    grid[np.repeat(np.arange(n), size), col] = flat
    order = multikey_quicksort(np.ascontiguousarray(grid[:, left:]).view(">u8"))
    grid = grid[order]
    differs = grid[1:, left: left + length] != grid[:-1, left: left + length]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    reach = np.zeros(n, np.int64)
    reach[1:] = common
    reach[:-1] = np.maximum(reach[:-1], common)
    starts = np.arange(left + 1)
    lo, hi = (left - ahead[order])[:, None], (left - ahead + size - length)[order][:, None]
    held = (starts >= lo) & (starts <= hi) & (starts + length - left <= reach[:, None])
    row, start = np.nonzero(held)
    if not len(row):
        return row, row, row
    sums = np.zeros((n, grid.shape[1] + 1), np.uint64)
    np.cumsum(_VALUE[grid] * powers(grid.shape[1], _BASE), axis=1, out=sums[:, 1:])
    key = mixed(mixed(sums[row, start + length] - sums[row, start]) + start.astype(np.uint64))
    by = np.lexsort((row, key))
    key, row, start = key[by], row[by], start[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    other = np.flatnonzero(~new)
    a, z = row[head[other]], row[other]
    # confirm on the bytes: how far the two suffixes agree to either side of the anchor
    pair, of = np.unique(a * np.int64(n) + z, return_inverse=True)
    good = np.zeros(len(other), bool)
    behind, before = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    for at in range(0, len(pair), 4096):
        x, y = grid[pair[at: at + 4096] // n], grid[pair[at: at + 4096] % n]
        no = x != y
        right, lefts = no[:, left: left + length], no[:, :left][:, ::-1]
        behind[at: at + 4096] = np.where(right.any(axis=1), right.argmax(axis=1), length)
        before[at: at + 4096] = np.where(lefts.any(axis=1), lefts.argmax(axis=1), left) if left else 0
    good = (left - start[other] <= before[of]) & (start[other] + length - left <= behind[of])
    matched = np.zeros((n, left + 2), bool)
    matched[row[other[good]], start[other[good]]] = True
    first = head[other[good]]
    matched[row[first], start[first]] = True
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), matched.astype(np.int8)], axis=1), axis=1)
    r, a = np.nonzero(edge == 1)
    _, z = np.nonzero(edge == -1)
    back = left - ahead[order[r]]
    return order[r], a - back, z - 1 - back


def _matched(length: int, part_rows: int = 2000):
    def settle(rows: pa.Table) -> pa.RecordBatch:
        of, a, z = repeated_runs(rows.column("bytes").to_pylist(), rows.column("ahead").to_numpy(), length)
        start, key = rows.column("start").to_numpy(), rows.column("tkey").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(start[of] + a), pa.array(start[of] + z + length)], names=["tkey", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            leads = np.array(b.column(b.schema.get_field_index("lead")).to_pylist(), object)
            salts = b.column(b.schema.get_field_index("salt")).to_numpy()
            cuts = np.flatnonzero((leads[1:] != leads[:-1]) | (salts[1:] != salts[:-1])) + 1
            if held:
                tail = held[-1].slice(held[-1].num_rows - 1)
                if (tail.column("lead")[0].as_py(), tail.column("salt")[0].as_py()) != (leads[0], salts[0]):
                    cuts = np.concatenate([[0], cuts])
            done = 0
            for cut in cuts:
                if sum(t.num_rows for t in held) + cut - done >= part_rows:
                    held.append(rows.slice(done, cut - done))
                    yield settle(pa.concat_tables(held))
                    held, done = [], int(cut)
            held.append(rows.slice(done))
        if held:
            yield settle(pa.concat_tables(held))
    return run


def repeated_spans(first: DataFrame, length: int, hot_rows: int = 1000) -> DataFrame:
    """(tkey, start, stop): byte ranges made of windows that occur elsewhere.  ``first``: (tkey, text), each text once."""
    sc = first.sparkSession.sparkContext
    seen = stored(first.mapInArrow(_anchor_rows(length), "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    anchors, hot = sc.broadcast(Filter.of(seen, "anchor")), sc.broadcast(Filter.of(seen.where(F.col("n") > hot_rows), "anchor"))
    suffixes = stored(first.mapInArrow(_suffix_rows(length, anchors, hot), _SUFFIX), "suffixes")
    buckets = suffixes.where("bytes is not null").select("lead", "salt", "tkey", "start", "ahead", "bytes").repartitionByRange("lead", "salt")
    found = buckets.sortWithinPartitions("lead", "salt").mapInArrow(_matched(length), "tkey bigint, start bigint, stop bigint")
    return suffixes.where("settled").select("tkey", "start", (F.col("last") + length).alias("stop")).unionByName(found)


def _without(raw: bytes, spans, whole: bool) -> tuple[bytes, int]:
    """What is left without the spans, and how many runs went; ``whole``: everything goes."""
    merged: list[list[int]] = []
    for s in [(0, len(raw))] if whole else sorted((x["start"], x["stop"]) for x in spans or ()):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append([s[0], s[1]])
    cuts = [0, *(x for s in merged for x in s), len(raw)]
    return b"".join(raw[cuts[i]: cuts[i + 1]] for i in range(0, len(cuts), 2)), len(merged)


def _cut_bytes(length: int, as_text: bool, passages: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                size, gone, runs, kept, rest = [], [], [], [], []
                for text, spans, shorter, copy in zip(*(c.to_pylist() for c in part.columns[1:5]), strict=True):
                    raw = (text or "").encode()
                    left, n = _without(raw, spans, copy and len(raw) >= length)
                    size.append(len(raw))
                    gone.append(len(raw) - len(left))
                    runs.append(n)
                    kept.append(left.decode(errors="ignore") if as_text else left)
                    rest.append(_without(raw, shorter, copy and len(raw) >= passages)[0].decode(errors="ignore") if passages else None)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(rest, pa.string()), *part.columns[5:]],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "left_text", *part.schema.names[5:]])
    return run


def longest_run(spans: Column) -> Column:
    """Bytes of the longest run that the spans cover together."""
    step = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("stop"), F.lit(0).cast("long").alias("most")),
                       lambda a, x: F.struct(F.when(x["start"] <= a["stop"], a["start"]).otherwise(x["start"]).alias("start"), F.greatest(a["stop"], x["stop"]).alias("stop"),
                                             F.greatest(a["most"], F.greatest(a["stop"], x["stop"]) - F.when(x["start"] <= a["stop"], a["start"]).otherwise(x["start"])).alias("most")))
    return step["most"]


def remove_repeated_bytes(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), as_text: bool = False, passages: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes), and the columns named in ``carry``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    or another row; strings are judged on the input.  Null and empty texts have no bytes.  A text that
    several rows hold loses all its bytes (from ``length`` bytes on) in each of them without a
    search; of each text one is searched.  Ids are passed on, null and repeated ones included.  With
    ``as_text``, kept is a string, without the bytes of characters that a cut has parted.

    With ``passages`` (under ``length``), left_text is the text without all that repeats in strings of that many bytes.
    A string of ``length`` bytes only repeats within a run of such strings, so just the texts with a run of
    ``length`` bytes are searched again.  Texts of over a megabyte are searched in overlapping pieces; an empty table gives no rows."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    copies = stored(src.groupBy("tkey").agg(F.count("*").alias("n")).where("n > 1").select("tkey", F.lit(True).alias("copy")), "copies")
    # texts held several times enter the search once, beside it: one row of each
    plain = src.select("tkey", "text").join(copies, "tkey", "left_anti")
    once = src.select("tkey", "text").join(copies, "tkey", "left_semi").groupBy("tkey").agg(F.first("text").alias("text"))
    first, listed = plain.unionByName(once), F.collect_list(F.struct("start", "stop"))
    if passages:
        shorter = stored(repeated_spans(first, passages).groupBy("tkey").agg(listed.alias("shorter")), "passages")
        first = first.join(shorter.where(longest_run(F.col("shorter")) >= length).select("tkey"), "tkey", "left_semi")
    spans = repeated_spans(first, length).groupBy("tkey").agg(listed.alias("spans"))
    spans = spans.join(shorter, "tkey", "full") if passages else spans.withColumn("shorter", F.lit(None).cast(spans.schema["spans"].dataType))
    known = stored(spans.join(copies, "tkey", "full"), "spans")
    out = src.join(known, "tkey", "left").select("doc_id", "text", "spans", "shorter", F.coalesce("copy", F.lit(False)).alias("copy"), *(f"carry_{c}" for c in carry))
    kinds = "".join(f", carry_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    cut = out.mapInArrow(_cut_bytes(length, as_text, passages), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}, left_text string{kinds}")
    return cut.select(F.col("doc_id").alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept", *(["left_text"] if passages else []), *(F.col(f"carry_{c}").alias(c) for c in carry))
