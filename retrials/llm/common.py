"""What the operators share: tables, written intermediates, and words of Arrow text as numpy arrays.

Byte hashes are 64-bit: equal words or windows always hash alike, and every caller confirms what
it links or removes either on the words themselves or says that it trusts 64 bits.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, as the contracts name it, in Java's and RE2's regex syntax.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset, a temporary one is set, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- words of Arrow text in numpy

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset: column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone and whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words (runs without the bytes marked in ``gaps``, ASCII white space by default) of the rows
    between ``offsets``: hashes, byte bounds, and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = _IS_SPACE):
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.base, raw = lo, data[lo:hi]
        inside = ~gaps[raw]
        edge = np.empty(len(raw), bool)
        edge[:1] = True
        edge[1:] = ~inside[:-1]
        cut = offsets[1:-1] - lo
        edge[cut[cut < len(raw)]] = True
        starts = np.flatnonzero(inside & edge)
        last = np.empty(len(raw), bool)
        last[-1:] = True
        last[:-1] = edge[1:] | ~inside[1:]
        self.starts, self.ends = starts, np.flatnonzero(inside & last) + 1
        self.first = np.searchsorted(starts, offsets - lo)
        n = len(starts)
        if n == 0:
            self.hash = np.zeros(0, np.uint64)
            return
        letters = raw[inside]
        if lower:
            letters = _LOWER[letters]
        size = self.ends - starts
        at = np.zeros(n, np.int64)
        np.cumsum(size[:-1], out=at[1:])
        place = np.arange(len(letters)) - np.repeat(at, size)
        self.hash = mixed(np.add.reduceat(_LETTER[letters] * powers(int(size.max()))[place], at))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, by start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += hashes[j: j + n]
    return mixed(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Which starts of ``windows`` keep within one row."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= row_end


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    out, span = h, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == w else np.minimum(out[: len(out) - (w - span)], out[w - span:])
