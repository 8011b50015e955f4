"""First 60 bits of the MD5 of many short keyed texts at once, as ``keys.hash60`` gives them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_FIRST = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_TURNS = tuple(tuple((np.array(s, np.uint32), np.array(32 - s, np.uint32)) for s in four) for four in _SHIFTS)
#: Texts that are hashed together: their words stay in a core's cache.  Of a slot with more digits, the lowest are looked up.
TILE, LOW_DIGITS = 40_000, 4
LOW = 10**LOW_DIGITS


def _mixed(f: np.ndarray, turn: int, b, c, d) -> None:
    """The round's mix of three words of the state, into ``f``."""
    if turn == 0:
        np.bitwise_xor(c, d, out=f)
        f &= b
        f ^= d
    elif turn == 1:
        np.bitwise_xor(b, c, out=f)
        f &= d
        f ^= c
    elif turn == 2:
        np.bitwise_xor(b, c, out=f)
        f ^= d
    else:
        np.invert(d, out=f)
        f |= b
        f ^= c


def _block(state, words, shape) -> tuple[np.ndarray, ...]:
    """MD5's compression of one 64-byte block; ``words``: 16 numbers or arrays that broadcast to ``shape``.

    Steps before the first word that differs along a row are made once a row."""
    first = next((k for k in range(16) if np.ndim(words[k]) and np.shape(words[k])[-1] > 1), 16)
    if any(np.shape(x)[-1:] not in ((), (1,)) for x in state):
        first = 0
    narrow = (*shape[:-1], 1)
    a, b, c, d = (np.broadcast_to(x, narrow if first else shape).copy() for x in state)
    f, t = np.empty(a.shape, np.uint32), np.empty(a.shape, np.uint32)
    for i in range(64):
        if i == first and i:
            a, b, c, d = (np.broadcast_to(x, shape).copy() for x in (a, b, c, d))
            f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        turn = i // 16
        _mixed(f, turn, b, c, d)
        k = (i, (5 * i + 1) % 16, (3 * i + 5) % 16, (7 * i) % 16)[turn]
        f += a
        f += words[k] + _SINES[i]
        left, right = _TURNS[turn][i % 4]
        np.left_shift(f, left, out=t)
        f >>= right
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return tuple(x + y for x, y in zip(state, (a, b, c, d), strict=True))


def _digits(first: int, last: int) -> Iterator[tuple[int, int]]:
    """The parts of first..last whose numbers have equally many digits."""
    while first <= last:
        end = min(last, 10 ** len(str(first)) - 1)
        yield first, end
        first = end + 1


@lru_cache(maxsize=64)
def _written(first: int, last: int, at: int, size: int) -> dict[int, np.ndarray]:
    """Words (by place) that hold the ``size`` lowest decimal digits of first..last from byte ``at``."""
    numbers, words = np.arange(first, last + 1), {}
    for j in range(size):
        digit = (numbers // 10 ** (size - 1 - j) % 10 + 48).astype(np.uint32)
        word, shift = divmod(at + j, 4)
        words[word] = words.get(word, np.uint32(0)) + (digit << np.uint32(8 * shift))
    return words


def pair_hashes(start: str, d0: int, d1: int, lo: int, hi: int) -> np.ndarray:
    """hash60 of ``<start><d>:<i>`` for d in d0..d1 (rows) and i in lo..hi (columns)."""
    out = np.empty((d1 - d0 + 1, hi - lo + 1), np.int64)
    head = start.encode()
    with np.errstate(over="ignore"):
        for first, last in _digits(lo, hi):
            if first < LOW:
                spans = [(first, last)]
            else:  # the lowest digits come from a table
                spans = [(max(first, at), min(last, at + LOW - 1)) for at in range(first // LOW * LOW, last + 1, LOW)]
            for da, db in _digits(d0, d1):
                asked = sorted(((d, span) for d in range(da, db + 1) for span in spans), key=lambda x: _low(x[1]))
                for _, same in groupby(asked, key=lambda x: _low(x[1])):
                    alike = list(same)
                    deep = max(1, TILE // (alike[0][1][1] - alike[0][1][0] + 1))
                    for at in range(0, len(alike), deep):
                        _tile(head, alike[at: at + deep], lo, d0, out)
    return out


def _low(span: tuple[int, int]) -> tuple[int, int]:
    return span[0] % LOW, span[1] % LOW


def _tile(head: bytes, asked: list[tuple[int, tuple[int, int]]], lo: int, d0: int, out: np.ndarray) -> None:
    """Hashes of some draws and spans of slots, all with the same lowest digits and equally long."""
    d, (first, last) = asked[0]
    high = max(0, len(str(first)) - LOW_DIGITS) if first >= LOW else 0
    at, low = len(head) + len(str(d)) + 1 + high, len(str(first)) - high
    size = at + low
    ends = bytes(low) + b"\x80" + bytes(-(size + 9) % 64) + (8 * size).to_bytes(8, "little")
    texts = b"".join(head + str(d).encode() + b":" + (str(x // LOW).encode() if high else b"") + ends for d, (x, _) in asked)
    rows = np.frombuffer(texts, "<u4").reshape(len(asked), -1)
    words: list = [rows[0, k] if (rows[:, k] == rows[0, k]).all() else rows[:, k: k + 1].copy() for k in range(rows.shape[1])]
    for k, part in _written(first % LOW, last % LOW, at, low).items():
        words[k] = words[k] + part
    state = _FIRST
    for k in range(0, len(words), 16):
        state = _block(state, words[k: k + 16], (len(asked), last - first + 1))
    a, b = (np.broadcast_to(x, (len(asked), last - first + 1)).byteswap() for x in state[:2])
    hashes = a.astype(np.int64)
    hashes <<= 28
    b >>= 4
    hashes |= b
    for row, (d, (x, y)) in zip(hashes, asked, strict=True):
        out[d - d0, x - lo: y - lo + 1] = row


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^28 in groups of seven bits, the lowest first."""
    v = values.astype(np.uint32)
    size = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[at] = (v & 127) | ((size > 1).astype(np.uint32) << 7)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[at[more] + k] = ((v[more] >> np.uint32(7 * k)) & 127) | ((size[more] > k + 1).astype(np.uint32) << 7)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` was given."""
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128)
    if len(end) == len(raw):
        return raw.astype(np.int64)
    at = np.concatenate([[0], end[:-1] + 1])
    size = end - at + 1
    out = (raw[at] & 127).astype(np.int64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= (raw[at[more] + k] & 127).astype(np.int64) << (7 * k)
    return out
