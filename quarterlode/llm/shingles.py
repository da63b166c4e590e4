"""Word and shingle hashes of Arrow text columns, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RANDOM = np.random.default_rng(20240501)
#: What a byte counts for in a word's hash; A-Z count as a-z.
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BASE, PIECE = 0x9E3779B97F4A7C15 | 5, 1 << 18
PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.int64).astype(U) * U(2) + U(1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    up = down = np.ones(1, U)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            back = pow(BASE, -1, 1 << 64)
            cls.up, cls.down = (np.multiply.accumulate(np.r_[U(1), np.full(n - 1, b, U)]) for b in (BASE, back))


def _hashed(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of some bytes; a new text begins at each of `breaks`."""
    word = ~SPACE[raw]
    first = np.r_[True, ~word[:-1]]
    first[breaks[breaks < len(raw)]] = True
    start = np.flatnonzero(word & first)
    last = np.r_[first[1:] | ~word[1:], True]
    end = np.flatnonzero(word & last) + 1
    _Powers.upto(len(raw))
    total = np.r_[U(0), np.cumsum(BYTE[raw] * _Powers.up[: len(raw)], dtype=U)]
    return start, mixed((total[end] - total[start]) * _Powers.down[start] + (end - start).astype(U))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts raw[offsets[i]:offsets[i+1]], and how many words come before each text."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        to = min(len(raw), at + PIECE)
        while to < len(raw) and not SPACE[raw[to]]:  # never inside a word
            gap = np.flatnonzero(SPACE[raw[to : to + PIECE]])
            to = to + int(gap[0]) if len(gap) else min(len(raw), to + PIECE)
        inside = offsets[(offsets >= at) & (offsets < to)] - at
        s, h = _hashed(raw[at:to], inside)
        starts.append(s + at)
        hashes.append(h)
        at = to
    start, found = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((starts, np.int64), (hashes, U)))
    return found, np.searchsorted(start, offsets)


def shingle_sets(w: np.ndarray, before: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than `size`, all of them as one."""
    n = len(w)
    full = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        full += w[k : k + len(full)] * PLACE[k]
    full = mixed(full, size)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            yield mixed((w[a:b] * PLACE[: b - a]).sum(dtype=U, keepdims=True), 100 + b - a)
        else:
            yield np.zeros(0, U)


def text_slices(column: pa.Array, most: int = PIECE, rows: int = 1000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about `most` bytes; nulls count as empty."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + rows, len(texts)))
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
