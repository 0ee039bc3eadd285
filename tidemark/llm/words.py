"""Words of whole Arrow batches as offset and hash arrays.

The bytes of a column are classified with one table look-up, so no Python object is made for a
word. A batch is walked in pieces of about ``PIECE`` bytes, cut between words, which bounds the
scratch memory for any text length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

# A byte of a word after lower-casing A-Z: digits, a-z and all of the multi-byte characters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[ord("0"): ord("9") + 1] = True
IS_WORD[ord("a"): ord("z") + 1] = True
IS_WORD[0x80:] = True

_BYTE_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(4096, _BYTE_STEP, dtype=np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``n + 1`` offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


@dataclass
class Words:
    """Words of some consecutive rows. ``first`` has the first word of each row, and the end."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, lo: int, hi: int) -> str:
        """Words ``lo`` to ``hi`` joined by spaces."""
        return b" ".join(
            self.data[a:b].tobytes() for a, b in zip(self.start[lo:hi], self.end[lo:hi])
        ).decode()


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    lengths = end - start
    inside = np.arange(int(lengths.sum()), dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    inside -= np.repeat(begins, lengths)
    at = inside + np.repeat(start, lengths)
    values = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[inside % len(_POWERS)]
    values += (inside // len(_POWERS)).astype(np.uint64) * np.uint64(0x100000001B3)
    return mix(np.add.reduceat(values, begins) + lengths.astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of rows whose bytes are ``data`` and whose bounds are ``offsets``."""
    data = LOWER[data]
    starts, ends, hashes = [], [], []
    size, lo = len(data), 0
    inner = np.unique(offsets)
    while lo < size:
        hi = min(lo + PIECE, size)
        while hi < size and IS_WORD[data[hi]] and IS_WORD[data[hi - 1]]:
            # go on to the end of the word
            gap = np.flatnonzero(~IS_WORD[data[hi: hi + PIECE]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + PIECE, size)
        flag = IS_WORD[data[lo:hi]]
        before = np.empty(hi - lo, dtype=bool)
        before[0] = False
        before[1:] = flag[:-1]
        cuts = inner[(inner > lo) & (inner < hi)] - lo
        before[cuts] = False
        s = np.flatnonzero(flag & ~before)
        if len(s):
            after = np.empty(hi - lo, dtype=bool)
            after[-1] = False
            after[:-1] = flag[1:]
            after[cuts - 1] = False
            e = np.flatnonzero(flag & ~after) + 1
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(_word_hashes(data, s + lo, e + lo))
        lo = hi

    def joined(parts: list, kind) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    start = joined(starts, np.int64)
    return Words(data, start, joined(ends, np.int64), joined(hashes, np.uint64),
                 np.searchsorted(start, offsets))


def row_groups(offsets: np.ndarray, most: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position; rows are not told apart here."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, power = np.zeros(n, np.uint64), np.uint64(1)
    for j in range(k):
        total += words[j: j + n] * power
        power = np.uint64((int(power) * int(_WORD_STEP)) % 2**64)
    return mix(total + np.uint64(k))
