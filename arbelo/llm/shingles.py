r"""Sets of word shingles as 64-bit hashes, for many texts at once.

Words are `[^\x20\x09-\x0D]+` after lower-casing A-Z.  A word's hash mixes its
length and its bytes, eight at a time, each step by a function that is no
polynomial; words of more than `LONG` bytes are hashed by BLAKE2.  All words of a
block of texts take a step together.  A shingle's hash is a polynomial in the
hashes of its words, mixed again.  Memory is bounded by a block of texts, or one
text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts hashed together, and of words that are hashed eight bytes at a time.
BLOCK_BYTES, LONG = 2 << 20, 256
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def fingerprint(flat: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit sum of the mixed hashes of every set that begins at starts (none is empty)."""
    return np.add.reduceat(mixed(flat ^ _MIX[salt]), starts).view(np.int64)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first k bytes of eight, least first.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of `data`: bytes of texts laid end to end, which begin at `starts`."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[-1] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= blank[:-1]
    after[:-1] |= blank[1:]
    begins, ends = np.flatnonzero(before & ~blank), np.flatnonzero(after & ~blank) + 1
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data]
    eight = np.ndarray((len(data) + 1,), "<u8", low.data, strides=(1,))  # the eight bytes from each place on
    size = ends - begins
    out = mixed(size.astype(np.uint64) + _MIX[0])
    i, at, left = np.arange(len(begins)), begins, np.where(size <= LONG, size, 0)
    while len(i):
        out[i] = mixed((out[i] ^ (eight[at] & _HEAD[np.minimum(left, 8)])) * _MIX[0] + _MIX[2])
        more = left > 8
        i, at, left = i[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(low[begins[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out, begins


def _rolled(h: np.ndarray, wide: int) -> np.ndarray:
    last = len(h) - wide + 1
    out = np.full(last, wide, np.uint64)
    for k in range(wide):
        out = out * _MIX[0] + h[k : k + last]
    return mixed(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text of a column, the sorted distinct hashes of its shingles; texts of fewer words give one, without words none."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = column.buffers()[2] if n else None
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        lo = int(offsets[i])
        starts = offsets[i:j] - lo
        h, begins = word_hashes(data[lo : int(offsets[j])], starts)
        counts = np.diff(np.searchsorted(begins, np.append(starts, offsets[j] - lo)))
        first = np.concatenate(([0], np.cumsum(counts)))
        rolled = _rolled(h, size) if len(h) >= size else np.empty(0, np.uint64)
        for a, c in zip(first.tolist(), counts.tolist(), strict=False):
            if c >= size:
                yield _distinct(rolled[a : a + c - size + 1].copy())
            else:
                yield _rolled(h[a : a + c], c) if c else np.empty(0, np.uint64)
        i = j


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.large_string()), size))
