"""Words of many texts at once, as 64-bit hashes, by whole-array NumPy operations.

A word is a run of bytes that the given table keeps; equal words have equal
hashes in every process. Texts are taken in slices of a bounded number of
bytes, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)

#: Bytes of words between ASCII white space, unchanged.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[0x20, *range(0x09, 0x0E)]] = 0x20
#: Letters and digits in lower case, and bytes beyond ASCII; the rest separates.
FOLDED = np.full(256, 0x20, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        FOLDED[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 256), _STEP, np.uint64)
        _powers[0] = 1
        _powers = np.cumprod(_powers, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about SLICE_BYTES together; a null is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each row and the end, starts, ends) of the words of a slice."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = table[data]
    inside = data != 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    h = np.add.reduceat(_BYTE[data[inside]] * powers(int(lengths.max()))[place], at)
    return mix(h), first, starts, ends


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; those across rows are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= U(0xD6E8FEB86659FD93)
        g += h[j : j + n]
    return mix(g)


def inside_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the grams of a slice lie in one row."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + k, bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[cut >= 0]] = False
    return ok[:n]
