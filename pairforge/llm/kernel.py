"""Words and their hashes straight from the bytes of a batch of texts, without a Python object for each word.

A batch of texts is one array of UTF-8 bytes with the offsets of its texts. Words are runs of bytes other than 0x20 and
0x09 to 0x0D. Hashes are polynomials modulo 2^64, so that any run's hash is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of values[start:end] for each pair."""
    n = len(values)
    up, down = powers(base, n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(values * up[:n], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of consecutive texts. `at` has the first word of each text, and the number of words at its end."""

    data: np.ndarray  #: bytes, lower-cased if asked
    offsets: np.ndarray  #: texts' offsets in data
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def text(self) -> np.ndarray:
        """The text of each word, counted from the batch's first."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data.astype(U) + U(1), self.starts, self.ends)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    space = IS_SPACE[data]
    n = len(data)
    if not n:
        return Words(data, offsets, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    last = inside.copy()
    last[:-1] &= space[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(LOWER[data] if lower else data, offsets, starts, ends, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer text comes alone. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    buffers = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], (offsets[at : end + 1] - offsets[at]).astype(np.int64)
        at = end


def ngram_sums(of: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` word hashes inside one text, and the position of its first word, as (hashes, positions)."""
    n = len(of)
    if n < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    fits = np.ones(n - width + 1, bool)
    for k in range(1, width):  # a run must not cross the end of a text
        cut = at[(at >= k) & (at < n - width + 1 + k)] - k
        fits[cut] = False
    starts = np.flatnonzero(fits)
    return run_hashes(of, starts, starts + width, 0xC2B2AE3D27D4EB4F), starts
