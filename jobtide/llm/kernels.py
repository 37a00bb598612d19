"""Vectorised text kernels for Arrow batches: words, word hashes, shingles and MinHash.

Words are runs of bytes other than space and tab to carriage return; only A-Z are lower-cased. A batch is
worked on in slices of a MB (never less than one text), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

_RNG = np.random.default_rng(20_240_117)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# Separators for words without their punctuation: every ASCII byte that is neither a letter nor a digit.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(max(n, SLICE_BYTES), base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of some texts: text ``i`` has words ``first[i]`` to ``first[i + 1]``, as byte spans of ``data``."""

    data: np.ndarray
    begin: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def content(self, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit hash, in two halves, of each run of words ``starts`` to ``stops``, by their hashes."""
        up, down = _powers(len(hashes) + 1)
        out = []
        for own in (hashes, mix(hashes ^ np.uint64(0x5851F42D4C957F2D))):
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * up[: len(own)], out=total[1:])
            out.append(mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64)).view(np.int64))
        return out[0], out[1]

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same in every task."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from row, to row, bytes, offsets)`` of a text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        to = min(to, len(column))
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words(data: np.ndarray, begin: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    low = _LOWER[data]
    blank = separators[low]
    n = len(low)
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = blank
    before[begin] = True  # a text's first byte starts a word
    if n:
        after[: n - 1] = blank[1:]
        after[begin[1:][begin[1:] > 0] - 1] = True
    starts = np.flatnonzero(~blank & before[:n])
    ends = np.flatnonzero(~blank & after[:n]) + 1
    return Words(low, begin, starts, ends, np.searchsorted(starts, begin))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of one text; of the whole sequence where it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(k, n)
    out = hashes[: n - size + 1] * _PLACE[0]
    for j in range(1, size):
        out = out + hashes[j : n - size + 1 + j] * _PLACE[j]
    return mix(out + np.uint64(size))


@dataclass(frozen=True)
class Banding:
    """MinHash in bands: ``bands`` keys of ``rows`` minima each. A pair of similarity s shares a key with
    probability 1 - (1 - s**rows)**bands."""

    bands: int
    rows: int
    seed: int = 7

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        count = self.bands * self.rows
        object.__setattr__(self, "_factor", rng.integers(1, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
        object.__setattr__(self, "_mask", rng.integers(0, 2**32, count, dtype=np.uint32))
        object.__setattr__(self, "_weight", rng.integers(1, 2**63, self.rows, dtype=np.uint64) | np.uint64(1))
        object.__setattr__(self, "_tag", mix(np.arange(1, self.bands + 1, dtype=np.uint64)))

    def keys(self, distinct: np.ndarray) -> np.ndarray:
        """The band keys of a non-empty set of 64-bit hashes, as signed integers."""
        low = None
        for at in range(0, len(distinct), 4096):
            part = distinct[at : at + 4096]
            a, b = part.astype(np.uint32)[:, None], (part >> np.uint64(32)).astype(np.uint32)[:, None]
            own = (a * self._factor + (b ^ self._mask)).min(axis=0)
            low = own if low is None else np.minimum(low, own)
        return self._join(low)

    def keys_of_runs(self, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """(runs, bands): the band keys of each run ``hashes[start:stop]``; the runs are not empty."""
        a, b = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        edges = np.stack([starts, np.minimum(stops, len(hashes) - 1)], axis=1).ravel()
        low = np.empty((len(starts), len(self._factor)), np.uint32)
        for j, (factor, mask) in enumerate(zip(self._factor, self._mask)):
            value = a * factor + (b ^ mask)
            low[:, j] = np.minimum.reduceat(value, edges)[::2]
            at_end = stops == len(hashes)  # reduceat cannot be told to stop behind the last place
            low[at_end, j] = np.minimum(low[at_end, j], value[-1])
        return self._join(low)

    def _join(self, low: np.ndarray) -> np.ndarray:
        """Band keys from minima; the last axis of ``low`` has all of a set."""
        parts = mix(low.astype(np.uint64) + np.uint64(1)).reshape(*low.shape[:-1], self.bands, self.rows)
        return mix((parts * self._weight).sum(axis=-1, dtype=np.uint64) ^ self._tag).view(np.int64)
