"""Vectorised numpy kernels over Arrow string columns: words, word hashes, shingles.

All work is on UTF-8 bytes: every separator is ASCII, so bytes of multi-byte characters never split a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 400_000

_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _byte_values(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    return mix(code + np.uint64(0x51ED270B))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def separators(kind: str) -> np.ndarray:
    """``space``: the bytes 0x20 and 0x09-0x0D. ``alnum``: all ASCII but letters and digits."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:128] = True
        for low, high in ((48, 58), (65, 91), (97, 123)):
            sep[low:high] = False
    return sep


class Texts:
    """A run of texts as one byte array; null is the empty text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: str = "space", *, lower: bool = False, data: np.ndarray | None = None) -> "Words":
        data = self.data if data is None else data
        sep = separators(kind)[data]
        before = np.empty(len(data), bool)
        before[1:] = sep[:-1]
        after = np.empty(len(data), bool)
        after[:-1] = sep[1:]
        if len(data):
            before[0] = after[-1] = True
            firsts = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
            before[firsts] = True
            lasts = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
            after[lasts] = True
        starts = np.flatnonzero(~sep & before)
        ends = np.flatnonzero(~sep & after) + 1
        up, down = _power_tables(len(data))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_byte_values(lower)[data] * up[: len(data)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
        return Words(starts, ends, hashes, np.searchsorted(starts, self.offsets))


class Words:
    """Words of a run of texts: byte ranges, hashes, and ``bounds[d]:bounds[d + 1]`` as the words of text d."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.hashes, self.bounds = starts, ends, hashes, bounds
        self.counts = np.diff(bounds)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the k-word windows, the word each begins at, and the bounds of each text's windows."""
        n = len(self.hashes)
        ends = np.repeat(self.bounds[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + k <= ends)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * np.uint64(_R) + self.hashes[at + j]
        bounds = np.concatenate([[0], np.cumsum(np.maximum(self.counts - k + 1, 0))])
        return mix(h + np.uint64(k)), at, bounds


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[slice, Texts]]:
    """Runs of whole texts of about ``size`` bytes, with the rows that they stand for."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        low, high = offsets[begin], offsets[end]
        yield slice(begin, end), Texts(data[low:high], offsets[begin : end + 1] - low)
        begin = end


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte position, and in all."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
