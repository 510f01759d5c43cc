"""Vectorised words and rolling hashes over the bytes of a block of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

from partita.llm.blocks import mix

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], dtype=np.uint64) | np.uint64(1)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)]


def inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_KEPT = 1 << 22  # the longest powers that are kept between blocks


class Powers:
    """Powers of a base modulo 2**64; those of up to ``_KEPT`` steps are kept between blocks."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _made(self, base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = self._made(self.base, n), self._made(inverse(self.base), n)
            if n > _KEPT:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_POWERS: dict[int, Powers] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS.setdefault(base, Powers(base)).to(n)


class Prefix:
    """Polynomial prefix hashes of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def joined(table: pa.Table, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's bytes with a line feed after each document, and where documents begin and end."""
    column = table[text]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # no rows, or more than one array can hold
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    lines = pa.compute.binary_join_element_wise(pa.compute.fill_null(column.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if not len(lines):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(lines.buffers()[1], dtype=np.int64, count=len(lines) + 1, offset=8 * lines.offset)
    data = np.frombuffer(lines.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    return data, at[:-1], at[1:] - 1


class Words:
    """Words (runs of bytes that are not ASCII white space) of a block, with their documents and hashes."""

    def __init__(self, table: pa.Table, lower: bool):
        data, starts, ends = joined(table)
        if lower:
            data = _LOWER[data]
        self.data, self.starts, self.n_docs = data, starts, len(starts)
        word = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, starts)  # the first word of each document
        self.count = np.diff(self.first, append=len(self.start)).astype(np.int64)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self.hash = Prefix(_BYTES[0][data], int(_BASES[0])).of(self.start, self.end)

    def windows(self, k: int) -> np.ndarray:
        """Indices of the words that begin a window of k words of their document."""
        return np.flatnonzero(np.arange(len(self.start)) + k <= (self.first + self.count)[self.doc])

    def window_hash(self, at: np.ndarray, k: int, second: bool = False) -> np.ndarray:
        """Hashes of the windows; the second ones are independent of the first, given the words' hashes."""
        value = mix(self.hash ^ _SECOND) if second else self.hash
        return Prefix(value, int(_BASES[1 - second])).of(at, at + k)
