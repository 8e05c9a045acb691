"""Words and their hashes over Arrow text columns, whole columns at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Text is read in slices of bounded size (:func:`slices`), one text at least,
so that the arrays below stay small however large Spark's batches are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
#: an odd base; powers of it and of its inverse turn one cumulative sum into the hash of any span
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(BASE))


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


POWERS = _Powers()


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end] for many spans; equal spans have equal hashes wherever they lie."""
    up, down = POWERS.get(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named text column has at most ``limit`` bytes, or one row, in each."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        filled = batch.column(at).cast(pa.large_string()).fill_null("")
        batch = batch.set_column(at, column, filled)
        offsets = _offsets(filled)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def _offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)


class Words:
    """The words of a text column without nulls: row r has words first[r]:first[r + 1]; word w is data[start[w]:end[w]].

    ``blank`` says for each byte whether it parts words; words also end between bytes of ``kinds`` 1 and 2.
    """

    def __init__(self, col: pa.Array, lower: bool = False, blank: np.ndarray = SPACE, kinds: np.ndarray | None = None):
        offsets = _offsets(col)
        raw = col.buffers()[2] if len(col) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~blank[data]
        before, after = solid[:-2].copy(), solid[2:].copy()
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(data))]
        before[inner] = False
        after[inner - 1] = False
        if kinds is not None and len(data):
            kind = kinds[data]
            turn = kind[1:] * kind[:-1] == 2
            before[1:] &= ~turn
            after[:-1] &= ~turn
        self.start = np.flatnonzero(solid[1:-1] & ~before)
        self.end = np.flatnonzero(solid[1:-1] & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.first) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(BYTE_CODE[self.data], self.start, self.end)

    def row(self, r: int) -> slice:
        return slice(self.first[r], self.first[r + 1])

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=total[1:])
        return total[self.end] - total[self.start]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; fewer words count as one shingle, no words as none."""
    if len(hashes) <= n:
        at = np.array([0] if len(hashes) else [], np.int64)
        return span_hashes(hashes, at, at + len(hashes))
    at = np.arange(len(hashes) - n + 1)
    return span_hashes(hashes, at, at + n)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if flat.dtype == U:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
