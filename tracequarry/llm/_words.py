"""Vectorised splitting and hashing of the words of many texts at once, on the bytes of Arrow columns.

A word is a run of bytes other than space and 0x09-0x0D, which in UTF-8 is the pattern [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240611)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Texts are worked on in slices of about this many bytes.
SLICE = 1 << 21


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    """base to the powers 0 to n-1, modulo 2^64."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * SLICE:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end], from one running sum over all."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(_ODD, n, "up"), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, n + 1, "down")[starts] + (ends - starts).astype(np.uint64))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `most` bytes of text."""
    if not batch.num_rows:
        return
    _, offsets = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a column of texts: byte starts and ends, 64-bit hashes, and the range of words of each row."""

    def __init__(self, column: pa.Array, lower: bool) -> None:
        data, offsets = texts(column)
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self.hashes = polynomial((_CODE_LOWER if lower else _CODE)[data], self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())

    def grams(self, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words of a row, and the range of each row; whole: a row of 1 to k-1 words has all of them as one."""
        n = self.counts()
        many = np.maximum(n - k + 1, np.where(whole & (n > 0), 1, 0))
        rows = np.concatenate(([0], np.cumsum(many)))
        starts = np.arange(rows[-1]) - np.repeat(rows[:-1] - self.rows[:-1], many)
        ends = np.minimum(starts + k, np.repeat(self.rows[1:], many))
        return polynomial(self.hashes, starts, ends), rows


def unique_in_rows(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the range of each row."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(rows) - 1)))).astype(np.int64)
