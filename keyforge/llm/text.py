"""Vectorised text primitives over Arrow string columns.

A batch of documents is treated as one byte array: words, word hashes and
n-gram hashes are found by numpy operations over the whole batch, so that the
cost per document is not a Python loop. Every function works on whole texts.

Words are maximal runs of ASCII letters, digits and non-ASCII characters in
the lower-cased text. In RE2 and Java syntax: ``([a-z0-9]|[^\\x00-\\x7F])+``.
A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD = np.zeros(256, bool)
_WORD[[*range(97, 123), *range(48, 58), *range(128, 256)]] = True
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n mod 2**64."""
    got = _tables.get(base)
    if got is None or len(got) <= n:
        got = np.full(1 << (n + 1).bit_length(), base, _U)
        got[0] = 1
        _tables[base] = got = np.multiply.accumulate(got)
    return got[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each span, from prefix sums of a polynomial."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(base, len(values))[:-1], out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), len(values))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; nulls are empty."""
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about CHUNK_BYTES of text each, at least one row."""
    if batch.num_rows == 0:
        return
    limit = limit or CHUNK_BYTES
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, np.cumsum(size)
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a string column.

    ``hash`` has a 64-bit hash of each word, ``start``/``end`` its bytes in
    ``raw`` (the lower-cased texts), and words ``first[i]:first[i + 1]`` are
    those of row i.
    """

    def __init__(self, arr: pa.Array):
        self.raw, self.offs = buffers(pc.utf8_lower(pc.fill_null(arr, "")))
        n = len(self.raw)
        word = np.zeros(n + 1, bool)
        word[:n] = _WORD[self.raw]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[self.offs] = True
        before = np.zeros(n + 1, bool)
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge))
        self.end = np.flatnonzero(before & (~word | edge))
        self.hash = _spans_hash(_BYTE[self.raw], self.start, self.end, _P)
        self.first = np.searchsorted(self.start, self.offs)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of exactly n words, and offsets by row."""
        each = np.maximum(self.count - n + 1, 0)
        offs = np.concatenate([[0], np.cumsum(each)])
        starts = np.arange(offs[-1]) + np.repeat(self.first[:-1] - offs[:-1], each)
        return _spans_hash(self.hash, starts, starts + n, _Q), offs

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n-gram, and offsets by row.

        A text of 1 to n - 1 words has one n-gram, of all its words; one
        without words has none.
        """
        count = self.count
        each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        offs = np.concatenate([[0], np.cumsum(each)])
        starts = np.arange(offs[-1]) + np.repeat(self.first[:-1] - offs[:-1], each)
        ends = np.minimum(starts + n, np.repeat(self.first[1:], each))
        return _spans_hash(self.hash, starts, ends, _Q), offs


def unique_by_row(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their offsets."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(offs)))


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, offs: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduce of values by row; rows without values get `empty`."""
    out = np.full(len(offs) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(offs) > 0)
    if len(some):
        out[some] = ufunc.reduceat(values, offs[some])
    return out


def lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A list column."""
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables with whole groups of equal keys, from batches sorted by key.

    Memory holds a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if cut:
            held.append(batch.slice(0, cut))
        elif held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
