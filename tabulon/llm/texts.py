"""Texts of Arrow batches as byte arrays, cut into short strings whose distinct values are worked on once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a bound of memory that changes no result. A longer text is a slice by itself.
SLICE, _LISTS = 8 << 20, 1 << 17
#: One class of letters that are lower-cased one by one, are composed already and belong to one match of the usual patterns.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: ASCII signs without the apostrophe, which starts contractions, and the less-than sign, which starts special tokens.
SIGNS = r"!-&(-/:;=-@\[-`{-~"


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 0) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with at most `most` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (most or SLICE), "right")))
        yield batch.slice(a, b - a)
        a = b


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and the place where each text starts (and the end); null as empty."""
    column = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Consecutive stretches of bytes as an Arrow array, without a copy."""
    kind = kind or pa.large_string()
    width = np.int64 if kind in (pa.large_string(), pa.large_binary()) else np.int32
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, width)), pa.py_buffer(np.ascontiguousarray(data))])


def cut(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts cut at the places `at`: all pieces, dictionary-encoded, and the number of the first piece of each text (and the end)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[at] = True
    edges = np.flatnonzero(edge)
    # empty texts have no piece of their own
    return strings(data, edges).dictionary_encode(), np.searchsorted(edges[:-1], starts)


def gather(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `which` of a list column (values, ends) one after another, and their ends. Places are worked out block by block."""
    starts = np.concatenate([[0], ends])[which]
    done = np.cumsum(ends[which] - starts)
    out = np.empty(done[-1] if len(done) else 0, values.dtype)
    for k in range(0, len(which), _LISTS):
        first, to = done[k - 1] if k else 0, done[k:k + _LISTS]
        sizes = np.diff(to, prepend=first)
        out[first:to[-1]] = values[np.repeat(starts[k:k + _LISTS] - to + sizes, sizes) + np.arange(first, to[-1])]
    return out, done


class RowTable:
    """An open-addressing table from distinct 64-bit keys to their rows, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(max(1, len(keys)) * 3).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.rows[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            placed = np.zeros(len(left), bool)
            placed[first] = free[first]
            self.keys[at[placed]], self.rows[at[placed]] = keys[left[placed]], left[placed]
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 without one."""
        at = self._home(keys)
        out = self.rows[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.rows[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out
