"""Shortest edit scripts between pairs of texts, by lines, words or characters, in space that grows with the texts alone."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("line", "word", "char")


def units(text: str, level: str, case: bool = True, space: bool = True) -> tuple[list[str], list[str]]:
    """(units, keys): what a text is made of, and what is compared. Without `case` letters' case, without `space` the kind and number of blanks don't count.

    Lines are compared without outer blanks and with single inner ones, and empty ones are left out. Words keep the blanks between them as units of their own.
    """
    if level == "line":
        parts = [line for line in (re.sub(r"\s+", " ", x).strip() for x in text.split("\n")) if line]
    elif level == "word":
        parts = re.findall(r"\s+|[^\s]+", text)
    else:
        parts = list(text)
    keys = parts
    if not space and level != "line":
        keys = [" " if k.isspace() else k for k in keys]
        if level == "char" and keys:  # a run of blanks is one unit
            fresh = [i for i, k in enumerate(keys) if k != " " or i == 0 or keys[i - 1] != " "]
            parts, keys = ["".join(parts[i:j]) for i, j in zip(fresh, [*fresh[1:], len(parts)], strict=True)], [keys[i] for i in fresh]
        while keys and keys[-1] == " ":
            keys, parts = keys[:-1], parts[:-1]
        if keys and keys[0] == " ":
            keys, parts = keys[1:], parts[1:]
    return parts, keys if case else [k.casefold() for k in keys]


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """A point of a shortest edit path that halves its edits, and their number: furthest points of all diagonals from both ends, one number of edits at a time."""
    n, m = len(a), len(b)
    delta, size = n - m, n + m + 3
    ahead, back = np.full(size, -1, np.int64), np.full(size, -1, np.int64)  # by diagonal, shifted by m + 1
    shift = rear_shift = m + 1
    ahead[shift + 1] = back[rear_shift + 1] = 0

    def slide(furthest: np.ndarray, off: int, x: np.ndarray, y: np.ndarray, d: int, wide: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        low, top = -min(d, high), min(d, wide)
        low, top = low + ((low + d) & 1), top - ((top + d) & 1)
        k = np.arange(low, top + 1, 2)
        down, right = furthest[off + k + 1], furthest[off + k - 1] + 1
        at = np.where((k == -d) | ((k != d) & (down >= right)), down, right)
        live = np.arange(len(k))
        while len(live):  # all diagonals step along equal units together
            i, j = at[live], at[live] - k[live]
            go = (i < wide) & (j < high) & (i >= 0) & (j >= 0)
            go[go] = x[i[go]] == y[j[go]]
            live = live[go]
            at[live] += 1
        furthest[off + k] = at
        return k, at

    ra, rb = a[::-1], b[::-1]
    for d in range((n + m + 1) // 2 + 1):
        k, at = slide(ahead, shift, a, b, d, n, m)
        if delta & 1:
            kr = delta - k
            near = (np.abs(kr) <= d - 1) & (kr + rear_shift >= 0) & (kr + rear_shift < size)
            met = np.zeros(len(k), bool)
            met[near] = (back[rear_shift + kr[near]] >= 0) & (at[near] + back[rear_shift + kr[near]] >= n)
            if met.any():
                i = int(np.argmax(met))
                return int(at[i]), int(at[i] - k[i]), 2 * d - 1
        k, at = slide(back, rear_shift, ra, rb, d, n, m)
        if not delta & 1:
            kf = delta - k
            near = (np.abs(kf) <= d) & (kf + shift >= 0) & (kf + shift < size)
            met = np.zeros(len(k), bool)
            met[near] = (ahead[shift + kf[near]] >= 0) & (at[near] + ahead[shift + kf[near]] >= n)
            if met.any():
                i = int(np.argmax(met))
                return n - int(at[i]), m - int(at[i] - k[i]), 2 * d
    raise AssertionError("two paths always meet")


def edits(a: Sequence[str], b: Sequence[str]) -> tuple[list[int], list[int]]:
    """Places removed from a and added in b by a shortest edit script (Myers' divide and conquer). Common ends are cut off first; a stack stands for recursion."""
    number: dict[str, int] = {}
    x, y = (np.fromiter((number.setdefault(u, len(number)) for u in s), np.int64, len(s)) for s in (a, b))
    removed, added, todo = [], [], [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        same = x[a0:a1][: b1 - b0] == y[b0:b1][: a1 - a0]
        head = int(np.argmin(same)) if len(same) and not same.all() else len(same)
        a0, b0 = a0 + head, b0 + head
        n = min(a1 - a0, b1 - b0)
        same = (x[a1 - n:a1] == y[b1 - n:b1])[::-1]
        tail = int(np.argmin(same)) if len(same) and not same.all() else len(same)
        a1, b1 = a1 - tail, b1 - tail
        if a0 == a1 or b0 == b1:
            removed += range(a0, a1)
            added += range(b0, b1)
            continue
        i, j, _ = _middle(x[a0:a1], y[b0:b1])
        if (i, j) in ((0, 0), (a1 - a0, b1 - b0)):  # nothing in common
            removed += range(a0, a1)
            added += range(b0, b1)
            continue
        todo += [(a0, a0 + i, b0, b0 + j), (a0 + i, a1, b0 + j, b1)]
    return sorted(removed), sorted(added)


def compare(left: DataFrame, right: DataFrame, key: str, text: str, level: str = "line", case: bool = True, space: bool = True) -> DataFrame:
    """(key, removed, added, removed_units, added_units) of every key of two tables: places from 0 and the units there.

    Texts of one key are compared by a shortest edit script at the level of lines, words or characters, whatever their length; a key on one side only is wholly added
    or removed. Null texts are empty. Keys are joined by a shuffle and null keys don't meet; of a key that repeats, each row meets each of the other side. A pair is
    worked on by itself, in time that grows with its length times its differences and space that grows with its length.
    """
    if level not in LEVELS:
        raise ValueError(f"level is one of {LEVELS}")
    a, b = (d.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias(n)) for d, n in ((left, "a"), (right, "b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = [[], [], [], []]
                part = batch.slice(k, 64)
                for s, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    (u, x), (v, y) = (units(z or "", level, case, space) for z in (s, t))
                    gone, new = ([], []) if x == y else edits(x, y)
                    for column, value in zip(rows, (gone, new, [u[i] for i in gone], [v[i] for i in new]), strict=True):
                        column.append(value)
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.list_(t)) for c, t in zip(rows, kinds, strict=True))], ["key", "removed", "added", "removed_units", "added_units"])

    return a.join(b, "key", "full_outer").mapInArrow(run, "key long, removed array<int>, added array<int>, removed_units array<string>, added_units array<string>")
