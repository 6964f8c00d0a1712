"""Vector codes by part: codebooks fitted over all rows, nearest entries found by vector-approximation filtering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .topk import usable

#: Parts of a vector, entries of a part's codebook, rounds, the factor of components, bits of a cell number.
PARTS, ENTRIES, ROUNDS, SCALE, BITS = 8, 16, 6, 4096, 3
#: Parts compared at once (a bound of memory), and distinct labels up to which their sums are broadcast; neither changes a result.
CHUNK, FEW_LABELS = 4096, 1 << 16
#: Sums travel as digits of this base, so that they are exact whatever the values.
_LIMB = 62
_MOST = 2**63 - 1


class VaFile:
    """Nearest entries by squared Euclidean distance over whole numbers; exact, ties to the lower index.

    Each coordinate of an entry is kept as a cell number of `bits` bits. A query's look-up tables hold, for each dimension and
    cell, the least and the greatest squared difference to any value of the cell; their sums over dimensions bound an
    entry's distance. Only entries whose lower bound doesn't exceed the least upper bound are compared by their coordinates.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, cells = entries, 1 << bits
        low, high = entries.min(0), entries.max(0) + 1
        marks = low[:, None] + (high - low)[:, None] * np.arange(cells + 1) // cells
        self.low, self.high = marks[:, :-1], np.maximum(marks[:, :-1], marks[:, 1:] - 1)
        self.cell = (entries[:, :, None] >= marks[None, :, 1:-1]).sum(2)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below, above = self.low - queries[:, :, None], queries[:, :, None] - self.high
        least, most = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
        dims = np.arange(self.entries.shape[1])
        return tuple((table * table)[:, dims, self.cell].sum(2) for table in (least, most))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query: index of the entry, squared distance, number of entries compared by coordinates."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        gap = queries[row] - self.entries[entry]
        distance = (gap * gap).sum(1)
        count = np.bincount(row, minlength=len(queries))
        starts = np.cumsum(count) - count
        least = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.unique(row[hit], return_index=True)[1]]], least, count


def _whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros to `dims`; Python's whole numbers where 64 bits could be left."""
    raw, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.value_lengths(), np.int64)
    most = np.abs(raw).max(initial=0)
    if most * scale < 2.0**26 and dims <= 1 << 8:
        whole = np.floor(raw * scale).astype(np.int64)
    else:
        whole = np.array([int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in raw.tolist()], object)
    out = np.zeros((len(sizes), dims), whole.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def assigned(values: np.ndarray, books: list[VaFile]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of every part, error and number of compared entries of every row."""
    n, width = len(values), values.shape[1] // len(books)
    code, error, compared = np.zeros((n, len(books)), np.int64), np.zeros(n, values.dtype), np.zeros(n, np.int64)
    for k in range(0, n, CHUNK):
        for p, book in enumerate(books):
            code[k:k + CHUNK, p], distance, count = book.nearest(values[k:k + CHUNK, p * width:(p + 1) * width])
            error[k:k + CHUNK] = error[k:k + CHUNK] + distance
            compared[k:k + CHUNK] += count
    return code, error, compared


def _books(entries: np.ndarray, values: np.ndarray, bits: int) -> list[VaFile]:
    """VA-files of one kind of numbers with the values: 64 bits if they are enough for both."""
    small = values.dtype != object and np.abs(entries).max() < 2**26
    return [VaFile(e, bits) for e in entries.astype(np.int64 if small else object)]


def _sums(shared, dims: int, parts: int, scale: int, bits: int):
    """One task's sums of parts and their numbers by (part, entry): one row for each position, the number at the last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        total = np.zeros((parts, entries.shape[1], dims // parts + 1), object)
        for batch in batches:
            values = _whole(batch.column(0), dims, scale)
            code, _, _ = assigned(values, _books(entries, values, bits))
            ones = np.ones((len(values), 1), values.dtype)
            for p, part in enumerate(np.split(values, parts, axis=1)):
                one = np.zeros(total.shape[1:], values.dtype)
                np.add.at(one, code[:, p], np.hstack([part, ones]))
                total[p] += one.astype(object)
        rows = [(*place, k, digit) for place, n in np.ndenumerate(total) for k, digit in enumerate(_limbs(int(n)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["part", "entry", "pos", "limb", "digit"])

    return run


def _limbs(n: int) -> list[int]:
    """Digits of a whole number, lowest first, all with its sign."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n:
        out.append(sign * (n & ((1 << _LIMB) - 1)))
        n >>= _LIMB
    return out


def fit(vectors: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS) -> np.ndarray | None:
    """Codebooks as [part, entry, position] over all rows of (id, v); None without rows.

    They start as the parts of the vectors of the smallest ids (null ids last, then by the vectors). Each round is one pass
    over all rows: a task sums the parts of each entry, Spark adds the tasks' sums up, and the driver, which holds nothing
    but codebooks, divides. Entries that no part is nearest to stay as they are.
    """
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    if not first:
        return None
    start = _whole(pa.array([r.v for r in first], pa.list_(pa.float64())), dims, scale).astype(object)
    books = np.stack(np.split(start, parts, axis=1))
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        sums = vectors.select("v").mapInArrow(_sums(shared, dims, parts, scale, bits), "part long, entry long, pos long, limb long, digit long")
        total = np.zeros((parts, len(first), dims // parts + 1), object)
        for r in sums.groupBy("part", "entry", "pos", "limb").agg(F.sum(F.col("digit").cast("decimal(19,0)")).alias("digit")).collect():
            total[r.part, r.entry, r.pos] += int(r.digit) << (_LIMB * r.limb)
        count = total[:, :, -1:]
        books = np.where(count > 0, total[:, :, :-1] // np.where(count > 0, count, 1), books)
        shared.unpersist()
    return books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components as decimal numbers, joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, compared of every usable row.

    Codes have two hexadecimal digits for each part. `compared` counts the entries that were left to compare by
    coordinates after the filter, of parts * entries. Sums by label are made before anything is joined: few labels are
    broadcast, by their counted number; more are joined with rows dealt over salts, so that a frequent label is no single task.

    Rows whose vector is null or holds null or non-finite components take no part. Vectors are filled up with zeros to the
    longest one's length and that to a multiple of `parts`. Null ids and repeated rows are coded like others; null labels
    are one label. With fewer rows than `entries` codebooks are smaller; no rows give no rows. Numbers are exact; an error that
    leaves 64 bits is given as 2 ** 63 - 1. A lost executor costs a pass over its rows again.
    """
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")), "v")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dims = max(1, -(-longest // parts)) * parts
    books = fit(rows.select("id", "v"), dims, parts, entries, rounds, scale, bits)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _whole(batch.column(1), dims, scale)
            code, error, compared = assigned(values, _books(shared.value, values, bits))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([bytes(c).hex() for c in code.astype(np.uint8)], pa.string()),
                pa.array([min(int(e), _MOST) for e in error.tolist()], pa.int64()), pa.array(compared),
            ], ["vec_id", "label", "code", "error", "compared"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long, compared long")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = written(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= FEW_LABELS:
        joined = coded.join(F.broadcast(sums), same)
    else:
        salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(32)))
        joined = salted.join(sums.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(31)))), same & (F.col("_salt") == F.col("_of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "compared")
