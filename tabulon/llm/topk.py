"""Exact top-k inner products by MaxScore, over shards of vectors that are merged in the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block: they bound the memory of a task, whatever the input.
SHARD_ROWS, QUERY_ROWS, BLOCK = 4096, 4096, 512
_SCHEMA = "query_id long, vec_id long, score long, beyond string"
_MOST = 2**63 - 1


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor holds null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of floor(1024 * x), short vectors filled up with zeros; whole numbers of any size where doubles aren't exact."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    raw, lens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(lists.value_lengths())
    if np.abs(raw).max(initial=0) < 2.0**42:
        flat = np.floor(1024.0 * raw)
    else:  # from 2 ** 52 on a double is whole
        flat = np.array([int(x) * 1024 if abs(x) >= 2.0**52 else int(np.floor(1024.0 * x)) for x in raw.tolist()], object)
    out = np.zeros((len(lens), dims), flat.dtype)
    if len(flat):
        starts = np.cumsum(lens) - lens
        out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(starts, lens)] = flat
    return out


def maxscore(query: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one query among the blocks of a shard; exact, ties to the smaller id.

    A term is a dimension the query has a weight in; `postings` is [dimension, row], and high/low bound its values in
    each block of rows. A term's bound is the most it can add. Terms in order of their bounds: as many of the smallest
    as together can't lift a row to the threshold (the k-th best score so far) are non-essential. Essential
    postings are traversed for the whole block; the others are probed, largest bound first, for the rows that can still compete.
    """
    terms = np.flatnonzero(query)
    best_id, best = np.empty(0, np.int64), np.empty(0)
    for b in range(high.shape[1]):
        span = slice(b * BLOCK, min((b + 1) * BLOCK, postings.shape[1]))
        weight = query[terms]
        bound = np.maximum(weight * high[terms, b], weight * low[terms, b])
        order = np.argsort(-bound, kind="stable")
        after = np.concatenate([np.cumsum(bound[order][::-1])[::-1], np.zeros(1, bound.dtype)])  # most that the terms from here on can add
        full = len(best) == k
        floor = best[-1] if full else -np.inf
        if after[0] < floor:
            continue
        # the first place from which on every rest of terms stays below the threshold
        over = np.flatnonzero(after >= floor)
        essential = int(over[-1]) + 1 if len(over) and full else len(order)
        essential = max(1, min(essential, len(order)))
        lead = terms[order[:essential]]
        part = query[lead] @ postings[lead, span]
        rows = np.arange(span.start, span.stop)
        alive = part + after[essential] >= floor
        rows, part = rows[alive], part[alive]
        for j in range(essential, len(order)):
            if not len(rows):
                break
            t = terms[order[j]]
            part = part + query[t] * postings[t, rows]
            alive = part + after[j + 1] >= floor
            rows, part = rows[alive], part[alive]
        keep = ids[rows] != own
        got, score = np.concatenate([best_id, ids[rows][keep]]), np.concatenate([best, part[keep]])
        top = np.lexsort((got, -score))[:k] if score.dtype != object else sorted(range(len(got)), key=lambda i: (-score[i], got[i]))[:k]
        best_id, best = got[top], score[top]
    return best_id, best


def _search(k: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _rows([])
        dims = max(int(np.max(np.asarray(t["v"].combine_chunks().value_lengths()), initial=1)) for t in (left, right))
        q, d = _matrix(left["v"], dims), _matrix(right["v"], dims)
        q_ids, ids = left["id"].to_numpy(), right["id"].to_numpy()
        if int(np.abs(q).max(initial=0)) * int(np.abs(d).max(initial=0)) * dims >= 2**53:  # beyond exact doubles
            q, d = (np.frompyfunc(int, 1, 1)(m) for m in (q, d))
        postings = np.ascontiguousarray(d.T)
        starts = np.arange(0, len(ids), BLOCK)
        high, low = np.maximum.reduceat(postings, starts, axis=1), np.minimum.reduceat(postings, starts, axis=1)
        found: list[tuple] = []
        for i in range(len(q_ids)):
            v, s = maxscore(q[i], q_ids[i], ids, postings, high, low, k) if q[i].any() else _zero(q_ids[i], ids, k)
            found += [(int(q_ids[i]), x, y) for x, y in zip(v.tolist(), s.tolist(), strict=True)]
        return _rows(found)

    return cell


def _rows(found: list[tuple]) -> pa.Table:
    """Scores as longs; of those that reach the bounds of 64 bits `beyond` has the whole number, as text that sorts like it."""
    whole = [int(s) for _, _, s in found]
    return pa.table({
        "query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()),
        "score": pa.array([max(-_MOST, min(_MOST, s)) for s in whole], pa.int64()),
        "beyond": pa.array([None if abs(s) < _MOST else _sortable(s) for s in whole], pa.string()),
    })


def _sortable(n: int) -> str:
    digits = str(abs(n))
    text = f"{len(digits):04d}{digits}"
    return "1" + text if n >= 0 else "0" + "".join(str(9 - int(c)) for c in text) + "~"


def _zero(own: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A query without terms scores 0 everywhere: the smallest ids."""
    v = np.sort(ids[ids != own])[:k]
    return v, np.zeros(len(v))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of the highest inner product of floor(1024 * x).

    Candidates are dealt into shards and queries into blocks by hash, both of bounded size, and each (shard, block)
    cell is one group: a candidate goes to every query block, a query to every shard, as row blocks and not as
    pairs of rows. Each cell gives k rows a query at most, and a ranked window merges them.

    Rows with a null id, a null vector, or null, NaN or infinite components take no part. Vectors of different lengths
    are filled up with zeros. Repeated query rows count once; each repeated candidate row counts. A query's own id is never
    among its results. Sums are whole numbers of any size, by the same method, and ranks follow them; a score that leaves 64 bits is
    given as the largest or smallest one (plus or minus 2 ** 63 - 1). No usable rows: no result.
    """
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")]
    docs = usable(candidates.select(*pick), "v").where("id IS NOT NULL")
    asks = usable(queries.select(*pick), "v").where("id IS NOT NULL").dropDuplicates()
    n, m = docs.count(), asks.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    place = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count))
    left = asks.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), place(blocks).cast("int").alias("block"))
    right = docs.select("id", "v", place(shards).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), _SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
