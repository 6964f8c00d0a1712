"""Sorts, top-k, ranks along windows, caps per group and running budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import natural_key


def range_keys(df: DataFrame, column: str, order: str, ascending: bool = True) -> list[Column]:
    """Sort keys of one column; blanks come last in both directions, non-finite numbers after finite ones."""
    c, kind = F.col(column), df.schema[column].dataType.typeName()
    keys = [natural_key(c)] if kind == "string" else [c]
    if kind in ("float", "double"):
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        keys = [odd.cast("int"), F.when(~odd, c)]
    return [c.isNull(), *((k.asc_nulls_last() if ascending else k.desc_nulls_last()) for k in keys), F.col(order)]


def sort_range(df: DataFrame, column: str, order: str, ascending: bool = True) -> DataFrame:
    """Stable sort by one column, see `range_keys`."""
    return df.orderBy(*range_keys(df, column, order, ascending))


def typed_keys(value: str, ascending: bool = True) -> list[Column]:
    """Sort keys of a tagged column struct(t, n, s, b): numbers, then text, then booleans; blanks last either way."""
    v = F.col(value)
    odd = F.isnan(v["n"]) | (F.abs(v["n"]) == float("inf"))
    rank = F.when(v["t"] == "number", 0).when(v["t"] == "text", 1).when(v["t"] == "boolean", 2)
    keys = [rank, odd.cast("int"), F.when(~odd, v["n"]), natural_key(v["s"]), v["b"]]
    return [rank.isNull(), *((k.asc_nulls_last() if ascending else k.desc_nulls_last()) for k in keys)]


def top_scores(df: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    """The k best finite scores, ties to the smaller id; a bounded heap in each task, then a merge."""
    c = F.col(score)
    return df.where(~F.isnan(c) & (F.abs(c) != float("inf"))).orderBy(F.desc(score), id_col).limit(k)


def multi_keys(keys: Sequence[tuple[str, bool]], natural: Sequence[str] = (), order: str | None = None) -> list[Column]:
    """Sort keys from (column, ascending); `natural` columns compare digits as numbers and without case."""
    cols = [(natural_key(F.col(c)) if c in natural else F.col(c)) for c, _ in keys]
    return [*((c.asc_nulls_last() if up else c.desc_nulls_last()) for c, (_, up) in zip(cols, keys, strict=True)), *([F.col(order)] if order else [])]


def multi_sort(df: DataFrame, keys: Sequence[tuple[str, bool]], natural: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Sort by several columns, see `multi_keys`."""
    return df.orderBy(*multi_keys(keys, natural, order))


#: Columns an index page may be sorted by.
INDEX_SORTS: Mapping[str, str] = {"name": "name", "path": "path", "size": "size", "time": "mtime", "type": "type", "status": "status", "chunks": "chunks", "opened": "opened", "id": "id"}


def index_keys(key: str, ascending: bool, columns: Mapping[str, str]) -> list[Column]:
    if key not in INDEX_SORTS:
        raise ValueError(f"no sort key {key!r}")
    c = F.col(columns[key])
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col(columns["id"])]


def index_sort(df: DataFrame, key: str, ascending: bool, columns: Mapping[str, str]) -> DataFrame:
    return df.orderBy(*index_keys(key, ascending, columns))


def queue_rank(opened: Column, fresh: Column, size: Column, failed: Column, small: int, middle: int) -> Column:
    """Order of work: 0 opened, 0.5 fresh, 1 to 3 by size class, 4 failed before."""
    return (F.when(failed, 4.0).when(opened, 0.0).when(fresh, 0.5).when(size <= small, 1.0).when(size <= middle, 2.0).otherwise(3.0))


def best_of(df: DataFrame, rank: str, place: str, value: str, skip: Column | None = None) -> DataFrame:
    """Earliest row of the best rank, in one pass and without a sort."""
    rows = df if skip is None else df.where(~skip)
    return rows.agg(F.min_by(value, F.struct(rank, place)).alias(value), F.min(F.struct(rank, place))[rank].alias(rank))


def cap_per_group(df: DataFrame, group: str, order: Sequence[Column], most: int, limit: int) -> DataFrame:
    """At most `most` rows of a group first, then the others in order until `limit`. Rows past `limit` of a group can't matter,
    so the ranked window keeps no more of a group than that."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    some = df.withColumn("_nth", nth).where(F.col("_nth") <= limit)
    return some.orderBy((F.col("_nth") > most).cast("int"), *order).limit(limit).withColumn("overflow", F.col("_nth") > most).drop("_nth")


def within_budget(df: DataFrame, group: str, order: Sequence[str], size: str, room: int) -> DataFrame:
    """Rows of each group in order while their sizes fit; the first overflow ends the group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= room)


def linear_fit(df: DataFrame, y: str, x: str, group: str | None = None) -> DataFrame:
    """Least squares slope and intercept; a single point has none."""
    return (df.groupBy(group) if group else df.groupBy()).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def growth_fit(df: DataFrame, y: str, x: str, group: str | None = None) -> DataFrame:
    """Exponential fit on logarithms; null where any value isn't positive."""
    ln = F.when(F.col(y) > 0, F.ln(y))
    fine = F.min(y) > 0
    return (df.groupBy(group) if group else df.groupBy()).agg(F.when(fine, F.exp(F.regr_slope(ln, F.col(x)))).alias("factor"), F.when(fine, F.exp(F.regr_intercept(ln, F.col(x)))).alias("start"))


def age_bucket(days: Column) -> Column:
    """fresh up to 30 days, archive past 365, recent between; unknown ages are recent."""
    return F.when(days <= 30, "fresh").when(days > 365, "archive").otherwise("recent")
