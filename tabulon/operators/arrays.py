"""Dynamic arrays of a sheet as table operators: a table in a stated order is the range, and `place` is a row's number in the result.

An order is a list of column names, or of (name, ascending); it should be total, ties fall anywhere. Nulls are blank cells, and
come first (last where descending). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import numbered

Order = Sequence[str | tuple[str, bool]]
#: The widest result that a wrap may have, as in a sheet.
WIDEST = 16_384


def keys(order: Order, backwards: bool = False) -> list[Column]:
    """Sort keys of an order, or of the reversed one."""
    pairs = [(k, True) if isinstance(k, str) else k for k in order]
    return [F.col(name).asc_nulls_first() if up != backwards else F.col(name).desc_nulls_last() for name, up in pairs]


def _columns(df: DataFrame, count: int | None, leave: bool) -> list[str]:
    """The first `count` columns, or the last ones if it's negative; or what they leave."""
    if count is None:
        return df.columns
    n = len(df.columns)
    some = range(min(count, n)) if count >= 0 else range(max(n + count, 0), n)
    return [c for i, c in enumerate(df.columns) if (i in some) != leave]


def take(df: DataFrame, order: Order, rows: int, columns: int | None = None) -> DataFrame:
    """TAKE: the first rows and columns, the last ones for negative numbers. A top-k: nothing else is sorted or shuffled."""
    top = df.orderBy(*keys(order, rows < 0)).limit(abs(rows))
    return numbered(top, keys(order), "place").select("place", *_columns(df, columns, False))


def drop(df: DataFrame, order: Order, rows: int, columns: int | None = None) -> DataFrame:
    """DROP: all but the first rows and columns, or the last ones for negative numbers."""
    kept = _columns(df, columns, True)
    if rows >= 0:
        return numbered(df, keys(order), "place").where(F.col("place") > rows).select((F.col("place") - rows).alias("place"), *kept)
    every = numbered(df, keys(order), "place").crossJoin(df.agg(F.count(F.lit(1)).alias("_n")))
    return every.where(F.col("place") <= F.col("_n") + rows).select("place", *kept)


def to_column(df: DataFrame, order: Order, columns: Sequence[str], by_column: bool = False, ignore_blank: bool = False) -> DataFrame:
    """TOCOL: (place, value) of all cells of `columns`, row by row or column by column, as text; blanks may be left out."""
    cells = F.array(*(F.struct(F.lit(i).alias("j"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    rows = numbered(df, keys(order), "_i").select("_i", F.inline(cells))
    if ignore_blank:
        rows = rows.where("value IS NOT NULL")
        return numbered(rows, ["j", "_i"] if by_column else ["_i", "j"], "place").select("place", "value")
    if not by_column:
        return rows.select(((F.col("_i") - 1) * len(columns) + F.col("j") + 1).cast("long").alias("place"), "value")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return rows.crossJoin(total).select((F.col("j") * F.col("_n") + F.col("_i")).cast("long").alias("place"), "value")


def wrap_rows(df: DataFrame, order: Order, value: str, width: int, pad=None) -> DataFrame:
    """WRAPROWS: (place, c1, c2, ...) with `width` values to a row; cells beyond the last value get `pad`."""
    if not 0 < width <= WIDEST:
        raise ValueError(f"a row has 1 to {WIDEST} cells")
    rows = numbered(df.select(*_named(order), F.col(value).alias("_v")), keys(order), "_p")
    at = F.struct("_v")
    cell = lambda k: F.max(F.when((F.col("_p") - 1) % width == k, at))
    made = rows.groupBy(F.expr(f"(_p - 1) DIV {width} + 1").alias("place")).agg(*(cell(k).alias(f"_c{k}") for k in range(width)))
    # A struct tells a blank value from a cell beyond the end.
    return made.select("place", *(F.when(F.col(f"_c{k}").isNull(), F.lit(pad)).otherwise(F.col(f"_c{k}._v")).alias(f"c{k + 1}") for k in range(width)))


def wrap_columns(df: DataFrame, order: Order, value: str, height: int, pad=None) -> DataFrame:
    """WRAPCOLS: (place, c1, c2, ...) with `height` values to a column. As many columns as the count of rows asks for, at most WIDEST."""
    if height <= 0:
        raise ValueError("a column has at least one cell")
    width = -(-df.count() // height)
    if width > WIDEST:
        raise ValueError(f"over {WIDEST} columns")
    rows = numbered(df.select(*_named(order), F.col(value).alias("_v")), keys(order), "_p")
    at = F.struct("_v")
    cell = lambda k: F.max(F.when(F.expr(f"(_p - 1) DIV {height}") == k, at))
    made = rows.groupBy(((F.col("_p") - 1) % height + 1).alias("place")).agg(*(cell(k).alias(f"_c{k}") for k in range(width)))
    return made.select("place", *(F.when(F.col(f"_c{k}").isNull(), F.lit(pad)).otherwise(F.col(f"_c{k}._v")).alias(f"c{k + 1}") for k in range(width)))


def _named(order: Order) -> list[str]:
    return [k if isinstance(k, str) else k[0] for k in order]


def vstack(*parts: tuple[DataFrame, Order], pad=None) -> DataFrame:
    """VSTACK: (place, c1, c2, ...), the tables one below the other, columns by position; missing ones get `pad`."""
    width = max(len(df.columns) for df, _ in parts)
    out, before = None, None
    for df, order in parts:
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        rows = numbered(df, keys(order), "_p")
        place = F.col("_p")
        if before is not None:
            rows, place = rows.crossJoin(before.withColumnRenamed("_n", "_b")), F.col("_p") + F.col("_b")
        named = [F.col(c).alias(f"c{i + 1}") for i, c in enumerate(df.columns)] + [F.lit(pad).alias(f"c{i + 1}") for i in range(len(df.columns), width)]
        some = rows.select(place.cast("long").alias("place"), *named)
        out = some if out is None else out.unionByName(some)
        before = n if before is None else before.union(n).agg(F.sum("_n").alias("_n"))
    return out


def hstack(*parts: tuple[DataFrame, Order], pad=None) -> DataFrame:
    """HSTACK: (place, c1, c2, ...), the tables side by side, rows by place; rows that a shorter table lacks get `pad`."""
    out, width = None, 0
    for df, order in parts:
        named = [f"c{width + i + 1}" for i in range(len(df.columns))]
        rows = numbered(df, keys(order), "place").select(F.col("place").cast("long").alias("place"), F.struct(*(F.col(c).alias(n) for c, n in zip(df.columns, named))).alias(f"s{width}"))
        out = rows if out is None else out.join(rows, "place", "full")
        width += len(df.columns)
    cells = [F.when(F.col(s).isNull(), F.lit(pad)).otherwise(F.col(f"{s}.{f.name}")).alias(f.name) for s in out.columns[1:] for f in out.schema[s].dataType.fields]
    return out.select("place", *cells)


def unique(df: DataFrame, columns: Sequence[str], order: str, exactly_once: bool = False) -> DataFrame:
    """UNIQUE: distinct rows of `columns` in the order in which they're first seen, or only those that stand once. Nulls are equal."""
    found = df.groupBy(*columns).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    found = found.where("_n = 1") if exactly_once else found
    return numbered(found, ["_first", *columns], "place").select("place", *columns)


def expand(df: DataFrame, order: Order, rows: int, columns: int, pad=None) -> DataFrame:
    """EXPAND: the table with rows and columns of `pad` added up to the sizes; a table that is larger is refused, as a sheet does."""
    if columns < len(df.columns) or len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) > rows:
        raise ValueError("the table is larger than that")
    named = [F.col(c).alias(f"c{i + 1}") for i, c in enumerate(df.columns)] + [F.lit(pad).alias(f"c{i + 1}") for i in range(len(df.columns), columns)]
    held = numbered(df, keys(order), "place").select(F.col("place").cast("long").alias("place"), F.struct(*named).alias("s"))
    every = df.sparkSession.range(1, rows + 1).toDF("place").join(held, "place", "left")
    return every.select("place", *(F.when(F.col("s").isNull(), F.lit(pad)).otherwise(F.col(f"s.c{i + 1}")).alias(f"c{i + 1}") for i in range(columns)))


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """SCAN: the array of what a fold over an array holds after each of its values; null for a null array."""
    kind = F.slice(F.array(start), 1, 0)
    return F.aggregate(values, F.struct(start.alias("a"), kind.alias("out")), lambda acc, x: F.struct(
        step(acc["a"], x).alias("a"), F.concat(acc["out"], F.array(step(acc["a"], x))).alias("out")), lambda acc: acc["out"])


def by_row(df: DataFrame, columns: Sequence[str], name: str, fold: Callable[[Column], Column]) -> DataFrame:
    """BYROW: a column with what `fold` makes of the array of the row's cells."""
    return df.withColumn(name, fold(F.array(*columns)))


def by_column(df: DataFrame, columns: Sequence[str], fold: Callable[[str], Column]) -> DataFrame:
    """BYCOL: (name, value), what an aggregate makes of each column, all in one pass."""
    one = df.agg(*(fold(c).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns))))
