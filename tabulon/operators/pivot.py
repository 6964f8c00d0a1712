"""Pivots as tidy aggregates: hierarchies with subtotals, cross-tabs, value filters, calculated fields, show-values-as."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def hierarchy(df: DataFrame, rows: Sequence[str], values: Mapping[str, Column], order: str | None = None) -> DataFrame:
    """Row levels with a subtotal after each group and a grand total: the prefixes of `rows` as grouping sets.

    `depth` is the number of levels that a row has (0: grand total). With `order`, `first_seen` keeps the members'
    order of appearance. Grouping is on columns, so ("ab", "c") and ("a", "bc") stay apart.
    """
    if not 1 <= len(rows) <= 8:
        raise ValueError("from 1 to 8 row levels")
    aggs = [c.alias(n) for n, c in values.items()] + ([F.min(order).alias("first_seen")] if order else [])
    depth = sum((1 - F.grouping(r) for r in rows), F.lit(0)).cast("int").alias("depth")
    return df.rollup(*rows).agg(*aggs, depth)


def cross_tab(df: DataFrame, row: str, column: str, value: Column, name: str = "value") -> DataFrame:
    """Tidy cross-tab: cells, row totals (column null), column totals (row null) and the grand total; absent cells have no row."""
    return df.cube(row, column).agg(value.alias(name), F.grouping(row).cast("int").alias("row_total"), F.grouping(column).cast("int").alias("column_total"))


def spread(df: DataFrame, row: str, column: str, members: Sequence[object], value: Column) -> DataFrame:
    """The cross-tab as a matrix, a column for each given member; naming members spares a pass over the data."""
    return df.groupBy(row).pivot(column, list(members)).agg(value)


def keep_members(df: DataFrame, member: str, total: Column, op: str, order: str | None = None, count: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """Source rows of the members that a value filter keeps, so that excluded ones leave all totals.

    top: the `count` largest, ties in order of appearance; greaterThan: above `low` (0); between: from low to high, both open if null.
    Members without a total are never kept.
    """
    totals = df.groupBy(member).agg(total.alias("_total"), *([F.min(order).alias("_first")] if order else [])).where("_total IS NOT NULL")
    if op == "top":
        kept = totals.orderBy(F.desc("_total"), *(["_first"] if order else [member])).limit(max(1, count))
    elif op == "greaterThan":
        kept = totals.where(F.col("_total") > (0 if low is None else low))
    else:
        kept = totals.where(F.col("_total").between(-float("inf") if low is None else low, float("inf") if high is None else high))
    return df.join(kept.select(member), member, "left_semi")


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|'((?:[^']|'')*)'|([A-Za-z_][\w .]*?)(?=\s*(?:[-+*/()^,]|$))|([-+*/()^]))")


def calculated(formula: str, fields: Mapping[str, Column]) -> Column:
    """Arithmetic over group aggregates as a Column: + - * / ^, unary minus, parentheses, quoted or bare field names.

    Names match without case; an unknown one is an error. An empty group counts as 0, and a division by zero is null.
    """
    known = {k.lower(): v for k, v in fields.items()}
    tokens, at = [], 0
    text = formula.strip().removeprefix("=")
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        number, quoted, bare, sign = m.groups()
        tokens.append(("n", float(number)) if number else ("f", (quoted.replace("''", "'") if quoted is not None else bare).strip().lower()) if sign is None else ("s", sign))
        at = m.end()
    tokens.append(("s", ""))
    place = 0

    def peek() -> object:
        return tokens[place][1] if tokens[place][0] == "s" else None

    def take() -> tuple[str, object]:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def chain(lower: Callable[[], Column], signs: str) -> Column:
        left = lower()
        while peek() and str(peek()) in signs:
            op, right = take()[1], lower()
            left = left + right if op == "+" else left - right if op == "-" else left * right if op == "*" else F.try_divide(left, right)
        return left

    def unary() -> Column:
        if peek() in ("-", "+"):
            return -unary() if take()[1] == "-" else unary()
        base = atom()
        if peek() == "^":
            take()
            return F.pow(base, unary())
        return base

    def atom() -> Column:
        kind, value = take()
        if kind == "n":
            return F.lit(value)
        if kind == "f":
            if value not in known:
                raise ValueError(f"unknown field {value!r}")
            return F.coalesce(known[value].cast("double"), F.lit(0.0))
        if value == "(":
            inner = chain(lambda: chain(unary, "*/"), "+-")
            if take() != ("s", ")"):
                raise ValueError("a parenthesis is open")
            return inner
        raise ValueError(f"unexpected {value or 'end'!r}")

    out = chain(lambda: chain(unary, "*/"), "+-")
    if tokens[place] != ("s", ""):
        raise ValueError(f"unexpected {tokens[place][1]!r}")
    return out


#: Modes that need a base field, and those that need a base item too.
NEEDS_FIELD = ("percentOfParent", "difference", "percentDiff", "percentOf", "runTotal", "percentOfRunningTotal", "rankAscending", "rankDescending")
NEEDS_ITEM = ("difference", "percentDiff", "percentOf")
#: Base items that are relative to each row.
PREVIOUS, NEXT = "(previous)", "(next)"


def show_as(df: DataFrame, mode: str, value: str, row: str | None, column: str | None = None, base_item: object = None, order: str | None = None,
            row_parents: Sequence[str] = (), column_parents: Sequence[str] = (), base_field: str | None = None) -> Column:
    """A show-values-as mode over a table with one row for each (row, column) member pair, as a Column.

    The base field is `row`; modes restart for each member of `column`. Differences are null on the base item. If rows or
    columns are nested, the parents name the levels above, outermost first: the base field's modes restart in each parent, and
    percentOfParentRow and percentOfParentCol divide by the next level up (without parents, by the whole axis). percentOfParent divides by the
    member of `base_field`, a level of either axis, that holds the value; without parents it may be left out. The base item may be PREVIOUS or NEXT:
    the neighbouring row in `order` (the row's own order by default), null beyond the ends. Totals of the whole table are a scalar subquery, so they need no window over all rows.
    """
    if mode in NEEDS_FIELD and row is None:
        raise ValueError(f"{mode} needs a base field")
    if mode in NEEDS_ITEM and base_item is None:
        raise ValueError(f"{mode} needs a base item")
    rows, columns = [*row_parents, *([row] if row else [])], [*column_parents, *([column] if column else [])]
    if mode == "percentOfParent" and base_field is None and (row_parents or column_parents):
        raise ValueError("percentOfParent needs a base field among the levels")
    if base_field is not None and base_field not in rows + columns:
        raise ValueError(f"{base_field!r} is no level of the table")

    def within(*fields: str) -> WindowSpec:
        return Window.partitionBy(*fields) if fields else Window.partitionBy(F.lit(1))

    v, by_others = F.col(value), within(*row_parents, *columns)
    others = (*row_parents, *columns)
    walk = by_others.orderBy(order or row).rowsBetween(Window.unboundedPreceding, 0) if row else None
    if base_item in (PREVIOUS, NEXT):
        base, is_base = (F.lag if base_item == PREVIOUS else F.lead)(v).over(by_others.orderBy(order or row)), F.lit(False)
    else:
        base, is_base = F.max(F.when(F.col(row) == F.lit(base_item), v)).over(by_others) if base_item is not None else None, F.col(row) == F.lit(base_item) if row else None
    total = lambda *fields: F.sum(v).over(within(*fields)) if fields else df.agg(F.sum(v)).scalar()
    match mode:
        case "percentOfTotal":
            return F.try_divide(v, total())
        case "percentOfRow":
            return F.try_divide(v, total(*rows))
        case "percentOfCol":
            return F.try_divide(v, total(*columns))
        case "percentOfParentRow":
            return F.try_divide(v, total(*others))
        case "percentOfParentCol":
            return F.try_divide(v, total(*rows, *column_parents))
        case "percentOfParent" if base_field in columns:
            return F.try_divide(v, total(*rows, *columns[:columns.index(base_field) + 1]))
        case "percentOfParent":
            held = rows[:rows.index(base_field) + 1] if base_field else []
            return F.try_divide(v, total(*held, *columns))
        case "difference":
            return F.when(~is_base, v - base)
        case "percentDiff":
            return F.when(~is_base, F.try_divide(v - base, base))
        case "percentOf":
            return F.try_divide(v, base)
        case "runTotal":
            return F.sum(v).over(walk)
        case "percentOfRunningTotal":
            return F.try_divide(F.sum(v).over(walk), total(*others))
        case "rankAscending":
            return F.rank().over(by_others.orderBy(v))
        case "rankDescending":
            return F.rank().over(by_others.orderBy(v.desc()))
        case "index":
            return F.try_divide(v * total(), total(*rows) * total(*columns))
    raise ValueError(f"no mode {mode!r}")
