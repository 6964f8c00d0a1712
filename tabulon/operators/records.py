"""Record lists: conditions, ranges, templates, numbering; text comparison; formula references."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import natural_key
from ..lineage import settle
from .diff import edits


def named_fields(df: DataFrame) -> DataFrame:
    """Blank headers become ColumnN, repeated ones get a number: Name, Name2."""
    seen: dict[str, int] = {}
    names = []
    for i, c in enumerate(df.columns, 1):
        name = c.strip() or f"Column{i}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}{seen[name]}")
    return df.toDF(*names)


def test(field: str | None, op: str, value: str = "") -> Column:
    """One condition on trimmed, lower-cased text; a missing field is empty."""
    c = F.lower(F.trim(F.coalesce(F.col(field).cast("string"), F.lit("")))) if field else F.lit("")
    v = value.strip().lower()
    return {"equals": c == v, "notEquals": c != v, "contains": F.contains(c, F.lit(v)), "notContains": ~F.contains(c, F.lit(v)), "blank": c == "", "notBlank": c != ""}[op]


def chain(conditions: Sequence[tuple[str, str, str, str]]) -> Column:
    """(join, field, op, value) conditions: AND binds before OR; none at all keeps everything."""
    groups: list[Column] = []
    for i, (join, field, op, value) in enumerate(conditions):
        c = test(field, op, value)
        if i == 0 or join == "or":
            groups.append(c)
        else:
            groups[-1] = groups[-1] & c
    out = groups[0] if groups else F.lit(True)
    for g in groups[1:]:
        out = out | g
    return out


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 1) -> DataFrame:
    """Row numbers over a whole table: one range shuffle, a sort inside each part, and offsets from the parts' sizes.

    One window over everything would put the table into one task. As many parts as the session shuffles into: a row's id after
    the sort holds its part and its place there. The parts are written once, as sampling could cut the ranges elsewhere the
    second time. There is one offset a part, so these are broadcast.
    """
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row_id", F.monotonically_increasing_id())
    local = settle(ids.withColumns({"_part": F.shiftright("_row_id", 33), "_at": F.col("_row_id").bitwiseAND((1 << 33) - 1)}).drop("_row_id"))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") + first).cast("long")).drop("_part", "_at", "_before")


def in_range(place: str, kind: str = "all", low: int | None = None, high: int | None = None, current: int | None = None) -> Column:
    """all, current, or from..to: 1-based, inclusive, ends in either order."""
    if kind == "all":
        return F.lit(True)
    if kind == "current":
        return F.col(place) == current
    a, b = low or 1, high if high is not None else 2**62
    return F.col(place).between(max(1, min(a, b)), max(a, b))


def template(text: str) -> Column:
    """«Field» marks replaced by values, blanks for nulls."""
    parts = re.split(r"«([^»]+)»", text)
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def skip_and_number(df: DataFrame, order: str, skip: Column) -> DataFrame:
    """merge_rec: place in the list; merge_seq: place in the output, without the skipped records."""
    listed = numbered(df, [order], "merge_rec")
    return numbered(listed.where(~F.coalesce(skip, F.lit(False))), [order], "merge_seq")


def grouped_output(df: DataFrame, place: str, per_output: int, value: str) -> DataFrame:
    """`per_output` consecutive records share one output; a group is no larger than that."""
    g = df.groupBy((F.floor((F.col(place) - 1) / per_output) + 1).cast("long").alias("output"))
    return g.agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias("values"))


def normal_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def compare(left: DataFrame, right: DataFrame, page: str, text: str, most: int | None = None, words: bool = False) -> DataFrame:
    """(page, added, removed, truncated): pages pair by number, extras are wholly added or removed.

    With `most`, pages of over that many lines only get counts. Each pair is compared by itself in an Arrow batch; a pair is one row.
    """
    split = (lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")) if words else normal_lines
    a, b = (d.select(F.col(page).cast("long").alias("page"), split(F.col(text)).alias(n)) for d, n in ((left, "a"), (right, "b")))
    schema = "page long, removed array<int>, added array<int>, removed_count long, added_count long, truncated boolean"

    def run(batches):
        for pdf in batches:
            rows = []
            for p, x, y in zip(pdf.page, pdf.a, pdf.b, strict=True):
                x, y = ([] if v is None else list(v) for v in (x, y))
                if x == y:
                    rows.append((p, [], [], 0, 0, False))
                elif most is not None and max(len(x), len(y)) > most and x and y:
                    rows.append((p, [], [], len(x), len(y), True))
                else:
                    removed, added = edits(x, y)
                    rows.append((p, removed, added, len(removed), len(added), False))
            yield pd.DataFrame(rows, columns=["page", "removed", "added", "removed_count", "added_count", "truncated"])

    return a.join(b, "page", "full_outer").mapInPandas(run, schema)


def pick_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct values without case, in natural order."""
    values = df.where(F.col(column).isNotNull() & (F.trim(column) != "")).groupBy(F.lower(column).alias("_k")).agg(F.min(column).alias("value"))
    return values.orderBy(natural_key(F.col("value")), "value").select("value")


_REF = re.compile(r"(?:(?:'[^']+'|\w+)!)?\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?")


def precedents(formula: str) -> list[tuple[int, int, int, int]]:
    """(row, column, row, column) of the ranges that a formula reads on its own sheet, each once."""
    from ..functions.sheet import column_index

    out = []
    for m in _REF.finditer(re.sub(r'"[^"]*"', "", formula)):
        if "!" in m[0]:
            continue
        c1, r1 = column_index(m[1]), int(m[2])
        c2, r2 = (column_index(m[3]), int(m[4])) if m[3] else (c1, r1)
        box = (min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2))
        if box not in out:
            out.append(box)
    return out


def dependents(edges: DataFrame, row: int, column: int) -> DataFrame:
    """Cells whose formula reads a cell: edges are (cell, r1, c1, r2, c2)."""
    return edges.where((F.lit(row).between(F.col("r1"), F.col("r2"))) & (F.lit(column).between(F.col("c1"), F.col("c2")))).select("cell").distinct()
