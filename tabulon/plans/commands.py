"""The command surface: a checked batch of operations on a table, applied as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, ordering, pivot, relations


@dataclass(frozen=True)
class Batch:
    """Operations under a version, on top of a revision."""

    operations: Sequence[Mapping[str, object]]
    base_revision: int = 0
    dsl_version: int = 1
    transaction_id: str = ""
    summary: str = ""


@dataclass
class Book:
    """Named tables with a revision. Tables are DataFrames with a row order in `row_idx`; nothing is computed until one is read."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    revision: int = 0


def _set_cell(df, op):
    at, c = int(op["row"]), str(op["column"])
    return df.withColumn(c, F.when(F.col("row_idx") == at, F.lit(op.get("value"))).otherwise(F.col(c)))


def _set_formula(df, op):
    return df.withColumn(str(op["column"]), F.expr(str(op["expression"])))


def _set_range(df, op):
    start, values, c = int(op["row"]), list(op["values"]), str(op["column"])
    at = F.col("row_idx") - start
    listed = F.get(F.array(*map(F.lit, values)), at.cast("int"))
    return df.withColumn(c, F.when(at.between(0, len(values) - 1), listed).otherwise(F.col(c)))


def _clear(df, op):
    rows = F.col("row_idx").between(int(op["first"]), int(op["last"]))
    for c in op["columns"]:
        df = df.withColumn(c, F.when(~rows, F.col(c)))
    return df


def _delete_rows(df, op):
    first, last = int(op["first"]), int(op["last"])
    return df.where(~F.col("row_idx").between(first, last)).withColumn("row_idx", F.when(F.col("row_idx") > last, F.col("row_idx") - (last - first + 1)).otherwise(F.col("row_idx")))


def _insert_rows(df, op):
    at, n = int(op["at"]), int(op["count"])
    moved = df.withColumn("row_idx", F.when(F.col("row_idx") >= at, F.col("row_idx") + n).otherwise(F.col("row_idx")))
    blank = df.sparkSession.range(n).select((F.col("id") + at).alias("row_idx"))
    return moved.unionByName(blank.withColumn("row_idx", F.col("row_idx").cast(df.schema["row_idx"].dataType)), allowMissingColumns=True)


#: Operations on one table, which give a new one.
TABLE_OPS: dict[str, Callable[[DataFrame, Mapping], DataFrame]] = {
    "set_cell": _set_cell, "clear_cell": lambda df, op: _set_cell(df, {**op, "value": None}), "set_formula": _set_formula, "set_range": _set_range, "clear_range": _clear,
    "fill_range": lambda df, op: df.withColumn(str(op["column"]), F.when(F.col("row_idx").between(int(op["first"]), int(op["last"])), F.lit(op["value"])).otherwise(F.col(str(op["column"])))),
    "copy_range": lambda df, op: filters.filtered_copy(df, str(op["filter_column"]), list(op["filter_values"]), list(op["columns"])) if "filter_column" in op else df.select(*op["columns"]),
    "convert_to_values": lambda df, op: df, "find_replace": lambda df, op: df.withColumn(str(op["column"]), filters.replace(str(op["column"]), str(op["find"]), str(op["replace"]), bool(op.get("whole")), bool(op.get("match_case")))),
    "sort_range": lambda df, op: ordering.sort_range(df, str(op["by"]), "row_idx", bool(op.get("ascending", True))),
    "set_filter": lambda df, op: df.where(filters.in_list(str(op["column"]), list(op["values"]), bool(op.get("blanks")))), "clear_filter": lambda df, op: df,
    "set_filter_criteria": lambda df, op: df.where(filters.custom(str(op["column"]), tuple(op["first"]), tuple(op["second"]) if op.get("second") else None, str(op.get("join", "and")))),
    "add_conditional_format": lambda df, op: filters.flag_duplicates(df, str(op["column"])) if op["kind"] == "duplicate" else filters.flag_top(df, str(op["column"]), int(op["n"]), bool(op.get("percent"))),
    "set_data_validation": lambda df, op: df.withColumn("valid", F.coalesce(F.expr(str(op["rule"])), F.lit(False))), "remove_duplicates": lambda df, op: relations.dedupe(df, list(op["columns"]), "row_idx"),
    "insert_rows": _insert_rows, "delete_rows": _delete_rows, "insert_cols": lambda df, op: df.withColumns({c: F.lit(None).cast("string") for c in op["names"]}), "delete_cols": lambda df, op: df.drop(*op["names"]),
}


def _pivot(book: Book, op: Mapping) -> None:
    how = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min}
    values = {f"{v['how']}_{v['column']}": how[v["how"]](v["column"]) for v in op["values"]}
    book.tables[str(op["name"])] = pivot.hierarchy(book.tables[str(op["table"])], list(op["rows"]), values)


def apply(book: Book, batch: Batch) -> Book:
    """Checks the whole batch, then gives the next revision; the old one stays as it is."""
    if batch.dsl_version != 1:
        raise ValueError(f"version {batch.dsl_version} isn't known")
    if batch.base_revision != book.revision:
        raise ValueError(f"the batch is for revision {batch.base_revision}, the book is at {book.revision}")
    known = {*TABLE_OPS, "add_sheet", "delete_sheet", "duplicate_sheet", "rename_sheet", "add_pivot", "add_table", "add_defined_name", "move_range"}
    for op in batch.operations:
        if op.get("type") not in known:
            raise ValueError(f"no operation {op.get('type')!r}")
    out = Book(dict(book.tables), book.revision + 1)
    for op in batch.operations:
        kind, name = str(op["type"]), str(op.get("table", ""))
        if kind in TABLE_OPS:
            out.tables[str(op.get("into", name))] = TABLE_OPS[kind](out.tables[name], op)
        elif kind in ("add_sheet", "add_table"):
            out.tables[str(op["name"])] = op["data"]  # type: ignore[assignment]
        elif kind in ("duplicate_sheet", "add_defined_name"):
            out.tables[str(op["name"])] = out.tables[name]
        elif kind in ("rename_sheet", "move_range"):
            out.tables[str(op["name"])] = out.tables.pop(name)
        elif kind == "delete_sheet":
            del out.tables[name]
        else:
            _pivot(out, op)
    return out
