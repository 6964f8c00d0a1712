"""Table-valued functions of the sheet, for lateral joins in SQL text and for tables dealt by a key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="row int, col int, value string")
class TextSplit:
    """TEXTSPLIT: a text cut by columns and rows, one output row for each cell, from 1; null text gives none.

    Cells of a short row are padded with null up to the longest one, as they fill the grid they spill into.
    """

    def eval(self, text: str, columns: str, rows: str = None, skip: bool = False) -> Iterator[tuple]:
        if text is None:
            return
        lines = text.split(rows) if rows else [text]
        grid = [line.split(columns) if columns else [line] for line in lines]
        if skip:
            grid = [[c for c in line if c] for line in grid if any(line)]
        wide = max(map(len, grid), default=0)
        for i, line in enumerate(grid, 1):
            for j in range(wide):
                yield i, j + 1, line[j] if j < len(line) else None


@udtf(returnType="value double")
class Sequence:
    """SEQUENCE of one row's own start, step and count; a null gives none."""

    def eval(self, count: int, start: float, step: float) -> Iterator[tuple]:
        if None not in (count, start, step):
            for k in range(count):
                yield (start + k * step,)


@udtf(returnType="key bigint, place bigint, value double, total double")
class Scan:
    """SCAN with addition over an input table dealt by key and put in order: the running total behind each row. Nulls add nothing.

    The rows of a key pass one by one, so a key of any length holds one number of state.
    """

    def __init__(self):
        self.total = 0.0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.total += row["value"] or 0.0
        yield row["key"], row["place"], row["value"], self.total


def register(spark: SparkSession) -> None:
    """Makes text_split, sheet_sequence and sheet_scan known to SQL text of this session."""
    for name, function in (("text_split", TextSplit), ("sheet_sequence", Sequence), ("sheet_scan", Scan)):
        spark.udtf.register(name, function)
