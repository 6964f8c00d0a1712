"""Range statistics, spreadsheet aggregates, conditional aggregates and consolidation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_number


def range_stats(df: DataFrame, column: str, withheld: Column | None = None) -> DataFrame:
    """One row: cells, non_empty, distinct_count, numeric_count, sum, min, max, avg, withheld.

    Blank is null or empty text. Withheld cells are counted and left out of every statistic. Text that spells
    a number counts as numeric only if the column is numeric itself, so 1 and '1' stay distinct.
    """
    hidden = F.lit(False) if withheld is None else F.coalesce(withheld, F.lit(False))
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    full = F.when(~hidden & c.isNotNull() & ((c != "") if kind == "string" else F.lit(True)), c)
    number = full.cast("double") if kind in ("byte", "short", "integer", "long", "float", "double", "decimal") else F.lit(None).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("cells"), F.count(full).alias("non_empty"), F.count_distinct(full).alias("distinct_count"), F.count(number).alias("numeric_count"),
        F.sum(number).alias("sum"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("avg"), F.count_if(hidden).alias("withheld"),
    )


def top_values(df: DataFrame, column: str, order: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties go to the one seen first by `order`."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


#: Pivot aggregates over a numeric column; a sample statistic of one value is null.
AGGREGATES = {
    "sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min, "product": F.product, "countNums": F.count,
    "stdDev": F.stddev_samp, "stdDevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def aggregates(column: Column, names: Sequence[str] = tuple(AGGREGATES)) -> list[Column]:
    return [AGGREGATES[n](column).alias(n) for n in names]


def numeric(df: DataFrame, column: str) -> DataFrame:
    """The column as numbers: text that spells one counts, other text is ignored."""
    return df.withColumn(column, to_number(F.col(column).cast("string")))


def conditional(pred: Column, value: Column | None = None) -> dict[str, Column]:
    """SUMIFS, COUNTIFS, AVERAGEIFS, MINIFS and MAXIFS of one predicate; the last two are 0 over nothing."""
    x = F.lit(1) if value is None else value
    hit = F.when(F.coalesce(pred, F.lit(False)), x)
    return {"sumifs": F.coalesce(F.sum(hit), F.lit(0)), "countifs": F.count_if(F.coalesce(pred, F.lit(False))), "averageifs": F.avg(hit),
            "minifs": F.coalesce(F.min(hit), F.lit(0)), "maxifs": F.coalesce(F.max(hit), F.lit(0))}


def criterion(column: Column, value: object) -> Column:
    """Equality of conditional aggregates: a number also matches text that spells it, text matches without case."""
    text = column.cast("string")
    n = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if n is None:
        try:
            n = float(str(value))
        except ValueError:
            return F.lower(text) == str(value).lower()
    return F.coalesce(to_number(text) == n, F.lit(False))


def percent_of(pred: Column, value: Column) -> Column:
    """Sum of a part over the sum of all; a zero total is an error in sheets and null here."""
    return F.try_divide(F.sum(F.when(pred, value)), F.sum(value))


def consolidate_positions(areas: Sequence[DataFrame], how: str = "sum") -> DataFrame:
    """Areas of (r, c, value) merged by position; count counts cells that aren't blank."""
    agg = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min}[how]
    whole = areas[0]
    for a in areas[1:]:
        whole = whole.unionByName(a)
    return whole.groupBy("r", "c").agg(agg("value").alias("value"))


def consolidate_labels(df: DataFrame, label: str, value: str, order: str, how: str = "sum") -> DataFrame:
    """Rows merged by label (blank labels skipped, case kept), in first-seen order. Counts are of label rows, and the average is over them."""
    if how not in ("sum", "count", "average"):
        raise ValueError(f"labels can't be consolidated by {how}")
    total, rows = F.sum(value), F.count(F.lit(1))
    out = {"sum": F.coalesce(total, F.lit(0.0)), "count": rows, "average": F.try_divide(F.coalesce(total, F.lit(0.0)), rows)}[how]
    named = df.where(F.col(label).isNotNull() & (F.trim(label) != ""))
    return named.groupBy(F.col(label).alias("label")).agg(out.alias("value"), F.min(order).alias("first_seen")).orderBy("first_seen")


def subtotal(df: DataFrame, group: str, value: str, how: str = "sum") -> DataFrame:
    """A row for each group and one of the grand total (group null, level 1)."""
    agg = {"sum": F.sum, "count": F.count, "average": F.avg}[how]
    return df.rollup(group).agg(agg(value).alias("value"), F.grouping_id().alias("level"))


def status_bar(df: DataFrame, column: str) -> DataFrame:
    n = to_number(F.col(column).cast("string"))
    text = F.col(column).cast("string")
    return df.agg(F.avg(n).alias("average"), F.count(F.when(text != "", text)).alias("counta"), F.count(n).alias("count"), F.min(n).alias("min"), F.max(n).alias("max"), F.sum(n).alias("sum"))


def rollup_issues(df: DataFrame, reason: str, count: str, retryable: str, sections: Mapping[str, str], other: str = "other") -> DataFrame:
    """Reasons folded into sections: counts are summed, and a section can be retried if any reason in it can."""
    section = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sections.items() for x in kv)), F.col(reason)), F.lit(other))
    return df.groupBy(section.alias("section")).agg(F.sum(count).alias("n"), F.bool_or(retryable).alias("retryable"))


def progress(df: DataFrame, group: str, done: Column, failed: Column) -> DataFrame:
    """Whole percent done of each group, at most 99 while something is open or failed, null for an empty group."""
    total, ready, bad = F.count(F.lit(1)), F.count_if(done), F.count_if(failed)
    percent = F.floor(ready * 100 / total)
    return df.groupBy(group).agg(total.alias("total"), ready.alias("done"), bad.alias("failed"),
                                 F.when(total == 0, None).when((ready < total) | (bad > 0), F.least(percent, F.lit(99))).otherwise(percent).cast("long").alias("percent"))


def complete_groups(df: DataFrame, key: str, number: str, total: str, readable: Column) -> DataFrame:
    """Keys whose rows number 1..total without gaps, agree on one total, and have something readable."""
    return df.groupBy(key).agg(
        F.count_distinct(number).alias("pages"), F.min(number).alias("low"), F.max(number).alias("high"), F.min(total).alias("total"), F.max(total).alias("total2"), F.bool_or(readable).alias("readable"),
    ).where("low = 1 AND high = total AND pages = total AND total = total2 AND readable").select(key, "pages")
