"""Filters over typed columns: value lists, conditions, wildcards, labels, timelines, privacy, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import display_key, month_key, to_number


def in_list(column: str, values: Sequence[str], blanks: bool = False) -> Column:
    """Rows whose text is in a list; blanks only if asked for."""
    c = F.col(column).cast("string")
    blank = c.isNull() | (c == "")
    return F.coalesce(F.when(blank, F.lit(blanks)).otherwise(c.isin(*values)), F.lit(False))


def wildcard(column: Column, pattern: str) -> Column:
    """Case-insensitive match of * and ?; a tilde takes them as they are."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            ch, plain = pattern[i], True
        else:
            plain = ch not in "*?"
        out += (f"\\{ch}" if ch in "%_\\" else ch) if plain else "%" if ch == "*" else "_"
        i += 1
    return F.coalesce(column.cast("string").ilike(out), F.lit(False))


def condition(column: str, op: str, value: str) -> Column:
    """One custom condition. Equality is of text with wildcards; order compares numbers, and text never passes it."""
    c = F.col(column)
    if op == "=":
        return wildcard(c, value)
    if op == "<>":
        return ~wildcard(c, value)
    number, bound = to_number(c.cast("string")), float(value)
    test = {">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound}[op]
    return F.coalesce(test, F.lit(False))


def custom(column: str, first: tuple[str, str], second: tuple[str, str] | None = None, join: str = "and") -> Column:
    a = condition(column, *first)
    if second is None:
        return a
    b = condition(column, *second)
    return a & b if join == "and" else a | b


def color(*_: object) -> Column:
    raise NotImplementedError("rows carry no colors, so a color filter is declined")


def visible(df: DataFrame, criteria: Sequence[Column]) -> DataFrame:
    """Rows that no column's filter hides: the hidden set is the union over columns."""
    return df.where(reduce(lambda a, b: a & b, criteria, F.lit(True)))


def filtered_copy(df: DataFrame, column: str, values: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Chosen columns of the rows whose trimmed, case-folded value is listed (1 to 100 values)."""
    if not 1 <= len(values) <= 100:
        raise ValueError("from 1 to 100 filter values")
    return df.where(F.lower(F.trim(F.col(column).cast("string"))).isin(*(v.strip().lower() for v in values))).select(*columns)


def visible_copy(df: DataFrame, place: str, span: tuple[int, int], filtered: tuple[int, int] | None, hidden: Column, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of the rows from span[0] to span[1] without those that a filter over the rows `filtered` hides.

    Rows hidden outside the filter's range are copied, as all are without a filter. An unknown `hidden` (null) hides nothing.
    """
    inside = F.lit(False) if filtered is None else F.col(place).between(*filtered)
    return df.where(F.col(place).between(*span) & ~(inside & F.coalesce(hidden, F.lit(False)))).select(*columns)


def label(column: str, op: str, value: str) -> Column:
    c, v = F.lower(F.col(column).cast("string")), value.lower()
    return {"equal": c == v, "contains": c.contains(v), "beginsWith": c.startswith(v)}[op]


def slicer(df: DataFrame, column: str, members: Sequence[object]) -> DataFrame:
    return df.where(F.col(column).isin(*members))


def timeline(column: str, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Inclusive (year, month) range; blanks are out."""
    return F.coalesce(month_key(F.col(column)).between(first[0] * 12 + first[1] - 1, last[0] * 12 + last[1] - 1), F.lit(False))


def page_filter(df: DataFrame, column: str, item: str | None) -> DataFrame:
    return df if item in (None, "(All)") else df.where(F.col(column).cast("string") == item)


def find(df: DataFrame, columns: Sequence[str], needle: str, whole: bool = False, match_case: bool = False) -> DataFrame:
    """(row, column, value) of the cells that hold the needle, as one pass over an array of the columns."""
    fold = (lambda c: c) if match_case else F.lower
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    key = needle if match_case else needle.lower()
    hit = lambda s: fold(s["value"]) == key if whole else fold(s["value"]).contains(key)
    return df.select("*", F.inline(F.filter(cells, hit)))


def replace(column: str, needle: str, by: str, whole: bool = False, match_case: bool = False) -> Column:
    """Literal replacement in text; dollar signs and backslashes of `by` stay what they are."""
    c = F.col(column)
    if whole:
        same = c == needle if match_case else F.lower(c) == needle.lower()
        return F.when(same, F.lit(by)).otherwise(c)
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(c, ("" if match_case else "(?iu)") + quoted, by.replace("\\", "\\\\").replace("$", "\\$"))


#: Patterns of personal data in cells (fixed values).
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)"


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def privacy(df: DataFrame, policy: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """The columns a policy lets through (allow, redact), and one row of counts for its statistics-only columns.

    Columns without a policy are denied.
    """
    shown = [F.col(c) if policy[c] == "allow" else redact(F.col(c)).alias(c) for c in df.columns if policy.get(c) in ("allow", "redact")]
    counted = [c for c in df.columns if policy.get(c) == "statistics-only"]
    stats = df.agg(F.count(F.lit(1)).alias("cells"), *(F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in counted))
    return df.select(*shown), stats


def browse(df: DataFrame, path: str, root: str, words: Sequence[str], id_col: str, after: int, through: int, limit: int) -> DataFrame:
    """A page of an index: under a root, all words in the path, ids in (after, through], the smallest first."""
    page = df.where(F.col(path).startswith(root) & (F.col(id_col) > after) & (F.col(id_col) <= through))
    for w in words:
        page = page.where(F.contains(F.lower(F.col(path)), F.lit(w.lower())))
    return page.orderBy(id_col).limit(limit)


def flag_duplicates(df: DataFrame, column: str, name: str = "duplicate") -> DataFrame:
    """Marks values whose display key occurs more than once. Counts are joined back, so a hot key splits as a join does."""
    keyed = df.withColumn("_key", display_key(F.col(column).cast("string")))
    counts = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return keyed.join(counts, "_key", "left").withColumn(name, F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_key", "_n")


def flag_top(df: DataFrame, column: str, n: int, percent: bool = False, name: str = "top") -> DataFrame:
    """Marks the n (or n percent, at least one) largest values with their ties, by a bound that one value each decides."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    count = max(1, values.count() * n // 100) if percent else n
    bound = values.orderBy(F.desc("_v")).limit(count).agg(F.min("_v")).first()[0]
    return df.withColumn(name, F.coalesce(F.col(column) >= F.lit(bound), F.lit(False)))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a validation rule, with the names of the broken rules."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)
