"""Spreadsheet functions: statistics, regular expressions, dates, finance, addresses."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .coerce import to_number


def column_label(index: int) -> str:
    """1 -> A, 27 -> AA."""
    out = ""
    while index > 0:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_index(label: str) -> int:
    n = 0
    for ch in label.upper():
        n = n * 26 + ord(ch) - 64
    return n


def parse_range(address: str) -> tuple[int, int, int, int]:
    """(row, column, row, column) of A1 or A1:B2, ends in order."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", address.strip())
    if not m or int(m[2]) < 1:
        raise ValueError(f"no range: {address!r}")
    c1, r1 = column_index(m[1]), int(m[2])
    c2, r2 = (column_index(m[3]), int(m[4])) if m[3] else (c1, r1)
    if max(r1, r2) > 1_048_576 or max(c1, c2) > 16_384:
        raise ValueError(f"{address!r} leaves the grid")
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def percentile_inc(c: Column, q: float) -> Column:
    return F.percentile(c, F.lit(q))


def percentile_exc(df: DataFrame, column: str, q: float) -> DataFrame:
    """PERCENTILE.EXC, by the inclusive percentile at the place that gives the same rank; null where it's undefined."""
    n = df.where(F.col(column).isNotNull()).count()
    at = q * (n + 1)
    if n < 1 or at < 1 or at > n:
        return df.sparkSession.createDataFrame([(None,)], "value double")
    return df.agg(F.percentile(F.col(column), F.lit((at - 1) / (n - 1) if n > 1 else 0.0)).alias("value"))


def rank_avg(df: DataFrame, column: str, ascending: bool = False, group: list[str] | None = None) -> DataFrame:
    """RANK.AVG: the mean of the places that equal values take. Counts by value come first, so ties are one row each."""
    g = group or []
    counts = df.groupBy(*g, column).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*g).orderBy(F.col(column).asc() if ascending else F.col(column).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn("rank_avg", F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, [*g, column])


def skew_p(c: Column) -> Column:
    """SKEW.P: skewness of a whole population; null without spread."""
    return F.when(F.stddev_pop(c) > 0, F.skewness(c))


def modes(df: DataFrame, column: str, group: Sequence[str] = (), multiple: bool = False) -> DataFrame:
    """MODE.SNGL, or MODE.MULT if `multiple`: (group, mode), the least or all of the values that occur most often.

    A group in which no value repeats has no row. Counts by value come first, so a frequent value is one row. Null values take no part.
    """
    g = list(group)
    counts = df.where(F.col(column).isNotNull()).groupBy(*g, column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not multiple:
        return counts.groupBy(*g).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("mode"))).alias("_least")).select(*g, "_least.mode")
    top = counts.groupBy(*g).agg(F.max("_n").alias("_top")).withColumnsRenamed({c: f"_top_{c}" for c in g})
    same = F.col("_n") == F.col("_top")
    for c in g:
        same &= F.col(c).eqNullSafe(F.col(f"_top_{c}"))
    return counts.join(top, same).select(*g, F.col(column).alias("mode"))


def base(c: Column, radix: int, least: int = 0) -> Column:
    t = F.conv(c.cast("string"), 10, radix)
    return F.lpad(t, F.greatest(F.length(t), F.lit(least)), F.lit("0"))


def ceiling_math(c: Column, step: float = 1.0) -> Column:
    return F.ceil(c / step) * step


def floor_math(c: Column, step: float = 1.0) -> Column:
    return F.floor(c / step) * step


def combina(n: int, k: int) -> int:
    from math import comb

    return comb(n + k - 1, k) if n + k else 1


def combinations_again(n: Column, k: Column) -> Column:
    """COMBINA of columns: ways to take k of n with repeats, exact below 2^53; null for negative numbers, and 0 of nothing but for k = 0."""
    fold = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda acc, i: acc * (n - 1 + i) / i)
    return F.when((n >= 0) & (k >= 0), F.when(k == 0, 1.0).otherwise(fold))


def acot(c: Column) -> Column:
    """ACOT, between 0 and pi."""
    return F.pi() / 2 - F.atan(c)


def acoth(c: Column) -> Column:
    """ACOTH; null within -1 to 1."""
    return F.when(F.abs(c) > 1, F.ln((c + 1) / (c - 1)) / 2)


def decimal(text: Column, radix: int) -> Column:
    """DECIMAL: the number that digits of a base (2 to 36, in either case) stand for; null where a character isn't one, or beyond 2^53 - 1."""
    digits, most = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix], 2**53 - 1
    width = next(k for k in range(1, 54) if radix**k > most)
    t = F.lower(F.trim(text))
    fits = t.rlike(f"^0*[{digits}]{{1,{width}}}$")
    value = F.conv(F.when(fits, t), radix, 10).cast("long")
    return F.when(value <= most, value)


#: Bit functions take whole numbers from 0 to this one.
MOST_BITS = 2**48 - 1


def _bits(*columns: Column) -> Column:
    fits = F.lit(True)
    for c in columns:
        fits = fits & c.between(0, MOST_BITS) & (c == F.floor(c))
    return fits


def bit_and(a: Column, b: Column) -> Column:
    return F.when(_bits(a, b), a.cast("long").bitwiseAND(b.cast("long")))


def bit_or(a: Column, b: Column) -> Column:
    return F.when(_bits(a, b), a.cast("long").bitwiseOR(b.cast("long")))


def bit_xor(a: Column, b: Column) -> Column:
    return F.when(_bits(a, b), a.cast("long").bitwiseXOR(b.cast("long")))


def bit_shift(c: Column, by: int) -> Column:
    """BITLSHIFT, or BITRSHIFT for a negative `by`; null where a number, the shift (over 53) or the result leaves the bounds."""
    if abs(by) > 53:
        return F.lit(None).cast("long")
    if by < 0:
        return F.when(_bits(c), F.shiftright(c.cast("long"), -by))
    return F.when(_bits(c) & (c <= MOST_BITS >> by), F.shiftleft(c.cast("long"), by))


def network_days(start: Column, end: Column) -> Column:
    """Weekdays from start to end, both included, by arithmetic on weeks and not by a calendar."""
    def until(c: Column) -> Column:
        days = F.datediff(c, F.lit("1899-12-31").cast("date"))  # a Sunday
        return F.floor(days / 7) * 5 + F.least(days % 7, F.lit(5))

    return (until(F.date_add(end.cast("date"), 1).cast("date")) - until(start.cast("date"))).cast("long") + F.lit(0)


def _working(weekend: int | str) -> list[int]:
    """1 for each working day, Monday first. Codes 1-7 are two days off from Saturday-Sunday on, 11-17 one from Sunday on; a mask marks days off by 1."""
    if isinstance(weekend, str):
        if not re.fullmatch("[01]{7}", weekend):
            raise ValueError(f"no weekend: {weekend!r}")
        return [1 - int(x) for x in weekend]
    if 1 <= weekend <= 7:
        off = {(weekend + 4) % 7, (weekend + 5) % 7}
    elif 11 <= weekend <= 17:
        off = {(weekend - 5) % 7}
    else:
        raise ValueError(f"no weekend: {weekend!r}")
    return [int(i not in off) for i in range(7)]


#: Days are counted from this Monday.
_MONDAY = dt.date(1900, 1, 1)


def _worked(day: Column, working: Sequence[int]) -> Column:
    """Working days from `_MONDAY` to the day before `day`, by arithmetic on weeks."""
    days = F.datediff(day.cast("date"), F.lit(_MONDAY))
    before = F.array(*(F.lit(x) for x in accumulate(working[:6], initial=0)))
    return F.floor(days / 7) * sum(working) + F.get(before, F.pmod(days, F.lit(7)))


def _days_off(holidays: Sequence[dt.date | str], working: Sequence[int]) -> list[dt.date]:
    """The holidays that fall on working days, in order, once each."""
    days = {x if isinstance(x, dt.date) else dt.date.fromisoformat(x) for x in holidays}
    return sorted(x for x in days if working[x.weekday()])


def network_days_intl(start: Column, end: Column, weekend: int | str = 1, holidays: Sequence[dt.date | str] = ()) -> Column:
    """NETWORKDAYS.INTL: working days from start to end, both included; negative if the end comes first. Null dates give null."""
    working = _working(weekend)
    first, last = F.least(start.cast("date"), end.cast("date")), F.greatest(start.cast("date"), end.cast("date"))
    n = _worked(F.date_add(last, 1), working) - _worked(first, working)
    off = _days_off(holidays, working)
    if off:
        n = n - F.size(F.filter(F.array(*map(F.lit, off)), lambda x: x.between(first, last)))
    known = start.isNotNull() & end.isNotNull()
    return F.when(known, F.when(end.cast("date") < start.cast("date"), -n).otherwise(n)).cast("long")


def workday_intl(day: Column, n: Column | int, weekend: int | str = 1, holidays: Sequence[dt.date | str] = ()) -> Column:
    """WORKDAY.INTL: the nth working day after a day, before it if n is negative, the day itself if n is 0. Null gives null.

    Working days are numbered, holidays left out; the number looked for is moved on by each holiday that it reaches.
    """
    working = _working(weekend)
    week = sum(working)
    if not week:
        raise ValueError("every day is off")
    day, n = day.cast("date"), F.lit(n) if isinstance(n, int) else n
    weekdays = [i for i, x in enumerate(working) if x]
    places = [(x - _MONDAY).days // 7 * week + weekdays.index(x.weekday()) + 1 for x in _days_off(holidays, working)]
    held = F.array(*(F.lit(x).cast("long") for x in places)) if places else F.array().cast("array<bigint>")
    done = F.when(n > 0, _worked(F.date_add(day, 1), working)).otherwise(_worked(day, working) + 1).cast("long")
    # backwards, `done` is the number of the next working day from `day` on: with n = -1 it's the one before
    real = done - F.size(F.filter(held, lambda x: x <= F.when(n > 0, done).otherwise(done - 1)))
    at = F.aggregate(held, (real + n).cast("long"), lambda acc, x: acc + F.when(x <= acc, 1).otherwise(0).cast("long"))
    on = F.get(F.array(*map(F.lit, weekdays)), F.pmod(at - 1, F.lit(week)).cast("int"))
    days = F.floor((at - 1) / week) * 7 + on
    return F.when(n == 0, day).otherwise(F.date_add(F.lit(_MONDAY), days.cast("int")))


def text_split(c: Column, separators: Sequence[str], ignore_empty: bool = False) -> Column:
    """TEXTSPLIT along one line: the parts between any of the separators, empty ones left out on demand."""
    if not separators or "" in separators:
        raise ValueError("separators must not be empty")
    literal = "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", x) for x in sorted(separators, key=len, reverse=True))
    parts = F.split(c, literal, -1)
    return F.filter(parts, lambda x: x != "") if ignore_empty else parts


def number_value(text: Column, decimal: str = ".", group: str = ",") -> Column:
    """NUMBERVALUE: white space goes, group signs before the decimal sign go, each final % divides by 100; empty text is 0, no number is null."""
    t = F.regexp_replace(text, r"\s+", "")
    body = F.regexp_replace(t, "%+$", "")
    at = F.instr(body, decimal)
    whole = F.replace(F.when(at > 0, F.substr(body, F.lit(1), at - 1)).otherwise(body), F.lit(group), F.lit(""))
    rest = F.when(at > 0, F.concat(F.lit("."), F.substr(body, at + 1))).otherwise("")
    value = F.when(whole.rlike(r"^[+-]?\d*([eE][+-]?\d+)?$"), to_number(F.concat(whole, rest)))
    return F.when(t == "", 0.0).otherwise(value / F.pow(F.lit(100.0), F.length(t) - F.length(body)))


def _from_end(indices: Sequence[int], n: int) -> list[int]:
    """Places from 1 on; negative ones count from the end."""
    out = [i if i > 0 else n + 1 + i for i in indices]
    if not all(i and 1 <= o <= n for i, o in zip(indices, out, strict=True)):
        raise ValueError(f"places {list(indices)} leave 1 to {n}")
    return out


def choose_columns(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """CHOOSECOLS: columns by place, negative from the end; a column taken again gets its turn after its name."""
    taken: dict[str, int] = {}
    out = []
    for i in _from_end(indices, len(df.columns)):
        name = df.columns[i - 1]
        taken[name] = taken.get(name, 0) + 1
        out.append(df[name].alias(name if taken[name] == 1 else f"{name}_{taken[name]}"))
    return df.select(*out)


def choose_rows(df: DataFrame, order: Sequence[Column | str], indices: Sequence[int]) -> DataFrame:
    """CHOOSEROWS: rows by their place in `order`, negative from the end, with `place` in the result. A row may be taken again."""
    from ..operators.records import numbered

    if all(i > 0 for i in indices):
        at, some = _from_end(indices, df.limit(max(indices)).count()), df.orderBy(*order).limit(max(indices))
    else:
        at, some = _from_end(indices, df.count()), df
    wanted = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("place")) for k, i in enumerate(at, 1)))
    rows = numbered(some, order, "_at_row").where(F.col("_at_row").isin(at))
    return rows.withColumn("_w", F.explode(F.filter(wanted, lambda x: x["at"] == F.col("_at_row")))).select(F.col("_w.place").alias("place"), *df.columns)


def text_before(c: Column, sep: str) -> Column:
    return F.when(F.instr(c, sep) > 0, F.substring_index(c, sep, 1))


def text_after(c: Column, sep: str) -> Column:
    return F.when(F.instr(c, sep) > 0, F.substr(c, F.instr(c, sep) + len(sep)))


def safe_pattern(pattern: str) -> str:
    """The pattern, unless it may take exponential time: a repeat of a group that itself ends in a repeat, or of overlapping choices."""
    if re.search(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)\s*[+*{]", pattern) or re.search(r"\(([^()|]+)\|\1[^()]*\)[+*]", pattern):
        raise ValueError("the pattern may take too long")
    re.compile(pattern)
    return pattern


def regex_test(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(("(?i)" if ignore_case else "") + safe_pattern(pattern))


def regex_extract(c: Column, pattern: str, mode: int = 0, ignore_case: bool = False) -> Column:
    """0: the first match, 1: all matches, 2: the groups of the first match; null without a match."""
    p = ("(?i)" if ignore_case else "") + safe_pattern(pattern)
    if mode == 1:
        return F.regexp_extract_all(c, F.lit(p), F.lit(0))
    if mode == 2:
        return F.when(c.rlike(p), F.array(*(F.regexp_extract(c, p, i + 1) for i in range(re.compile(pattern).groups))))
    return F.when(c.rlike(p), F.regexp_extract(c, p, 0))


def regex_replace(c: Column, pattern: str, by: str, nth: int = 0, ignore_case: bool = False) -> Column:
    """All matches, or only the nth (from the end if negative): the pieces between matches are joined again."""
    p = ("(?i)" if ignore_case else "") + safe_pattern(pattern)
    if nth == 0:
        return F.regexp_replace(c, p, by)
    found, gaps = F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.split(c, p, -1)
    at = F.lit(nth - 1) if nth > 0 else F.size(found) + nth
    new = F.transform(found, lambda m, i: F.when(i == at, F.regexp_replace(m, p, by)).otherwise(m))
    return F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


@F.pandas_udf(DoubleType())
def rate(periods: pd.Series, payment: pd.Series, present: pd.Series, future: pd.Series) -> pd.Series:
    """Interest rate of an annuity paid at period ends: the secant method, else bisection on a fixed grid."""
    def value(r: float, n: float, p: float, v: float, f: float) -> float:
        return v + p * n + f if abs(r) < 1e-12 else v * (1 + r) ** n + p * ((1 + r) ** n - 1) / r + f

    def solve(n: float, p: float, v: float, f: float) -> float | None:
        a, b = 0.05, 0.1
        try:
            fa, fb = value(a, n, p, v, f), value(b, n, p, v, f)
            for _ in range(60):
                if fb == fa:
                    break
                a, b, fa = b, b - fb * (b - a) / (fb - fa), fb
                fb = value(b, n, p, v, f)
                if abs(b - a) < 1e-12:
                    return b
        except (OverflowError, ZeroDivisionError, TypeError):
            pass
        grid = [-0.99 + i * 0.01 for i in range(600)]
        for lo, hi in zip(grid, grid[1:], strict=False):
            try:
                if value(lo, n, p, v, f) * value(hi, n, p, v, f) <= 0:
                    for _ in range(200):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if value(lo, n, p, v, f) * value(mid, n, p, v, f) > 0 else (lo, mid)
                    return (lo + hi) / 2
            except OverflowError:
                continue
        return None

    return pd.Series([solve(*x) for x in zip(periods, payment, present, future, strict=True)], dtype="float64")


def add_months(day: Column, n: Column | int) -> Column:
    """Months later, the day held to the end of the month."""
    return F.add_months(day, n)


def add_weekdays(day: Column, n: int) -> Column:
    """The nth weekday after (or before) a day: weeks by division, the rest by a walk over fixed offsets."""
    steps = F.sequence(F.lit(1), F.lit(max(1, abs(n) * 2 + 7)))
    sign = 1 if n > 0 else -1
    days = F.transform(steps, lambda i: F.date_add(day.cast("date"), (i * sign).cast("int")))
    weekdays = F.filter(days, lambda x: ~F.dayofweek(x).isin(1, 7))
    return day.cast("date") if n == 0 else F.element_at(weekdays, abs(n))
