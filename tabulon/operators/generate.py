"""Generators and what-if: series, flash fill, goal seek, data tables, chart choice."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _places(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"))


def linear_series(spark: SparkSession, start: float, step: float, n: int, stop: float | None = None) -> DataFrame:
    """(i, value) from start by step, cut behind stop in the direction of the step. Made where it's used, not on the driver."""
    v = F.lit(float(start)) + F.col("i") * F.lit(float(step))
    out = _places(spark, n).select("i", v.alias("value"))
    return out if stop is None else out.where((F.col("i") == 0) | (F.col("value") <= stop if step >= 0 else F.col("value") >= stop))


def growth_series(spark: SparkSession, start: float, factor: float, n: int, stop: float | None = None) -> DataFrame:
    """Powers of a factor; a stop cuts from the first value that passes it in the direction of movement."""
    take, value = n, float(start)
    for i in range(1, n):
        new = value * factor
        if not math.isfinite(new) or (stop is not None and (new > stop if new >= value else new < stop)):
            take = i
            break
        value = new
    return _places(spark, take).select("i", (F.lit(float(start)) * F.pow(F.lit(float(factor)), F.col("i"))).alias("value"))


def _date_at(day: Column, unit: str, i: Column, step: int) -> Column:
    """The date i steps after a day. Months count from the start, so a clamped month end doesn't shorten later ones."""
    match unit:
        case "day":
            return F.date_add(day, i * step)
        case "month":
            return F.add_months(day, i * step)
        case "year":
            return F.add_months(day, i * step * 12)
        case "weekday":
            # the k-th weekday after a day: whole weeks of five, then over the weekend if the rest passes it
            first = (F.dayofweek(day) + 5) % 7
            k = F.least(first, F.lit(4)) + i * step
            return F.when(i == 0, day).otherwise(F.date_add(day, (F.floor(k / 5) * 7 + k - F.floor(k / 5) * 5 - first).cast("int")))
    raise ValueError(f"no unit {unit!r}")


def _at(kind: str, start: Column, step: Column, i: Column) -> Column:
    return start + i * step if kind == "linear" else start * F.pow(step, i)


def row_series(df: DataFrame, start: Column, step: Column, n: int, kind: str = "linear", stop: Column | None = None) -> DataFrame:
    """Each row with a series of its own, as rows (i, value): n values at most, linear or growth.

    A stop cuts from the first value beyond it in the direction of movement, and so does a value that isn't finite. The start itself always stays;
    a row whose start or step is null has no series.
    """
    if kind not in ("linear", "growth"):
        raise ValueError(f"no series {kind!r}")
    value = lambda i: _at(kind, start.cast("double"), step.cast("double"), i)

    def beyond(i: Column) -> Column:
        now, before = value(i), value(i - 1)
        out = F.isnan(now) | (F.abs(now) == float("inf"))
        return (i > 0) & (out if stop is None else out | F.when(now >= before, now > stop).otherwise(now < stop))

    every = F.sequence(F.lit(0), F.lit(n - 1))
    ends = F.array_position(F.transform(every, lambda i: F.coalesce(beyond(i), F.lit(False))), True)
    taken = F.when(start.isNotNull() & step.isNotNull(), F.slice(every, F.lit(1), F.when(ends > 0, (ends - 1).cast("int")).otherwise(n)))
    return df.withColumn("i", F.explode(taken)).withColumn("value", value(F.col("i")))


def row_dates(df: DataFrame, start: Column, unit: str, step: int, n: int) -> DataFrame:
    """Each row with n dates from its own start, as rows (i, value)."""
    return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("value", _date_at(start.cast("date"), unit, F.col("i"), step))


def fill_lines(df: DataFrame, line: str, place: str, value: str, kind: str = "autofill", step: float = 1.0, stop: float | None = None, trend: bool = False) -> DataFrame:
    """Fills each line of a grid from its numeric head: adds `filled` and `written`.

    A row is a cell: its line, its place there (from 0 on, without gaps) and its number, null or not finite if the cell holds text or nothing. The seeds of a line are its
    numbers before the first other cell; a line that starts with none is left as it is. `kind` is linear or growth (from the first seed by `step`, until `stop`), or
    autofill (after the seeds by the difference of the first two, or 1). With `trend`, linear and growth are least squares through the seeds, which are
    replaced too; a growth through a seed of 0 or less gives back the seeds. `written` marks cells that the plan sets; others have null in `filled`.

    Lines are summed up by partial aggregates and joined back, so a line may be of any length.
    """
    if kind not in ("linear", "growth", "autofill") or (trend and kind == "autofill"):
        raise ValueError(f"no fill {kind!r}" + (" with a trend" if trend else ""))
    number = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value).cast("double"))
    cells = df.withColumns({"_v": number, "_i": F.col(place).cast("long")})
    heads = cells.groupBy(F.col(line).alias("_line")).agg(F.coalesce(F.min(F.when(F.col("_v").isNull(), F.col("_i"))), F.max("_i") + 1).alias("_k"))
    here = F.col(line).eqNullSafe(F.col("_line"))
    y = F.when(F.col("_v") > 0, F.log("_v")) if kind == "growth" else F.col("_v")
    seeds = cells.join(heads, here).where("_i < _k").groupBy("_line").agg(
        F.max("_k").alias("_k"), F.max(F.when(F.col("_i") == 0, F.col("_v"))).alias("_first"), F.max(F.when(F.col("_i") == 1, F.col("_v"))).alias("_second"),
        F.max_by("_v", "_i").alias("_last"), F.min("_v").alias("_low"), F.regr_slope(y, F.col("_i")).alias("_slope"), F.avg(y).alias("_my"), F.avg("_i").alias("_mi"))
    out, i, k = cells.join(seeds, here, "left"), F.col("_i"), F.col("_k")
    if trend:
        slope = F.coalesce("_slope", F.lit((math.log(step) if step > 0 else step) if kind == "growth" else float(step)))
        fit = F.col("_my") + slope * (i - F.col("_mi"))
        made = fit if kind == "linear" else F.when(F.col("_low") > 0, F.exp(fit)).when(i < k, F.col("_v"))
        written = k.isNotNull() & made.isNotNull()
    elif kind == "autofill":
        made, written = F.col("_last") + (i - k + 1) * F.coalesce(F.col("_second") - F.col("_first"), F.lit(1.0)), k.isNotNull() & (i >= k)
    else:
        made, written = _at(kind, F.col("_first"), F.lit(float(step)), i), k.isNotNull() & (i > 0)
        if stop is not None:
            before = _at(kind, F.col("_first"), F.lit(float(step)), i - 1)
            passed = (i > 0) & F.when(made >= before, made > stop).otherwise(made < stop)
            ends = out.where(passed).groupBy(F.col("_line").alias("_cut")).agg(F.min("_i").alias("_end"))
            out = out.join(ends, F.col(line).eqNullSafe(F.col("_cut")), "left")
            written = written & (F.col("_end").isNull() | (i < F.col("_end")))
    written = F.coalesce(written, F.lit(False))
    return out.select(*(F.col(c) for c in df.columns), F.when(written, made).alias("filled"), written.alias("written"))


def what_if(df: DataFrame, inputs: Mapping[str, Sequence[float]], expr: Callable[..., Column], name: str = "value") -> DataFrame:
    """Each row with the grid of one or two inputs that are put into a formula in turn: a row for each combination of the listed values."""
    if not 1 <= len(inputs) <= 2:
        raise ValueError("one or two inputs")
    for column, values in inputs.items():
        df = df.withColumn(column, F.explode(F.array(*(F.lit(float(v)) for v in values))))
    return df.withColumn(name, expr(*(F.col(c) for c in inputs)))


def date_series(spark: SparkSession, start: str, unit: str, step: int, n: int) -> DataFrame:
    """Days, weekdays, months or years from a date; months count from the start, so a clamped month end doesn't shorten later ones."""
    return _places(spark, n).select("i", _date_at(F.lit(start).cast("date"), unit, F.col("i").cast("int"), step).alias("value"))


def trend_series(spark: SparkSession, seeds: Sequence[float], n: int, growth: bool = False, step: float = 1.0) -> DataFrame:
    """Least squares through the seeds, on logarithms for growth; seeds with a value of 0 or less come back as they are."""
    if growth and min(seeds) <= 0:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(seeds)], "i long, value double")
    y = [math.log(v) for v in seeds] if growth else [float(v) for v in seeds]
    m, mx, my = len(y), (len(y) - 1) / 2, sum(y) / len(y)
    slope = sum((i - mx) * (v - my) for i, v in enumerate(y)) / sum((i - mx) ** 2 for i in range(m)) if m > 1 else (math.log(step) if growth and step > 0 else step)
    raw = F.lit(my - slope * mx) + F.col("i") * F.lit(slope)
    return _places(spark, n).select("i", (F.exp(raw) if growth else raw).alias("value"))


def autofill(spark: SparkSession, seeds: Sequence[float], n: int) -> DataFrame:
    """Seeds, then steps of the first two's difference (1 for one seed) from the last."""
    gap, last, k = (float(seeds[1] - seeds[0]) if len(seeds) > 1 else 1.0), float(seeds[-1]), len(seeds)
    listed = F.get(F.array(*map(F.lit, map(float, seeds))), F.col("i").cast("int"))
    return _places(spark, n).select("i", F.when(F.col("i") < k, listed).otherwise(F.lit(last) + (F.col("i") - (k - 1)) * gap).alias("value"))


def tile(df: DataFrame, order: str, times: int) -> DataFrame:
    """A range repeated downwards."""
    return df.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def learn_template(examples: Sequence[tuple[Sequence[str], str]]) -> list[tuple[str, object]] | None:
    """Fields and literals that explain all examples, or None.

    All outputs are aligned at once: a state is how far each is spelled. From a state lead the fields of two or more characters
    that all outputs go on with (longer ones first) and the character that all have next; states that lead nowhere are remembered.
    """
    sources, outputs = [[f.strip() for f in s] for s, _ in examples], [o for _, o in examples]
    if not examples or not all(outputs):
        return None
    width = min(map(len, sources))
    order = sorted(range(width), key=lambda i: (-min(len(s[i]) for s in sources), i))
    goal, dead = tuple(map(len, outputs)), set()

    def steps(state: tuple[int, ...]) -> Iterator[tuple[tuple[str, object], tuple[int, ...]]]:
        for i in order:
            if all(len(s[i]) >= 2 and o.startswith(s[i], at) for s, o, at in zip(sources, outputs, state, strict=True)):
                yield ("field", i), tuple(at + len(s[i]) for s, at in zip(sources, state, strict=True))
        following = {o[at:at + 1] for o, at in zip(outputs, state, strict=True)}
        if len(following) == 1 and following != {""}:
            yield ("literal", following.pop()), tuple(at + 1 for at in state)

    path: list[tuple[str, object]] = []
    open_ = [((0,) * len(examples), steps((0,) * len(examples)))]
    while open_:
        state, left = open_[-1]
        if state == goal:
            break
        part, after = next(left, (None, None))
        if part is None:
            dead.add(state)
            open_.pop()
            path = path[:-1]
        elif after not in dead:
            path.append(part)
            open_.append((after, steps(after)))
    if not any(kind == "field" for kind, _ in path):
        return None
    out: list[tuple[str, object]] = []
    for kind, same in itertools.groupby(path, key=lambda p: p[0]):
        out += [("literal", "".join(str(v) for _, v in same))] if kind == "literal" else list(same)
    return out


def flash_fill(template: Sequence[tuple[str, object]], columns: Sequence[str]) -> Column:
    return F.concat(*(F.lit(v) if k == "literal" else F.coalesce(F.trim(F.col(columns[int(v)]).cast("string")), F.lit("")) for k, v in template))


def goal_seek(f: Callable[[float], float], goal: float, start: float, rounds: int = 100, tolerance: float = 0.001) -> float | None:
    """An input for which f is the goal, by the secant method; None if it isn't found."""
    a, b = start, start + (abs(start) * 0.01 or 0.01)
    fa, fb = f(a) - goal, f(b) - goal
    for _ in range(rounds):
        if abs(fa) <= tolerance:
            return a
        if abs(fb) <= tolerance:
            return b
        if fb == fa or not math.isfinite(fb):
            return None
        a, b, fa = b, b - fb * (b - a) / (fb - fa), fb
        fb = f(b) - goal
    return b if abs(fb) <= tolerance else None


def seek_column(df: DataFrame, expr: Callable[[Column], Column], goal: Column, low: float, high: float, rounds: int = 60) -> DataFrame:
    """The input of a growing expression that meets each row's goal, by bisection inside the row; null if no input from low to high does."""
    start = F.struct(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["a"] + acc["b"]) / 2
        up = expr(mid) < goal
        return F.struct(F.when(up, mid).otherwise(acc["a"]).alias("a"), F.when(up, acc["b"]).otherwise(mid).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: (acc["a"] + acc["b"]) / 2)
    return df.withColumn("input", F.when(goal.between(expr(F.lit(float(low))), expr(F.lit(float(high)))), found))


def data_table(spark: SparkSession, rows: Sequence[float], columns: Sequence[float], expr: Callable[[Column, Column], Column]) -> DataFrame:
    """(row, column, value): a formula with two inputs put in turn; the inputs are listed, so the grid is theirs."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, map(float, rows)))).alias("row")).select("row", F.explode(F.array(*map(F.lit, map(float, columns)))).alias("column"))
    return grid.select("row", "column", expr(F.col("row"), F.col("column")).alias("value"))


def charts_for(categories: int, series: int, dates: bool, negatives: bool, numeric_x: bool) -> list[str]:
    """Kinds of chart for a data shape, the best first, five at most."""
    out: list[str] = []
    if numeric_x and series >= 1:
        out.append("scatter")
    if dates:
        out += ["line", "area"]
    if categories <= 8 and series == 1 and not negatives:
        out.append("pie")
    out += ["column", "bar"]
    if series > 1:
        out.append("stackedColumn")
    out.append("line")
    return list(dict.fromkeys(out))[:5]


def chart_shape(df: DataFrame, category: str, values: Sequence[str]) -> DataFrame:
    """One row of what the choice of a chart needs."""
    return df.agg(F.count_distinct(category).alias("categories"), F.lit(len(values)).alias("series"), F.bool_or(sum(((F.col(v) < 0).cast("int") for v in values), F.lit(0)) > 0).alias("negatives"))


def chart_rows(pivot: DataFrame, depth: str, leaf: int, order: str, most: int = 500) -> DataFrame:
    """Data rows of a pivot without its totals."""
    return pivot.where(F.col(depth) == leaf).orderBy(order).limit(most)


def sparklines(df: DataFrame, group: str, order: str, value: str, most: int) -> DataFrame:
    """(group, points): one value for each of `most` buckets of the order, so a point list is bounded whatever the group's size."""
    span = df.groupBy(group).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    at = F.least(F.lit(most - 1), F.floor((F.col(order) - F.col("_lo")) * most / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))))
    cells = df.join(span, group).groupBy(group, at.cast("int").alias("_at")).agg(F.sum(value).alias("_v"))
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("points"))


def spill(columns: Mapping[str, Sequence[object]], spark: SparkSession) -> DataFrame:
    """A table-valued function's result as rows."""
    return spark.range(1).select(F.inline(F.arrays_zip(*(F.array(*map(F.lit, v)).alias(k) for k, v in columns.items()))))
