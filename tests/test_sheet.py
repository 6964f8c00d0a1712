"""Small golden tables for the sheet operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.functions import coerce, sheet
from tabulon.operators import filters, generate, ordering, pivot, relations, stats


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("100",), (" 50 ",), ("n/a",), ("",), (None,), ("1d",), ("Infinity",), ("1e999",), (".5",)], "s string")
    assert [r[0] for r in df.select(coerce.to_number(F.col("s"))).collect()] == [100.0, 50.0, None, None, None, None, None, None, 0.5]
    csv = spark.createDataFrame([(x,) for x in (".5", "1.", "1e10", "007", "+1", "1,000", " 1", "1234567890123456", "123456789012345", "-0.5")], "s string")
    assert [r[0] is not None for r in csv.select(coerce.csv_number(F.col("s"))).collect()] == [True, True, True, False, False, False, False, False, True, True]


@pytest.mark.parametrize(("x", "start", "step", "label"), [(0.3, 0.0, 0.1, "0.3-0.4"), (25.0, 0.0, 10.0, "20-30"), (-1.0, 0.0, 10.0, "-10-0"), (100.0, 0.0, 100.0, "100-200")])
def test_range_groups(spark, x, start, step, label):
    assert spark.range(1).select(coerce.bucket_label(F.lit(x), start, step)).first()[0] == label


def test_dates_and_keys(spark):
    row = spark.range(1).select(coerce.serial_date(F.lit(46204.0)), coerce.serial_date(F.lit(1.0)), coerce.text_date(F.lit("2026/7/1 x")), coerce.text_date(F.lit("no")),
                                coerce.date_label(F.lit("2026-07-01").cast("date"), "quarter")).first()
    assert tuple(row) == (dt.date(2026, 7, 1), dt.date(1900, 1, 1), dt.date(2026, 7, 1), None, "Q3")


def test_typed_cells(spark):
    cells = ["1,234", "31.10", "45.3%", "-$45", "$-4.50", "12元", "007", "abc", "-$-45", "1,23"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "s string").select(coerce.typed_cell(F.col("s"))).collect()]
    assert [(g.value, g.format) for g in got] == [(1234.0, "#,##0"), (31.1, "0.00"), (0.453, "0.0%"), (-45.0, '"$"#,##0'), (-4.5, '"$"#,##0.00'), (12.0, '#,##0"元"'), (None, None), (None, None), (None, None), (None, None)]


@pytest.fixture
def grid(spark):
    return spark.createDataFrame([(0, "North", "A", 10.0), (1, "South", "B", 20.0), (2, "North", "B", 5.0), (3, "West", "A", 7.0)], "row_idx int, region string, product string, amount double")


def test_pivot(grid):
    out = pivot.hierarchy(grid, ["region", "product"], {"total": F.sum("amount")}, "row_idx").orderBy("depth", "first_seen")
    assert values(out.where("depth = 1"), "region", "total") == [("North", 15.0), ("South", 20.0), ("West", 7.0)]
    assert values(out.where("depth = 0"), "total") == [(42.0,)]
    top = pivot.keep_members(grid, "region", F.sum("amount"), "top", "row_idx", 1)
    assert values(top, "region") == [("South",)]
    with pytest.raises(ValueError):
        pivot.hierarchy(grid, [], {})


def test_nesting_stays_apart(spark):
    df = spark.createDataFrame([("ab", "c", 1.0), ("a", "bc", 2.0)], "a string, b string, n double")
    assert pivot.hierarchy(df, ["a", "b"], {"n": F.sum("n")}).where("depth = 2").count() == 2


@pytest.mark.parametrize(("formula", "want"), [("=a + b * 2", 8.0), ("-(a) ^ 2", -4.0), ("'My Field' / 0", None), ("A - -b", 5.0)])
def test_calculated(spark, formula, want):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert df.select(pivot.calculated(formula, {"a": F.col("a"), "b": F.col("b"), "My Field": F.col("a")})).first()[0] == want


def test_calculated_errors(spark):
    for bad in ("a +", "nope", "(a", "a b +"):
        with pytest.raises(ValueError):
            pivot.calculated(bad, {"a": F.lit(1)})


def test_statistics(spark):
    df = spark.createDataFrame([(0, "x"), (1, "X"), (2, None), (3, ""), (4, "x")], "i int, s string")
    r = stats.range_stats(df, "s").first()
    assert (r.cells, r.non_empty, r.distinct_count, r.numeric_count) == (5, 3, 2, 0)
    assert values(stats.top_values(df, "s", "i", 1), "value", "n") == [("x", 2)]
    one = spark.createDataFrame([(7.0,)], "v double").agg(*stats.aggregates(F.col("v"))).first()
    assert one.stdDev is None and one["var"] is None and one.stdDevp == 0.0


def test_filters(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "BP000001"), (4, "100"), (5, "abc"), (6, "101")], "i int, v string")
    pick = lambda c: [r.i for r in df.where(c).orderBy("i").collect()]
    assert pick(filters.in_list("v", ["a"])) == [0] and pick(filters.in_list("v", ["a"], True)) == [0, 2]
    assert pick(filters.condition("v", ">", "100")) == [6] and pick(filters.condition("v", "=", "bp0*")) == [3]
    assert pick(filters.custom("v", ("=", "a"), ("=", "?"), "or")) == [0, 1]
    with pytest.raises(NotImplementedError):
        filters.color("red")
    text = spark.createDataFrame([("mail a.b@c.org or +1 (389) 555-5010 now",)], "t string")
    assert text.select(filters.redact(F.col("t"))).first()[0] == "mail [EMAIL] or [PHONE] now"
    assert spark.range(1).select(F.lit("a.b $1").alias("t")).select(filters.replace("t", "A.B", "$0\\")).first()[0] == "$0\\ $1"


def test_sorts(spark):
    df = spark.createDataFrame([(0, "item10"), (1, "3"), (2, "item2"), (3, None), (4, "Item2")], "i int, s string")
    assert [r.i for r in ordering.sort_range(df, "s", "i").collect()] == [1, 2, 4, 0, 3]
    assert [r.i for r in ordering.sort_range(df, "s", "i", False).collect()][-1] == 3
    nums = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, float("inf")), (3, 1.0), (4, None)], "i int, n double")
    assert [r.i for r in ordering.sort_range(nums, "n", "i").collect()] == [3, 1, 0, 2, 4]
    capped = spark.createDataFrame([(i, "d" if i < 4 else "e") for i in range(6)], "i int, g string")
    assert [r.i for r in ordering.cap_per_group(capped, "g", [F.asc("i")], 2, 5).collect()] == [0, 1, 4, 5, 2]


def test_relations(spark):
    df = spark.createDataFrame([(0, "A", 1.0), (1, "a", 1.0), (2, "b", float("nan")), (3, "b", None)], "i int, s string, n double")
    assert sorted(r.i for r in relations.dedupe(df, ["s", "n"], "i").collect()) == [0, 2]
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    up = relations.upsert(base, spark.createDataFrame([(2, "z"), (3, "n")], "k int, v string"), "k")
    assert sorted(map(tuple, up.collect())) == [(1, "x"), (2, "z"), (3, "n")]
    paths = spark.createDataFrame([(1, "a/b/c"), (2, "a/x"), (3, "z")], "id int, p string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {r.id: r.owner for r in relations.longest_prefix(paths, "p", roots, "root", "id").collect()} == {1: "a/b", 2: "a", 3: None}


def test_generators(spark):
    assert [r.value for r in generate.date_series(spark, "2024-01-31", "month", 1, 3).orderBy("i").collect()] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)]
    assert [r.value for r in generate.date_series(spark, "2024-01-05", "weekday", 1, 3).orderBy("i").collect()] == [dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    assert [r.value for r in generate.growth_series(spark, 1, 2, 9, 20).orderBy("i").collect()] == [1, 2, 4, 8, 16]
    assert generate.learn_template([(["Ada", "Lovelace"], "Ada Lovelace"), (["Alan", "Turing"], "Turing Alan")]) is None
    assert generate.learn_template([(["Ada", "Lovelace"], "Lovelace, Ada")]) == [("field", 1), ("literal", ", "), ("field", 0)]
    assert abs(generate.goal_seek(lambda x: x * x, 2.0, 1.0) - 2 ** 0.5) < 0.01
    assert generate.goal_seek(lambda x: 1.0, 2.0, 1.0) is None


def test_sheet_functions(spark):
    assert [sheet.column_label(i) for i in (1, 26, 27, 16384)] == ["A", "Z", "AA", "XFD"] and sheet.parse_range("B3:A1") == (1, 1, 3, 2)
    row = spark.range(1).select(sheet.regex_replace(F.lit("a1b2c3"), r"\d", "X", -1), sheet.regex_replace(F.lit("a1b2c3"), r"\d", "X", 2), sheet.regex_extract(F.lit("k=v"), r"(\w)=(\w)", 2)).first()
    assert tuple(row) == ("a1b2cX", "a1bXc3", ["k", "v"])
    with pytest.raises(ValueError):
        sheet.safe_pattern(r"(a+)+$")
    r = spark.createDataFrame([(48.0, -200.0, 8000.0, 0.0)], "n double, p double, v double, f double").select(sheet.rate("n", "p", "v", "f")).first()[0]
    assert abs(r - 0.0077014725) < 1e-6


@pytest.mark.parametrize(("weekend", "off"), [(1, {5, 6}), (2, {6, 0}), (7, {4, 5}), (11, {6}), (12, {0}), (17, {5}), ("1000001", {0, 6})])
def test_working_days(spark, weekend, off):
    """Against a walk over the calendar, with a holiday on a day off, one given twice and two in a row."""
    holidays = ["1996-01-01", "1996-01-02", "1996-01-02", "1996-01-06", "1996-02-29"]
    held = {dt.date.fromisoformat(x) for x in holidays}
    works = lambda x: x.weekday() not in off and x not in held

    def walk(day, n):
        while n:
            day += dt.timedelta(1 if n > 0 else -1)
            n -= (1 if n > 0 else -1) * works(day)
        return day

    days = [dt.date(1995, 12, 20) + dt.timedelta(i) for i in range(80)]
    ns = (-30, -7, -1, 0, 1, 2, 9, 31)
    df = spark.createDataFrame([(x, n) for x in days for n in ns], "day date, n int")
    end = F.date_add("day", F.col("n"))
    got = df.select("day", "n", sheet.workday_intl(F.col("day"), F.col("n"), weekend, holidays), sheet.network_days_intl(F.col("day"), end, weekend, holidays)).collect()
    for day, n, moved, count in got:
        assert moved == walk(day, n), (day, n)
        between = sum(works(min(day, day + dt.timedelta(n)) + dt.timedelta(i)) for i in range(abs(n) + 1))
        assert count == (-between if n < 0 else between), (day, n)


def test_working_days_edges(spark):
    none = F.lit(None).cast("date")
    old = F.lit("1899-12-29").cast("date")  # before the days are counted from
    assert tuple(spark.range(1).select(sheet.network_days_intl(none, old), sheet.workday_intl(none, 3), sheet.network_days_intl(old, old, "1111111"), sheet.workday_intl(old, 1)).first()) == (None, None, 0, dt.date(1900, 1, 1))
    for bad in (0, 8, 10, 18, "11111"):
        with pytest.raises(ValueError):
            sheet.network_days_intl(old, old, bad)
    with pytest.raises(ValueError):
        sheet.workday_intl(old, 1, "1111111")


def test_number_value_and_split(spark):
    texts = ["2.500,27", "3,5%", "", "  ", "1,2,3", "1,5.0", "9%%", "-1.000", "x", "1 2", None, "1e2"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in df.select(sheet.number_value(F.col("t"), ",", ".")).collect()]
    assert [x if x is None else round(x, 9) for x in got] == [2500.27, 0.035, 0.0, 0.0, None, None, 0.0009, -1000.0, None, 12.0, None, 100.0]
    row = spark.range(1).select(sheet.text_split(F.lit("a.b--c-."), [".", "--", "-"]), sheet.text_split(F.lit("a.b--c-."), [".", "-"], True), sheet.text_split(F.lit(""), ["."])).first()
    assert tuple(row) == (["a", "b", "c", "", ""], ["a", "b", "c"], [""])


def test_modes_and_choice(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2), ("a", 2), ("a", 1), ("a", 1), ("b", 1), ("b", None), ("b", None)], "g string, v int")
    assert sorted(values(sheet.modes(df, "v", ["g"]), "g", "mode"), key=str) == [("a", 1), (None, 1)]
    assert sorted(values(sheet.modes(df, "v", ["g"], multiple=True), "g", "mode"), key=str) == [("a", 1), ("a", 2), (None, 1)]
    assert values(sheet.modes(df, "v"), "mode") == [(1,)]
    assert sheet.modes(df.limit(0), "v", multiple=True).count() == 0
    assert sheet.choose_columns(df, [-1, 1, 2]).columns == ["v", "g", "v_2"]
    for bad in ([0], [3], [-3]):
        with pytest.raises(ValueError):
            sheet.choose_columns(df, bad)
    three = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert sorted(values(sheet.choose_rows(three, ["k"], [-1, 1, -1]), "place", "k")) == [(1, 3), (2, 1), (3, 3)]


def test_show_as_requirements(grid):
    for mode, more in (("runTotal", {"row": None}), ("difference", {"row": "r"}), ("percentOfParent", {"row": "r", "row_parents": ["p"]}), ("percentOfParent", {"row": "r", "base_field": "x"})):
        with pytest.raises(ValueError):
            pivot.show_as(grid, mode, "v", **more)
