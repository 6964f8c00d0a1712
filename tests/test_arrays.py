"""Dynamic arrays: golden tables with blanks, ties, short ranges and empty ones."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import sheet
from tabulon.operators import arrays


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(3, "c", None), (1, "a", 10), (4, None, 40), (2, "b", 20), (5, "b", 50)], "k int, name string, n int").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_take_and_drop(few):
    assert rows(arrays.take(few, ["k"], 2, 2)) == [(1, 1, "a"), (2, 2, "b")]
    assert rows(arrays.take(few, ["k"], -2, -1)) == [(1, 40), (2, 50)]
    assert arrays.take(few, ["k"], 99).count() == 5 and arrays.take(few.limit(0), ["k"], 3).count() == 0
    assert rows(arrays.drop(few, ["k"], 3, 1)) == [(1, None, 40), (2, "b", 50)]
    assert rows(arrays.drop(few, [("k", False)], -3, -1)) == [(1, 5, "b"), (2, 4, None)]
    assert arrays.drop(few, ["k"], -9).count() == 0


def test_to_column(few):
    some = few.where("k < 4")
    assert rows(arrays.to_column(some, ["k"], ["name", "n"])) == [(1, "a"), (2, "10"), (3, "b"), (4, "20"), (5, "c"), (6, None)]
    assert rows(arrays.to_column(some, ["k"], ["n", "name"], by_column=True, ignore_blank=True)) == [(1, "10"), (2, "20"), (3, "a"), (4, "b"), (5, "c")]


def test_wraps(few):
    assert sorted(map(str, arrays.wrap_rows(few, ["k"], "n", 3, -1).collect())) == sorted(map(str, [_row(1, 10, 20, None), _row(2, 40, 50, -1)]))
    assert sorted(map(str, arrays.wrap_columns(few, ["k"], "n", 3, -1).collect())) == sorted(map(str, [_two(1, 10, 40), _two(2, 20, 50), _two(3, None, -1)]))
    assert arrays.wrap_rows(few.limit(0), ["k"], "n", 3).count() == 0
    for wrong in (lambda: arrays.wrap_rows(few, ["k"], "n", 0), lambda: arrays.wrap_columns(few, ["k"], "n", 0)):
        with pytest.raises(ValueError):
            wrong()


def _row(place, a, b, c):
    from pyspark.sql import Row

    return Row(place=place, c1=a, c2=b, c3=c)


def _two(place, a, b):
    from pyspark.sql import Row

    return Row(place=place, c1=a, c2=b)


def test_stacks(few):
    short = few.where("k > 3").select("n")
    got = {r.place: tuple(r)[1:] for r in arrays.vstack((few.select("k", "n"), ["k"]), (short, ["n"]), pad=-1).collect()}
    assert got == {1: (1, 10), 2: (2, 20), 3: (3, None), 4: (4, 40), 5: (5, 50), 6: (40, -1), 7: (50, -1)}
    got = {r.place: tuple(r)[1:] for r in arrays.hstack((short, ["n"]), (few.select("k", "n"), [("k", False)]), pad=0).collect()}
    assert got == {1: (40, 5, 50), 2: (50, 4, 40), 3: (0, 3, None), 4: (0, 2, 20), 5: (0, 1, 10)}


def test_unique_and_expand(few):
    assert rows(arrays.unique(few, ["name"], "k")) == [(1, "a"), (2, "b"), (3, "c"), (4, None)]
    assert rows(arrays.unique(few, ["name"], "k", exactly_once=True)) == [(1, "a"), (2, "c"), (3, None)]
    got = {r.place: tuple(r)[1:] for r in arrays.expand(few.where("k in (1, 3)").select("k", "n"), ["k"], 3, 3, 7).collect()}
    assert got == {1: (1, 10, 7), 2: (3, None, 7), 3: (7, 7, 7)}
    with pytest.raises(ValueError):
        arrays.expand(few, ["k"], 4, 3)


def test_lambdas(spark, few):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "id int, v array<long>")
    assert rows(df.select("id", arrays.scan(F.col("v"), F.lit(0).cast("long"), lambda a, x: a + x))) == [(1, [1, 3, 6]), (2, []), (3, None)]
    assert rows(arrays.by_row(few.where("k > 3"), ["k", "n"], "top", F.array_max).select("k", "top")) == [(4, 40), (5, 50)]
    assert rows(arrays.by_column(few, ["k", "n"], F.sum)) == [("k", 15), ("n", 120)]


def test_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert round(value(sheet.acot(F.lit(2.0))), 12) == 0.463647609001 and round(value(sheet.acoth(F.lit(6.0))), 12) == 0.168236118311
    assert value(sheet.acoth(F.lit(1.0))) is None
    assert value(sheet.decimal(F.lit("ff"), 16)) == 255 and value(sheet.decimal(F.lit("ZAP"), 36)) == 45745 and value(sheet.decimal(F.lit("12"), 2)) is None
    assert value(sheet.decimal(F.lit("f" * 20), 16)) is None and value(sheet.decimal(F.lit(""), 16)) is None
    assert value(sheet.combinations_again(F.lit(4), F.lit(3))) == 20 and value(sheet.combinations_again(F.lit(0), F.lit(0))) == 1 and value(sheet.combinations_again(F.lit(0), F.lit(2))) == 0
    assert value(sheet.bit_and(F.lit(13), F.lit(25))) == 9 and value(sheet.bit_or(F.lit(23), F.lit(10))) == 31 and value(sheet.bit_xor(F.lit(5), F.lit(3))) == 6
    assert value(sheet.bit_shift(F.lit(4), 2)) == 16 and value(sheet.bit_shift(F.lit(13), -2)) == 3 and value(sheet.bit_shift(F.lit(1), 48)) is None
    assert value(sheet.bit_and(F.lit(-1), F.lit(1))) is None and value(sheet.bit_and(F.lit(1.5), F.lit(1))) is None


def test_choose_rows_from_the_top(few):
    assert rows(sheet.choose_rows(few.select("k"), ["k"], [2, 1, 2])) == [(1, 2), (2, 1), (3, 2)]
    with pytest.raises(ValueError):
        sheet.choose_rows(few, ["k"], [6])
