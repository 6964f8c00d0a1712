"""CSV in many tasks against the plain parser; exponential smoothing against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import forecast
from tabulon.sources import files


def cells(df):
    return sorted((r.row, list(r.cells), r.sep) for r in df.collect())


CASES = [
    "a,b\n1,2\n", 'a,"x\ny\n\nz",b\r\n"q ""in"" q",,\r\n\r\nlast,"",1\r\n\r\n\r\n', "", "\n\n", "one", '"a\rb",c\r"d",e\rf,g', "﻿a;b;c\n1;2;3\n", "sep=;\na;b,c\n1;\"x\n;y\"\n", 'a,"unclosed\nline two, x', 'a,"b"c,d\n,,\nx,y,z\n,,\n',
]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("size", ["7", "1m"])
def test_small_files(spark, tmp_path, text, size):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        want = cells(files.read_cells(spark, str(path)))
        assert cells(files.read_split(spark, str(path))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_in_many_tasks(spark, tmp_path):
    rng, rows = random.Random(2), []
    for i in range(3000):
        rows.append(",".join(rng.choice([str(i), "", f'"{"x" * rng.randrange(40)}\n""q"",\n{i}"', "été", '"' + "\n" * rng.randrange(30) + '"']) for _ in range(4)))
    path = tmp_path / "big.csv"
    path.write_text("\n".join(["a,b,c,d", *rows]), encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
        got = cells(files.read_split(spark, str(path), ","))
        assert got == cells(files.read_cells(spark, str(path))) and len(got) == 3001
        assert cells(files.read_split(spark, str(path), ",", most_rows=5, most_columns=2)) == [(r, c[:2], s) for r, c, s in got[:5]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_smoothing(y, m, alpha, beta, gamma):
    head = sum(y[:m]) / m
    trend = sum(y[m + i] - y[i] for i in range(m)) / m / m if len(y) >= 2 * m else (y[-1] - y[0]) / max(1, len(y) - 1)
    if m > 1:
        level, s = head - trend * (m + 1) / 2, [y[i] - head - trend * (i - (m - 1) / 2) for i in range(m)]
    else:
        level, s = y[0] - trend, [0.0]
    error = 0.0
    for t, v in enumerate(y):
        gap = v - level - trend - s[t % m]
        error += gap * gap
        level, trend = level + trend + alpha * gap, trend + alpha * beta * gap
        if m > 1:
            s[t % m] += gamma * (1 - alpha) * gap
    return error, level, trend, s


@pytest.mark.parametrize("m", [1, 4])
def test_smoothing_is_that_of_plain_loops(m):
    y = np.random.default_rng(m).normal(size=30).cumsum() + np.tile([5, -3, 1, 0, -3, 2], 5)
    for a, b, g in itertools.product((0.0, 0.3, 1.0), repeat=3):
        error, (level, trend, index) = forecast.smoothed(y, m, *(np.array([p]) for p in (a, b, g)))
        want = plain_smoothing(list(y), m, a, b, g if m > 1 else 0)
        assert np.allclose([error[0], level[0], trend[0], *index[:, 0]], [want[0], want[1], want[2], *want[3]])
    best, least, _ = forecast.fitted(y, m)
    grid = [plain_smoothing(list(y), m, a, b, g)[0] for a, b, g in itertools.product(np.linspace(0, 1, 6), repeat=3)]
    assert least <= min(grid) + 1e-9 and plain_smoothing(list(y), m, *best)[0] == pytest.approx(least)


def test_forecasts_of_exact_series():
    t = np.arange(48)
    season = np.tile([3.0, -1, 4, -6], 12)
    values, rmse, m = forecast.extended(10 + 0.5 * t + season, 8)
    assert m == 4 and rmse < 1e-9 and np.allclose(values, 10 + 0.5 * np.arange(48, 56) + np.tile([3.0, -1, 4, -6], 2))
    values, rmse, m = forecast.extended(7 - 2.0 * t, 3)
    assert m == 1 and np.allclose(values, 7 - 2.0 * np.arange(48, 51))
    assert forecast.extended(np.array([5.0, 5.0]), 2)[0].tolist() == [5, 5] and forecast.season_of(np.random.default_rng(0).normal(size=200)) == 1


def test_forecast_by_group(spark):
    rows = [("a", i, 2.0 * i + [1, -1][i % 2]) for i in range(20) if i != 7] + [("a", 3, 6.0 - 1), ("b", 1, 4.0), ("c", None, 1.0), ("c", 1, None), (None, 1, 1.0), (None, 4, 7.0), ("d", 5, float("nan"))]
    df = spark.createDataFrame(rows, "g string, t int, v double").repartition(4)
    got = {(r.g, r.step): r for r in forecast.forecast_ets(df, "g", F.col("t"), F.col("v"), 2, season=2).collect()}
    assert sorted(k for k in got if k[0]) == [("a", 20), ("a", 21)] and sorted(s for g, s in got if g is None) == [5, 6]
    y = np.interp(np.arange(20), [i for i in range(20) if i != 7], [2.0 * i + [1, -1][i % 2] for i in range(20) if i != 7])
    assert np.allclose([got["a", 20].forecast, got["a", 21].forecast], forecast.extended(y, 2, 2)[0]) and got["a", 20].season == 2
    assert got[None, 5].forecast == pytest.approx(9) and forecast.forecast_ets(df.limit(0), "g", F.col("t"), F.col("v"), 2).collect() == []
    with pytest.raises(Exception, match="longer steps"):
        forecast.forecast_ets(spark.createDataFrame([("a", 0, 1.0), ("a", 100_000, 1.0)], "g string, t int, v double"), "g", F.col("t"), F.col("v"), 1).collect()


def test_registered_forecast(spark):
    from tabulon import registry

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in registry.queries()["f15_forecast_ets"](spark, sf).collect():
        got.setdefault(r.o_orderpriority, []).append((r.step, r.forecast))
    sums = {}
    for r in spark.read.parquet(f"{sf}/orders.parquet").collect():
        sums.setdefault(r.o_orderpriority, {}).setdefault(r.o_orderdate.year * 12 + r.o_orderdate.month, []).append(r.o_totalprice)
    assert set(got) == set(sums)
    for g, months in sums.items():
        t = sorted(months)
        y = np.interp(np.arange(t[0], t[-1] + 1), t, [sum(months[k]) / len(months[k]) for k in t])
        assert np.allclose([v for _, v in sorted(got[g])], forecast.extended(y, 6)[0]) and [s for s, _ in sorted(got[g])] == list(range(t[-1] + 1, t[-1] + 7))
