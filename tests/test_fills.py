"""Series from rows, filled lines, what-if grids, relative base items, visible rows, name words, headings, refused paths."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from tabulon.functions import coerce
from tabulon.functions import text as tx
from tabulon.operators import corpus, filters, generate, pivot, search
from tabulon.sources import files


def test_row_series(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 8.0), (2, 5.0, -2.0, 0.0), (3, 9.0, 2.0, 8.0), (4, None, 1.0, 1.0), (5, -1.0, -3.0, 50.0)], "k int, a double, b double, s double")

    def got(kind, stop=None):
        out = {}
        for r in generate.row_series(df, F.col("a"), F.col("b"), 5, kind, stop).orderBy("k", "i").collect():
            out.setdefault(r.k, []).append(r.value)
        return out

    assert got("linear") == {1: [1, 3, 5, 7, 9], 2: [5, 3, 1, -1, -3], 3: [9, 11, 13, 15, 17], 5: [-1, -4, -7, -10, -13]}
    assert got("linear", F.col("s")) == {1: [1, 3, 5, 7], 2: [5, 3, 1], 3: [9], 5: [-1]}
    # a factor below 0 goes up and down: the first value beyond the stop in the direction of its own move ends the series
    assert got("growth", F.col("s")) == {1: [1, 2, 4, 8], 2: [5], 3: [9], 5: [-1, 3]}
    big = spark.createDataFrame([(1e300, 1e10)], "a double, b double")
    assert [r.value for r in generate.row_series(big, F.col("a"), F.col("b"), 5, "growth").collect()] == [1e300]
    assert generate.row_series(df.limit(0), F.col("a"), F.col("b"), 5).count() == 0
    with pytest.raises(ValueError):
        generate.row_series(df, F.col("a"), F.col("b"), 5, "odd")


def test_row_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 7),), (None,)], "d date")
    rows = generate.row_dates(df, F.col("d"), "weekday", 1, 7).collect()
    for start in (dt.date(2024, 1, 5), dt.date(2024, 1, 7)):
        want, day = [start], start
        while len(want) < 7:
            day += dt.timedelta(1)
            want += [day] if day.weekday() < 5 else []
        assert [r.value for r in sorted((r for r in rows if r.d == start), key=lambda r: r.i)] == want
    assert {r.value for r in rows if r.d is None} == {None}


def _line(values, kind, step, stop, trend):
    """One line in plain Python: {place: filled}."""
    k = next((i for i, v in enumerate(values) if v is None or not math.isfinite(v)), len(values))
    seeds, n = values[:k], len(values)
    if not seeds:
        return {}
    if trend:
        if kind == "growth" and min(seeds) <= 0:
            return dict(enumerate(seeds))
        y = [math.log(v) for v in seeds] if kind == "growth" else seeds
        mi, my = (k - 1) / 2, sum(y) / k
        slope = sum((i - mi) * (v - my) for i, v in enumerate(y)) / sum((i - mi) ** 2 for i in range(k)) if k > 1 else math.log(step) if kind == "growth" else step
        at = [my + slope * (i - mi) for i in range(n)]
        return {i: math.exp(v) if kind == "growth" else v for i, v in enumerate(at)}
    if kind == "autofill":
        gap = seeds[1] - seeds[0] if k > 1 else 1
        return {i: seeds[-1] + (i - k + 1) * gap for i in range(k, n)}
    out, last = {}, seeds[0]
    for i in range(1, n):
        now = last + step if kind == "linear" else last * step
        if stop is not None and (now > stop if now >= last else now < stop):
            break
        out[i] = last = now
    return out


@pytest.mark.parametrize(("kind", "step", "stop", "trend"), [
    ("autofill", 1, None, False), ("linear", 2, None, False), ("linear", 2, 9, False), ("linear", -3, 0, False), ("growth", 2, 20, False), ("growth", -2, 3, False), ("growth", 2, None, False),
    ("linear", 2, None, True), ("growth", 2, None, True)])
def test_fill_lines(spark, kind, step, stop, trend):
    lines = {"a": [1.0, 3.0, None, None, None], "b": [None, 2.0, 3.0], "c": [5.0], "d": [4.0, None, 7.0, 8.0], "e": [2.0, 8.0, 32.0, 1.0], "f": [-1.0, 2.0, float("nan"), 4.0], None: [3.0, float("inf"), None]}
    rows = [(name, i, v, f"x{i}") for name, values in lines.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "line string, place int, v double, i string")
    got = generate.fill_lines(df, "line", "place", "v", kind, step, stop, trend)
    assert got.columns == [*df.columns, "filled", "written"]
    found = got.collect()
    assert len(found) == len(rows)
    for name, values in lines.items():
        want, here = _line(values, kind, step, stop, trend), {r.place: r for r in found if r.line == name}
        assert {i for i, r in here.items() if r.written} == set(want), (name, want, here)
        assert all((r.filled is None) if i not in want else abs(r.filled - want[i]) < 1e-9 for i, r in here.items()), (name, want, here)
    assert generate.fill_lines(df.limit(0), "line", "place", "v", kind, step, stop, trend).count() == 0


def test_fill_lines_refused(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "line string, place int, v double")
    for kind, trend in (("odd", False), ("autofill", True)):
        with pytest.raises(ValueError):
            generate.fill_lines(df, "line", "place", "v", kind, trend=trend)


def test_what_if(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None)], "k int, p double")
    two = generate.what_if(df, {"a": [1, 2], "b": [3]}, lambda a, b: F.col("p") * a + b)
    assert sorted(map(tuple, two.collect()), key=str) == [(1, 10.0, 1.0, 3.0, 13.0), (1, 10.0, 2.0, 3.0, 23.0), (2, None, 1.0, 3.0, None), (2, None, 2.0, 3.0, None)]
    assert [r.value for r in generate.what_if(df.where("k = 1"), {"a": [5]}, lambda a: a * 2).collect()] == [10.0]
    with pytest.raises(ValueError):
        generate.what_if(df, {}, lambda: F.lit(1))


def test_relative_base_items_and_totals(spark):
    df = spark.createDataFrame([("x", 1, 10.0), ("x", 2, 15.0), ("x", 3, 0.0), ("y", 1, 4.0), ("y", 3, None)], "c string, r int, v double")

    def got(mode, **more):
        return {(r.c, r.r): r.o for r in df.select("c", "r", pivot.show_as(df, mode, "v", "r", "c", **more).alias("o")).collect()}

    assert got("difference", base_item=pivot.PREVIOUS) == {("x", 1): None, ("x", 2): 5.0, ("x", 3): -15.0, ("y", 1): None, ("y", 3): None}
    assert got("percentOf", base_item=pivot.NEXT) == {("x", 1): 10 / 15, ("x", 2): None, ("x", 3): None, ("y", 1): None, ("y", 3): None}
    assert got("percentDiff", base_item=pivot.PREVIOUS)[("x", 2)] == 0.5
    assert got("percentOfTotal")[("y", 1)] == 4 / 29
    plan = df.select(pivot.show_as(df, "percentOfTotal", "v", "r", "c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_visible_copy(spark):
    df = spark.range(8).withColumn("h", F.when(F.col("id") != 4, F.col("id") % 2 == 1))
    ids = lambda *a: sorted(r.id for r in filters.visible_copy(df, "id", *a, F.col("h"), ["id"]).collect())
    assert ids((1, 6), (3, 5)) == [1, 2, 4, 6] and ids((1, 6), None) == [1, 2, 3, 4, 5, 6] and ids((0, 7), (0, 7)) == [0, 2, 4, 6]


def test_name_words(spark):
    asked = [("tìm file Mỹ của tôi", ["my"], ["tim", "file", "my", "cua", "toi"]), ("cái bè", ["be"], ["cai", "be"]), ("the THE", [], ["the"]), ("tài liệu Đỏ-12, đỏ", ["do", "12"], ["do", "12"]), ("", [], []), (None, None, None)]
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(asked)], "i int, q string").orderBy("i")
    got = df.select(search.name_words(F.col("q")), search.name_words(F.col("q"), fillers=True)).collect()
    assert [(r[0], r[1]) for r in got] == [(a, b) for _, a, b in asked]


def _heading(line):
    """By its description: short, no stop at the end, and an outline number, a label, a colon or enough capitals."""
    t = line.strip(" ")
    words, letters = t.split(), [c for c in t if c.isalpha()]
    if not 3 <= len(t) <= 100 or len(words) > 14 or t[-1] in ".;,":
        return False
    if t.endswith(":") or re.match(r"(?:\d+(?:\.\d+)*|[ivxlcdmIVXLCDM]+|[A-Za-z])[.)]\s+\S", t) or (len(t) <= 70 and re.match(r"[^:.]{1,40}:\s*[A-Z]", t)):
        return True
    upper, first = sum(c.isupper() for c in letters), sum(w[0].isupper() for w in words)
    return len(letters) >= 3 and (upper >= 0.8 * len(letters) or (len(words) >= 2 and first >= 0.7 * len(words)))


def test_headings(spark):
    lines = ["1.2) Scope of work", "iv. Terms", "b) x", "Title Of This Line Here", "One Two Three four five six seven", "A B c", "Price: High", "price: high", "notes:", "ALL CAPS 12", "ABCDe", "ABCd e", "ab", "", "  ", "Ends With Stop.", "Ends, With, Comma,",
             "Label: " + "X" * 70, "label part: B " + "x" * 60, "W " * 15, "W " * 14, "A" * 100, "A" * 101, "12 34 56", "Ünder Ölig Ä", "x" * 41 + ": Yes", "a.b: Yes", "1. ", "plain text goes on here", "İstanbul Guide"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, None])], "i int, x string").orderBy("i")
    got = df.select(tx.is_heading(F.col("x")), tx.heading_score(F.col("x"))).collect()
    assert [g[0] for g in got] == [*map(_heading, lines), None] and got[-1][1] is None and all(g[1] >= 0 for g in got[:-1])


def test_refused_paths(spark):
    paths = {"a/dist_electron/x": "generated-build-directory", "Win-Unpacked": "generated-build-directory", "a\\app.asar.unpacked\\": "generated-build-directory", "a/dist_electron2/x": None, "x/LICENSE.electron.txt": "generated-build-file",
             "x/LICENSE.electron.txt/y": None, "c:\\a\\~$b.docx": "temporary-file", "a~$b": None, "~$a/b": None, "f.TMP": "temporary-file", "f.tmp/": "temporary-file", ".bak": "temporary-file", "f.tmp.txt": None, "tmp": None}
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(corpus.refusal(F.col("p"))).collect()] == list(paths.values())


def test_magic_counts_whole_bytes(spark):
    made = [(bytes.fromhex("1255044461"), "unknown"), (b"%PDF", "pdf"), (b" " * 1020 + b"%PDF", "pdf"), (b" " * 1021 + b"%PDF", "unknown"), (b"PK\3\4", "zip"), (bytes.fromhex("D0CF11E0A1B11AE1"), "ole2"), (b"", "unknown"), (None, "unknown")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, (b, _) in enumerate(made)], "i int, b binary").orderBy("i")
    assert [r[0] for r in df.select(files.magic(F.col("b"))).collect()] == [k for _, k in made]


def test_natural_order_of_long_numbers(spark):
    names = ["file" + "9" * 21, "file1" + "0" * 21, "file2", "file10", "FILE3", "file" + "0" * 30 + "4", "file1" + "0" * 20 + "1", "file", "12", "a1b2", "a1b10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(coerce.natural_key(F.col("n"))).collect()]
    assert got == ["12", "a1b2", "a1b10", "file", "file2", "FILE3", "file" + "0" * 30 + "4", "file10", "file" + "9" * 21, "file1" + "0" * 21, "file1" + "0" * 20 + "1"]


def test_one_edit_and_freshest(spark):
    words = [("widget", True), ("widgot", True), ("widgots", True), ("idget", False), ("wid", False), ("widgt", False), (None, None)]
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(words)], "i int, w string").orderBy("i")
    assert [r[0] for r in df.select(search.one_edit(F.col("w"), "widgot")).collect()] == [True, True, True, False, False, True, None]
    assert spark.range(1).select(search.one_edit(F.lit("bed"), "red"), search.one_edit(F.lit("red"), "red"), search.one_edit(F.lit("reds"), "red")).first()[:] == (False, True, False)
    rows = spark.createDataFrame([("a", 3, 5), ("a", 2, 5), ("a", 1, 4), ("b", 9, None), ("b", 4, None), ("c", 1, None), ("c", 2, 0)], "n string, id long, t int")
    assert sorted(map(tuple, search.freshest(rows, ["n"], F.col("t"), "id").collect())) == [("a", 2), ("b", 4), ("c", 2)]


def test_goals_out_of_reach(spark):
    df = spark.createDataFrame([(-1.0,), (4.0,), (101.0,), (None,)], "g double")
    got = [r.input for r in generate.seek_column(df, lambda x: x * x, F.col("g"), 0, 10).collect()]
    assert got[0] is None and abs(got[1] - 2) < 1e-9 and got[2:] == [None, None]
