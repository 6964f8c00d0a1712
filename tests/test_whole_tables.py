"""Queries over all rows, where SQL has no form or only one for a part of them, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tabulon import registry
from tabulon.functions import text as tx

from .test_oracles import SF


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in registry.load(spark, SF, "documents").collect()}


def made(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_fold_all(spark, texts):
    got = {r.doc_id: r.folded for r in made(spark, "b01_fold_text")}
    assert got == {d: t if t is None else tx.fold_text(t) for d, t in texts.items()}
    assert any(t and re.search("[0-9]", t) for t in got.values())


def test_redact_all(spark, texts):
    email, phone = r"(?ai)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"(?a)(?<!\d)\+?\d[\d ()-]{7,}\d(?!\d)"
    got = {r.doc_id: r.text for r in made(spark, "c23_redact")}
    assert got == {d: t if t is None else re.sub(phone, "[PHONE]", re.sub(email, "[EMAIL]", t)) for d, t in texts.items()}
    assert any("[PHONE]" in (t or "") for t in got.values())


def test_compare_all(spark, texts):
    got = {r.page: r.removed_count for r in made(spark, "m15_page_compare")}
    lines = {d: [x.strip() for x in (t or "").split("\n")] for d, t in texts.items()}
    assert got == {d: sum(map(bool, x)) - bool(x[0]) for d, x in lines.items()}
    assert any(len(set(x)) < len(x) for x in lines.values())


def cut_lines(t):
    out = []
    for x in re.split(r"\r?\n", t):
        x = re.sub(r"\s+", " ", x, flags=re.A).strip(" ")
        if len(x) <= 200:
            out += [x] if x else []
        else:
            for y in re.split(r"(?<=[.!?;])\s+", x, flags=re.A):
                out += [y[i:i + 400] for i in range(0, len(y), 400)]
    return out


def test_split_all(spark, texts):
    got = sorted((r.doc_id, r.pos, r.line) for r in made(spark, "c04_split_lines_all"))
    assert got == sorted((d, i, x) for d, t in texts.items() if t is not None for i, x in enumerate(cut_lines(t)))
    assert any(len(x) > 200 for t in texts.values() for x in (t or "").split("\n"))
    long = spark.createDataFrame([(f"{'a' * 150}. {'b' * 950}! c\n d ",)], "t string").select(tx.split_lines(F.col("t"))).first()[0]
    assert [len(x) for x in long] == [151, 400, 400, 151, 1, 1]


def test_rows_in_ranges_meet_each_different_range_once(spark):
    """Repeated, empty, wide and null ranges, and rows without a range, against all pairs; what all have that share a range is joined by the range last."""
    from tabulon.operators import relations

    points = [(i, float(x)) for i, x in enumerate([0, 1, 9.99, 10, 10, 25, 49.5, 50, 51, 99, 100, -3, 1000])] + [(90, None)]
    ranges = [(i, lo, hi) for i, (lo, hi) in enumerate([(0.0, 10.0), (0.0, 10.0), (10.0, 60.0), (49.5, 50.0), (-5.0, 0.0), (20.0, 20.0), (30.0, 5.0), (None, 9.0), (10.0, 60.0)])]
    df, cut = spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(ranges, "r long, low double, high double")
    got = relations.in_ranges(df, "x", cut, "low", "high", 7.0)
    assert got.columns == ["p", "x", "r", "low", "high"]
    assert sorted((r.p, r.r) for r in got.collect()) == sorted((p, r) for p, x in points for r, lo, hi in ranges if None not in (x, lo, hi) and lo <= x < hi)
    plan = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x or "Aggregate" in x]
    assert len(plan) == 3 and "_low" in plan[0] and "_cell" in plan[1] and "Aggregate [_low" in plan[2]
