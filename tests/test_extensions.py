"""Distributions against tables and integrals, formula calls, functions of SQL text, spilling functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import distributions as ds
from tabulon.functions import formulas, spilling

#: Values of published tables and closed forms.
TABLE = [
    ("NORM.DIST", (1.96, 0, 1), 0.9750021048517795), ("NORM.DIST", (-8, 0, 1), 6.220960574271785e-16), ("NORM.INV", (0.975, 0, 1), 1.959963984540054), ("NORM.INV", (0.5, 3, 2), 3.0), ("NORM.PDF", (0, 0, 1), 0.3989422804014327),
    ("T.INV.2T", (0.05, 10), 2.2281388519649385), ("T.DIST", (0, 7), 0.5), ("T.DIST.2T", (2.2281388519649385, 10), 0.05), ("T.DIST.RT", (1, 1), 0.25), ("T.INV", (0.75, 1), 1.0),
    ("CHISQ.INV", (0.95, 3), 7.814727903251179), ("CHISQ.DIST.RT", (7.814727903251179, 3), 0.05), ("CHISQ.INV.RT", (0.05, 3), 7.814727903251179), ("CHISQ.DIST", (2, 2), 1 - math.exp(-1)),
    ("F.INV", (0.95, 2, 10), 4.102821015303716), ("F.DIST.RT", (4.102821015303716, 2, 10), 0.05), ("F.INV.RT", (0.05, 2, 10), 4.102821015303716), ("F.DIST", (1, 2, 2), 0.5),
    ("BETA.DIST", (0.5, 2, 3), 0.6875), ("BETA.INV", (0.6875, 2, 3), 0.5), ("BETA.PDF", (0.5, 2, 3), 1.5), ("GAMMA.DIST", (2, 3, 1), 1 - 5 * math.exp(-2)), ("GAMMA.INV", (1 - 5 * math.exp(-2), 3, 1), 2.0), ("GAMMA.PDF", (2, 3, 1), 2 * math.exp(-2)),
    ("BINOM.DIST", (3, 10, 0.5), 0.171875), ("BINOM.PMF", (3, 10, 0.5), 0.1171875), ("BINOM.DIST", (10, 10, 0.5), 1.0), ("BINOM.DIST", (0, 10, 0.5), 2**-10), ("BINOM.INV", (10, 0.5, 0.171875), 3.0), ("BINOM.INV", (6, 0.5, 0.75), 4.0),
    ("POISSON.DIST", (2, 3), math.exp(-3) * 8.5), ("POISSON.PMF", (2, 3), math.exp(-3) * 4.5), ("WEIBULL.DIST", (105, 20, 100), 0.9295813900692769), ("WEIBULL.PDF", (105, 20, 100), 0.035588864025), ("EXPON.DIST", (0.2, 10), 1 - math.exp(-2)),
    ("LOGNORM.DIST", (4, 3.5, 1.2), 0.0390835557068005), ("LOGNORM.INV", (0.0390835557068005, 3.5, 1.2), 4.0), ("NEGBINOM.DIST", (10, 5, 0.25), 0.3135140584781766), ("HYPGEOM.PMF", (1, 4, 8, 20), 0.3632610939112487),
    ("GAMMALN", (4,), math.log(6)), ("ERF", (0.745,), math.erf(0.745)), ("ERFC", (3,), math.erfc(3)), ("ERFC", (-1,), math.erfc(-1)), ("CONFIDENCE.NORM", (0.05, 2.5, 50), 0.692951912174839), ("CONFIDENCE.T", (0.05, 1, 50), 0.284196855),
]


@pytest.mark.parametrize(("name", "arguments", "want"), TABLE)
def test_distributions_of_tables(name, arguments, want):
    assert ds.values(name, *map(np.array, arguments)) == pytest.approx(want, rel=1e-9 if name not in ("CONFIDENCE.T", "WEIBULL.PDF") else 1e-8, abs=1e-15)


def test_distributions_are_the_integrals_of_their_densities():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.uniform(3, 30, 2)
        for cdf, pdf, top in (("GAMMA.DIST", "GAMMA.PDF", a * b * rng.uniform(0.2, 2)), ("WEIBULL.DIST", "WEIBULL.PDF", b * rng.uniform(0.2, 1.5)), ("BETA.DIST", "BETA.PDF", rng.uniform(0.05, 0.95))):
            x = np.linspace(1e-12, top, 20001)
            y = ds.values(pdf, x, a, b)
            simpson = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3
            assert ds.values(cdf, np.array(top), a, b) == pytest.approx(simpson, abs=1e-7)


@pytest.mark.parametrize(("cdf", "inv", "shape"), [("GAMMA.DIST", "GAMMA.INV", (0.3, 50.0)), ("BETA.DIST", "BETA.INV", (0.4, 80.0)), ("CHISQ.DIST", "CHISQ.INV", (3.0,)), ("T.DIST", "T.INV", (2.5,)), ("F.DIST", "F.INV", (3.0, 200.0)),
                                                   ("CHISQ.DIST.RT", "CHISQ.INV.RT", (400.0,)), ("F.DIST.RT", "F.INV.RT", (1.0, 1.0)), ("NORM.DIST", "NORM.INV", (5.0, 0.01)), ("LOGNORM.DIST", "LOGNORM.INV", (0.0, 2.0))])
def test_inverses(cdf, inv, shape):
    p = np.concatenate([[1e-12, 1e-6], np.linspace(0.001, 0.999, 200), [1 - 1e-9]])
    assert np.allclose(ds.values(cdf, ds.values(inv, p, *shape), *shape), p, rtol=1e-9, atol=1e-13)


def test_distributions_over_columns(spark):
    rows = spark.createDataFrame([(0.5, 2.0), (None, 2.0), (float("nan"), 2.0), (1.5, 2.0), (0.5, -1.0), (0.5, None)], "p double, a double")
    assert [r[0] for r in rows.select(F.round(ds.distribution("BETA.INV", F.col("p"), F.col("a"), 2), 9)).collect()] == [0.5, None, None, None, None, None]
    with pytest.raises(ValueError):
        ds.distribution("NOPE", 1)
    with pytest.raises(ValueError):
        ds.distribution("T.INV", 1)


FORMULAS = [
    ("=SUM(A1:A3)", ["SUM"]), ("=sum (A1)+Sum(B1)", ["SUM"]), ("=LOG10(A1)+Sheet1!B2", ["LOG10"]), ('="SUM(A1)"&LEN("a""MAX(")', ["LEN"]), ("='SUM(1)'!A1+MIN(1)", ["MIN"]), ("='it''s SUM('!A1", []),
    ("=[Book(1)]Sheet!A1+ABS(1)", ["ABS"]), ("=T[[#All],[SUM(x)]]+MAX(T[a])", ["MAX"]), ("=T['[MIN(1)]+ABS(2)", ["ABS"]), ("=1E5(2)+2.5E-3", []), ("=_xlfn.XLOOKUP(1,A:A,B:B)", ["XLOOKUP"]), ("=_xlfn._xlws.SORT(FILTER(A:A,1))", ["SORT", "FILTER"]),
    ("=MY_NAME+name.x\n(1)", ["NAME.X"]), ("=SUM", []), ("", []), (None, None), ('="open SUM(', []), ("=ÉTÉ(1)", ["ÉTÉ"]), ("=A1(2)", ["A1"]), ("=IF(A1,IFS(B1,1),SWITCH(1,2,LET(x,1,x)))", ["IF", "IFS", "SWITCH", "LET"]), ("=[open SUM(1)", []),
]


def test_called_functions(spark):
    rows = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(FORMULAS)], "i int, f string")
    got = {r.i: r.n for r in rows.select("i", formulas.function_names(F.col("f")).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(FORMULAS)}
    long = spark.createDataFrame([("=" + "+".join(f"SUM(A{i})" for i in range(20_000)) + '&"' + "x(" * 20_000 + '"',)], "f string")
    assert long.select(formulas.function_names(F.col("f"))).first()[0] == ["SUM"]
    more = rows.select(formulas.spills(F.col("f")).alias("s"), formulas.unsupported(F.col("f"), ["SUM", "LET"]).alias("u")).collect()
    assert [i for i, r in enumerate(more) if r.s] == [11] and more[19].u == ["IF", "IFS", "SWITCH"] and more[0].u == []


def test_functions_of_sql_text(spark):
    names = formulas.register(spark)
    assert formulas.callable_names(spark, [*names, "no_such_function"]) == dict.fromkeys(names, True) | {"no_such_function": False}
    row = spark.sql("SELECT index_fold('Été, LỚP 7') AS a, index_fold(NULL) AS b, index_type('x/y.tar.GZ') AS c, index_reason('File is Encrypted', 'failed') AS d, index_reason(NULL, 'empty') AS e, index_reason('x', 'text-only') AS f, index_reason(NULL, NULL) AS g, sheet_bool(' true ') AS h, sheet_bool('x') AS i").first()
    assert tuple(row) == ("ete lop 7", None, "gz", "password", "no-text", "waiting", "other", True, None)
    formulas.override(spark, "doubled", "x DOUBLE", "DOUBLE", "x * 2")
    old = spark.sql("SELECT doubled(id) AS v FROM range(3)")
    formulas.override(spark, "doubled", "x DOUBLE", "DOUBLE", "x * 20")
    assert [r.v for r in old.collect()] == [0, 2, 4] and spark.sql("SELECT doubled(2D)").first()[0] == 40
    # a body in SQL is part of the plan: no Python runs
    assert "Python" not in old._jdf.queryExecution().executedPlan().toString()


def test_spilling_functions(spark):
    spilling.register(spark)
    rows = spark.createDataFrame([(1, "a,b;c"), (2, None), (3, ""), (4, ",x;;y")], "k int, t string")
    got = spark.sql("SELECT k, s.row, s.col, s.value FROM {r}, LATERAL text_split(t, ',', ';') AS s", r=rows).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (1, 2, 2, None), (3, 1, 1, ""), (4, 1, 1, ""), (4, 1, 2, "x"), (4, 2, 1, ""), (4, 2, 2, None), (4, 3, 1, "y"), (4, 3, 2, None)]))
    left = spark.sql("SELECT k, s.value FROM {r} JOIN LATERAL text_split(t, ',', ';', true) AS s", r=rows).collect()
    assert sorted((r.k, str(r.value)) for r in left) == [(1, "None"), (1, "a"), (1, "b"), (1, "c"), (4, "x"), (4, "y")]
    assert [r.value for r in spark.sql("SELECT value FROM sheet_sequence(4, 10D, -2.5D)").collect()] == [10, 7.5, 5, 2.5] and spark.sql("SELECT * FROM sheet_sequence(2, CAST(NULL AS DOUBLE), 1D)").collect() == []
    spark.range(50).select((F.col("id") % 3).alias("key"), F.col("id").alias("place"), F.when(F.col("id") != 4, F.col("id").cast("double")).alias("value")).repartition(5).createOrReplaceTempView("spilled")
    total = spark.sql("SELECT * FROM sheet_scan(TABLE(spilled) PARTITION BY key ORDER BY place)").collect()
    assert all(r.total == sum(i for i in range(r.place + 1) if i % 3 == r.key and i != 4) for r in total) and len(total) == 50
