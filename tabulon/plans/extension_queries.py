"""Queries through functions that are registered at run time, spill over rows, or read formula text; statistical distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions, formulas, spilling
from ..registry import load, query
from .corpus_queries import _ERRORS, _REASONS


@query("x01_index_reason_sql", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'waiting' WHEN o_orderstatus = 'F' AND o_orderkey % 13 IN (0, 11, 12) THEN 'no-text' ELSE coalesce({list(_REASONS)}[o_orderkey % 13 + 1], 'other') END AS reason FROM orders")
def _(s, d):
    """c16 from SQL text."""
    formulas.register(s)
    error = F.get(F.array(*map(F.lit, _ERRORS)), (F.col("o_orderkey") % 13).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "text-only").when(F.col("o_orderstatus") == "F", "empty").otherwise("failed")
    rows = load(s, d, "orders").select("o_orderkey", error.alias("error"), status.alias("status"))
    return s.sql("SELECT o_orderkey, index_reason(error, status) AS reason FROM {rows}", rows=rows)


@query("x01_index_fold_sql", "SELECT n_name, replace(lower(n_name), '_', ' ') || ' cafe ' || n_regionkey || ' ' || n_nationkey AS folded, 'html' AS kind FROM nation")
def _(s, d):
    """b01 and the type of a path from SQL text."""
    formulas.register(s)
    return s.sql("SELECT n_name, index_fold(concat(n_name, ', CAFÉ ', n_regionkey, '/', n_nationkey)) AS folded, index_type(concat('a.b/', n_name, '.x.HTML')) AS kind FROM {nation}", nation=load(s, d, "nation"))


_PMT = "-c_acctbal * 0.01 / (1 - power(1.01, -24))"


@query("x02_override", f"SELECT c_custkey, round(-c_acctbal / 24, 8) AS before, round({_PMT}, 8) AS after FROM customer")
def _(s, d):
    """A payment under one name by two bodies: without interest first, then with it."""
    c = load(s, d, "customer")
    formulas.override(s, "sheet_payment", "value DOUBLE", "DOUBLE", "-value / 24")
    before = s.sql("SELECT c_custkey, c_acctbal, round(sheet_payment(c_acctbal), 8) AS before FROM {c}", c=c)
    formulas.override(s, "sheet_payment", "value DOUBLE", "DOUBLE", "-value * 0.01D / (1 - power(1.01D, -24))")
    return s.sql("SELECT c_custkey, before, round(sheet_payment(c_acctbal), 8) AS after FROM {b}", b=before)


@query("x05_spilled_text", "SELECT o_orderkey, 1 AS \"row\", (i + 1)::INT AS col, string_split(o_orderpriority, '-')[i + 1] AS value FROM orders, unnest(range(len(string_split(o_orderpriority, '-')))) AS u(i)")
def _(s, d):
    """Every priority spills over as many cells as it has parts."""
    spilling.register(s)
    return s.sql("SELECT o_orderkey, t.row, t.col, t.value FROM {o}, LATERAL text_split(o_orderpriority, '-') AS t", o=load(s, d, "orders"))


@query("x05_scan_by_key", "SELECT l_orderkey AS \"key\", l_linenumber::BIGINT AS place, l_quantity AS value, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS total FROM lineitem")
def _(s, d):
    """The running quantity of each order, from a table function that is given the order's lines."""
    spilling.register(s)
    lines = load(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("place"), F.col("l_quantity").alias("value"), "l_partkey", "l_suppkey")
    lines.createOrReplaceTempView("scanned_lines")
    return s.sql("SELECT * FROM sheet_scan(TABLE(scanned_lines) PARTITION BY key ORDER BY (place, l_partkey, l_suppkey))")


#: Formulas with what they call; # stands for a number of the row.
_FORMULAS = (
    ("=SUM(A#:B#)+sum (C1)", ["SUM"]), ('=IF(A1>"MAX(1)",_xlfn._xlws.FILTER(A:A,B:B),1E5)', ["IF", "FILTER"]), ("='My (MIN(1)) ''x'''!A#+LOG10(Sheet1!A1)", ["LOG10"]),
    ("=SUM(Table1[[Col (ABS(1))]:[B'[c]])*ROUND(2.5E3,#)", ["SUM", "ROUND"]), ("A1+B#", []), ('="a ""quoted(1)"" b"&TEXTJOIN(",",TRUE,SORT(UNIQUE(A1:A#)))', ["TEXTJOIN", "SORT", "UNIQUE"]),
)


@query("x06_called_functions", "SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 6 " + " ".join(f"WHEN {i} THEN '{','.join(n)}'" for i, (_, n) in enumerate(_FORMULAS)) + " END AS names, (l_orderkey + l_linenumber) % 6 IN (1, 5) AS spills FROM lineitem")
def _(s, d):
    made = F.get(F.array(*(F.lit(f) for f, _ in _FORMULAS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).cast("int"))
    formula = F.replace(made, F.lit("#"), F.col("l_partkey").cast("string"))
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(formulas.function_names(formula), ",").alias("names"), formulas.spills(formula).alias("spills"))


@query("f02_distributions", """SELECT l_orderkey, l_linenumber, round(1 - exp(-l_quantity / 20), 9) AS chisq, round(0.5 + atan(l_quantity / 25 - 1) / pi(), 9) AS t, round(1 - power(1 - l_discount, 3), 9) AS beta, round(1 - power(1 + 2 * l_quantity / 10, -5), 9) AS f,
    round(1 - exp(-power(l_quantity / 30, 2)), 9) AS weibull, round(1 - exp(-l_quantity / 20) * (1 + l_quantity / 20), 9) AS gamma, round(power(1 - l_discount, 4) + 4 * l_discount * power(1 - l_discount, 3), 9) AS binom,
    round(l_quantity / 25 - 1, 7) AS norm, round(l_quantity, 6) AS chisq_inv, round(tan(pi() * (l_quantity / 60 - 0.5)), 6) AS t_inv, round(30 * sqrt(-ln(1 - l_quantity / 60)), 6) AS gamma_root FROM lineitem""")
def _(s, d):
    """Distributions at parameters where they have a closed form, and inverses that give back what they were made of."""
    D, q, disc = distributions.distribution, F.col("l_quantity"), F.col("l_discount")
    r = lambda c, n=9: F.round(c, n)
    z = q / 25 - 1
    return load(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r(D("CHISQ.DIST", q / 10, 2)).alias("chisq"), r(D("T.DIST", z, 1)).alias("t"), r(D("BETA.DIST", disc, 1, 3)).alias("beta"), r(D("F.DIST", q, 2, 10)).alias("f"),
        r(D("WEIBULL.DIST", q, 2, 30)).alias("weibull"), r(D("GAMMA.DIST", q, 2, 20)).alias("gamma"), r(D("BINOM.DIST", F.lit(1.0), 4, disc)).alias("binom"), r(D("NORM.INV", D("NORM.DIST", z, 0, 1), 0, 1), 7).alias("norm"),
        r(D("CHISQ.INV.RT", D("CHISQ.DIST.RT", q, 5), 5), 6).alias("chisq_inv"), r(D("T.INV", q / 60, 1), 6).alias("t_inv"),
        r(F.sqrt(D("GAMMA.INV", q / 60, 1, 900)), 6).alias("gamma_root"))
