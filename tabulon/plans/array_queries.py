"""Queries of dynamic arrays, lambdas and the mathematics of a sheet, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sheet
from ..operators import arrays
from ..registry import load, query


@query("f12_take_last", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, o_orderkey, o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 25)")
def _(s, d):
    return arrays.take(load(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], -25, 2)


@query("f12_drop", "SELECT place - 3 AS place, p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey DESC) AS place FROM part) WHERE place > 3")
def _(s, d):
    return arrays.drop(load(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), [("p_partkey", False)], 3, -2)


@query("f12_to_column", """WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i, count(*) OVER () AS n FROM part)
SELECT i AS place, p_brand AS value FROM r UNION ALL SELECT n + i, p_type FROM r UNION ALL SELECT 2 * n + i, p_size::VARCHAR FROM r""")
def _(s, d):
    return arrays.to_column(load(s, d, "part"), ["p_partkey"], ["p_brand", "p_type", "p_size"], by_column=True)


@query("f12_wrap_rows", """WITH r AS (SELECT o_orderkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT i // 4 + 1 AS place, coalesce(max(v) FILTER (i % 4 = 0), -1) AS c1, coalesce(max(v) FILTER (i % 4 = 1), -1) AS c2,
  coalesce(max(v) FILTER (i % 4 = 2), -1) AS c3, coalesce(max(v) FILTER (i % 4 = 3), -1) AS c4 FROM r GROUP BY 1""")
def _(s, d):
    return arrays.wrap_rows(load(s, d, "orders"), ["o_orderkey"], "o_orderkey", 4, -1)


@query("f12_vstack", """SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_name AS c1, c_nationkey AS c2, c_mktsegment AS c3 FROM customer
UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name, s_nationkey, '-' FROM supplier""")
def _(s, d):
    c, p = load(s, d, "customer"), load(s, d, "supplier")
    above = c.withColumnRenamed("c_custkey", "k").select("c_name", "c_nationkey", "c_mktsegment", "k")
    below = p.select("s_name", "s_nationkey", F.lit("-").alias("none"), F.col("s_suppkey").alias("k"))
    return arrays.vstack((above, ["k"]), (below, ["k"])).drop("c4")


@query("f12_hstack", """SELECT coalesce(a.place, b.place) AS place, c_name AS c1, c_nationkey AS c2, s_name AS c3
FROM (SELECT *, row_number() OVER (ORDER BY c_name) AS place FROM customer) a FULL JOIN (SELECT *, row_number() OVER (ORDER BY s_name DESC) AS place FROM supplier) b ON a.place = b.place""")
def _(s, d):
    return arrays.hstack((load(s, d, "customer").select("c_name", "c_nationkey"), ["c_name"]), (load(s, d, "supplier").select("s_name"), [("s_name", False)]))


@query("f12_unique_once", """SELECT row_number() OVER (ORDER BY f, l_suppkey, l_quantity) AS place, l_suppkey, l_quantity
FROM (SELECT l_suppkey, l_quantity, min(l_orderkey) AS f, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n = 1""")
def _(s, d):
    return arrays.unique(load(s, d, "lineitem"), ["l_suppkey", "l_quantity"], "l_orderkey", exactly_once=True)


@query("f13_scan", """SELECT vec_id, array_to_string(list_transform(range(1, len(v) + 1), lambda i: list_sum(v[1:i])::BIGINT), ',') AS sums
FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings)""")
def _(s, d):
    whole = F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")))
    return load(s, d, "embeddings").select("vec_id", F.array_join(arrays.scan(whole, F.lit(0).cast("long"), lambda a, x: a + x).cast("array<string>"), ",").alias("sums"))


@query("f13_by_row", "SELECT l_orderkey, l_linenumber, greatest(l_orderkey, l_partkey, l_suppkey) AS most FROM lineitem")
def _(s, d):
    return arrays.by_row(load(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], "most", F.array_max).select("l_orderkey", "l_linenumber", "most")


@query("f13_by_column", "SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) AS name, unnest([max(l_orderkey), max(l_partkey), max(l_suppkey)]) AS value FROM lineitem")
def _(s, d):
    return arrays.by_column(load(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], F.max)


@query("f06_trigonometry", """SELECT p_partkey, round(pi() / 2 - atan(p_size - 25), 9) AS acot, round(1 / sin(p_size), 9) AS csc, round(0.5 * ln((p_size + 2.0) / p_size), 9) AS acoth,
  round(1 / cosh(p_size / 10.0::DOUBLE), 9) AS sech, CASE WHEN p_size <= 12 THEN round(gamma(p_size + 4) / gamma(5) / gamma(p_size)) END AS combina FROM part""")
def _(s, d):
    n = F.col("p_size")
    made = {"acot": sheet.acot(n - 25), "csc": F.csc(n), "acoth": sheet.acoth(n + 1), "sech": 1 / F.cosh(n / 10)}
    return load(s, d, "part").select("p_partkey", *(F.round(c, 9).alias(k) for k, c in made.items()), F.when(n <= 12, sheet.combinations_again(n, F.lit(4))).alias("combina"))


@query("f06_decimal", "SELECT o_orderkey, o_orderkey % 1679616 AS back FROM orders")
def _(s, d):
    key = F.col("o_orderkey") % 1679616
    return load(s, d, "orders").select("o_orderkey", sheet.decimal(sheet.base(key, 36, 4), 36).alias("back"))


@query("f07_shift", "SELECT o_orderkey, o_orderkey * 1024 AS up, o_orderkey // 8 AS down, CASE WHEN o_custkey < 40 THEN o_orderkey & o_custkey END AS some FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    other = F.when(F.col("o_custkey") < 40, F.col("o_custkey")).otherwise(-1)
    return load(s, d, "orders").select("o_orderkey", sheet.bit_shift(k, 10).alias("up"), sheet.bit_shift(k, -3).alias("down"), sheet.bit_and(k, other).alias("some"))
