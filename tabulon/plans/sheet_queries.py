"""Queries of the sheet operators: filters, statistics, pivots, show-values-as, sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import filters, ordering, pivot, records, stats
from ..registry import load, query


@query("a01_value_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')")
def _(s, d):
    return load(s, d, "orders").where(filters.in_list("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("a02_custom_filter", "SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%a%' OR lower(p_type) LIKE 'pro%'")
def _(s, d):
    return load(s, d, "part").where(filters.custom("p_type", ("=", "*A*"), ("=", "pro*"), "or")).select("p_partkey", "p_type")


@query("a03_numeric_compare", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def _(s, d):
    return load(s, d, "customer").where(filters.condition("c_acctbal", ">", "5000")).select("c_custkey", "c_acctbal")


@query("a04_wildcard", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer#00000_1%'")
def _(s, d):
    return load(s, d, "customer").where(filters.wildcard(F.col("c_name"), "Customer#00000?1*")).select("c_custkey", "c_name")


@query("a05_range_condition", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
def _(s, d):
    return load(s, d, "lineitem").where((F.col("l_quantity") >= 10) & (F.col("l_quantity") < 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("a06_visible_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','O') AND o_totalprice > 100000")
def _(s, d):
    return filters.visible(load(s, d, "orders"), [filters.in_list("o_orderstatus", ["F", "O"]), filters.condition("o_totalprice", ">", "100000")]).select("o_orderkey")


@query("a08_filtered_copy", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) IN ('building','machinery')")
def _(s, d):
    return filters.filtered_copy(load(s, d, "customer"), "c_mktsegment", [" BUILDING ", "machinery"], ["c_custkey", "c_mktsegment"])


@query("m20_visible_copy", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_custkey BETWEEN 100 AND 900 AND c_acctbal < 0)")
def _(s, d):
    """All rows are copied but those that the filter over rows 100 to 900 hides."""
    c = load(s, d, "customer")
    return filters.visible_copy(c, "c_custkey", (0, 1 << 62), (100, 900), F.col("c_acctbal") < 0, ["c_custkey", "c_name"])


@query("a09_label_filter", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE 'nation_1%' OR contains(lower(n_name), '2')")
def _(s, d):
    return load(s, d, "nation").where(filters.label("n_name", "beginsWith", "Nation_1") | filters.label("n_name", "contains", "2")).select("n_nationkey", "n_name")


@query("a10_slicer", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F','P') GROUP BY 1")
def _(s, d):
    return filters.slicer(load(s, d, "orders"), "o_orderstatus", ["F", "P"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a11_timeline", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate)*12+month(o_orderdate)-1 BETWEEN 1995*12+2 AND 1996*12+4")
def _(s, d):
    return load(s, d, "orders").where(filters.timeline("o_orderdate", (1995, 3), (1996, 5))).select("o_orderkey", "o_orderdate")


@query("a12_page_filter", "SELECT l_returnflag, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def _(s, d):
    return filters.page_filter(load(s, d, "lineitem"), "l_linestatus", "O").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("a13_find", """SELECT p_partkey, 'p_name' AS "column", p_name AS value FROM part WHERE contains(lower(p_name), '12')
    UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE contains(lower(p_brand), '12')""")
def _(s, d):
    return filters.find(load(s, d, "part"), ["p_name", "p_brand"], "12").select("p_partkey", "column", "value")


@query("a14_find_replace", "SELECT c_custkey, regexp_replace(c_name, 'customer', 'Client', 'gi') AS c_name FROM customer")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", filters.replace("c_name", "customer", "Client").alias("c_name"))


@query("a15_sparse_scan", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND quality <> 0")
def _(s, d):
    return load(s, d, "labels").where(F.col("quality").isNotNull() & (F.col("quality") != 0)).select("doc_id", "quality")


@query("a16_privacy_projection", "SELECT c_custkey, c_mktsegment FROM customer")
def _(s, d):
    return filters.privacy(load(s, d, "customer"), {"c_custkey": "allow", "c_mktsegment": "redact", "c_acctbal": "statistics-only"})[0]


@query("a16_privacy_statistics", "SELECT count(*) AS cells, count(c_acctbal) AS c_acctbal FROM customer")
def _(s, d):
    return filters.privacy(load(s, d, "customer"), {"c_custkey": "allow", "c_acctbal": "statistics-only"})[1]


@query("a17_browse_index", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'html') OR contains(lower(url), '1')")
def _(s, d):
    p = load(s, d, "pages")
    return p.where(F.contains(F.lower("url"), F.lit("html")) | F.contains(F.lower("url"), F.lit("1"))).select("page_id", "url")


@query("a18_keyset_page", "SELECT page_id, url FROM pages WHERE page_id > 10 AND page_id <= 200 AND starts_with(url, 'http') ORDER BY page_id LIMIT 50")
def _(s, d):
    return filters.browse(load(s, d, "pages"), "url", "http", [], "page_id", 10, 200, 50).select("page_id", "url")


@query("a19_status_column", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'released' WHEN lang = 'en' THEN 'text-only' ELSE 'ready' END AS status FROM documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", F.when(F.col("n_chars") > 5000, "released").when(F.col("lang") == "en", "text-only").otherwise("ready").alias("status"))


@query("a20_top_percent", """SELECT c_custkey, c_acctbal >= (SELECT min(x) FROM (SELECT c_acctbal AS x FROM customer ORDER BY 1 DESC
    LIMIT (SELECT greatest(1, count(*) * 10 // 100) FROM customer))) AS top FROM customer""")
def _(s, d):
    return filters.flag_top(load(s, d, "customer"), "c_acctbal", 10, percent=True).select("c_custkey", "top")


@query("a21_duplicate_key", "SELECT doc_id, count(*) OVER (PARTITION BY upper(text)) > 1 AS duplicate FROM documents")
def _(s, d):
    return filters.flag_duplicates(load(s, d, "documents"), "text").select("doc_id", "duplicate")


@query("a22_validation", "SELECT o_orderkey, CASE WHEN NOT o_totalprice BETWEEN 1000 AND 300000 THEN 'price' ELSE '' END || CASE WHEN NOT o_orderstatus IN ('F','O') THEN '+status' ELSE '' END AS broken FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 300000 AND o_orderstatus IN ('F','O'))")
def _(s, d):
    v = filters.violations(load(s, d, "orders"), {"price": F.col("o_totalprice").between(1000, 300000), "+status": F.col("o_orderstatus").isin("F", "O")})
    return v.select("o_orderkey", F.array_join("broken", "").alias("broken"))


@query("a23_range_stats", """SELECT count(*) AS cells, count(l_extendedprice) AS non_empty, count(DISTINCT l_extendedprice) AS distinct_count, count(l_extendedprice) AS numeric_count,
    round(sum(l_extendedprice), 2) AS sum, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS avg, 0::BIGINT AS withheld FROM lineitem""")
def _(s, d):
    r = stats.range_stats(load(s, d, "lineitem"), "l_extendedprice")
    return r.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round("avg", 6))


@query("a24_top_values", "SELECT p_brand AS value, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def _(s, d):
    return stats.top_values(load(s, d, "part"), "p_brand", "p_partkey", 10)


_P = "ln(1+l_discount)"


@query("a25_pivot_aggregates", """SELECT l_returnflag, round(sum(l_quantity),2) AS sum, count(l_quantity) AS count, round(avg(l_quantity),6) AS average, max(l_quantity) AS max, min(l_quantity) AS min,
    count(l_quantity) AS "countNums", round(stddev_samp(l_quantity),6) AS "stdDev", round(stddev_pop(l_quantity),6) AS "stdDevp", round(var_samp(l_quantity),6) AS "var", round(var_pop(l_quantity),6) AS "varp" FROM lineitem GROUP BY 1""")
def _(s, d):
    names = [n for n in stats.AGGREGATES if n != "product"]
    r = load(s, d, "lineitem").groupBy("l_returnflag").agg(*stats.aggregates(F.col("l_quantity"), names))
    return r.select("l_returnflag", *(F.round(n, 2 if n == "sum" else 6).alias(n) if n in ("sum", "average", "stdDev", "stdDevp", "var", "varp") else n for n in names))


@query("a25_product", "SELECT o_orderstatus, round(ln(product(1 + o_totalprice / 1e12)), 9) AS product FROM orders GROUP BY 1")
def _(s, d):
    return load(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.ln(F.product(1 + F.col("o_totalprice") / 1e12)), 9).alias("product"))


@query("a26_sample_statistics", "SELECT c_nationkey, c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_samp(c_acctbal), 2) AS v FROM customer GROUP BY 1, 2")
def _(s, d):
    return load(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.var_samp("c_acctbal"), 2).alias("v"))


@query("a27_numeric_coercion", "SELECT count(*) AS cells, count(try_cast(trim(substr(p_brand, 7)) AS DOUBLE)) AS numbers, sum(try_cast(trim(substr(p_brand, 7)) AS DOUBLE)) AS total FROM part")
def _(s, d):
    n = coerce.to_number(F.substring("p_brand", 7, 20))
    return load(s, d, "part").agg(F.count("*").alias("cells"), F.count(n).alias("numbers"), F.sum(n).alias("total"))


@query("a28_pivot_group_by", """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, round(avg(l_quantity), 6) AS avg_qty,
    (2 - grouping(l_returnflag) - grouping(l_linestatus))::INT AS depth FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)""")
def _(s, d):
    return pivot.hierarchy(load(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "revenue": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), "n": F.count("*"), "avg_qty": F.round(F.avg("l_quantity"), 6)})


@query("a29_cross_tab", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS value, grouping(l_returnflag)::INT AS row_total, grouping(l_linestatus)::INT AS column_total FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
def _(s, d):
    return pivot.cross_tab(load(s, d, "lineitem"), "l_returnflag", "l_linestatus", F.round(F.sum("l_quantity"), 2))


@query("a29_spread", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS \"F\", count(*) FILTER (o_orderstatus='O') AS \"O\" FROM orders GROUP BY 1")
def _(s, d):
    return pivot.spread(load(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O"], F.count(F.lit(1))).fillna(0)


_REV = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _revenue(s, d):
    supplier = load(s, d, "supplier").join(load(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(s, d, "lineitem").select("l_suppkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")).join(supplier.select("s_suppkey", "n_nationkey", "n_name", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))


@query("a30_subtotals", f"SELECT r_name, n_name, round(sum(l_extendedprice*(1-l_discount)), 2) AS revenue, min(n_nationkey) AS first_seen, (2 - grouping(r_name) - grouping(n_name))::INT AS depth FROM {_REV} GROUP BY ROLLUP(r_name, n_name)")
def _(s, d):
    return pivot.hierarchy(_revenue(s, d), ["r_name", "n_name"], {"revenue": F.round(F.sum("rev"), 2)}, "n_nationkey")


@query("a31_nested_groups", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def _(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("a32_value_filter_top", f"""WITH r AS (SELECT n_name, r_name, l_extendedprice*(1-l_discount) AS rev FROM {_REV}),
    k AS (SELECT n_name FROM r GROUP BY 1 ORDER BY sum(rev) DESC, n_name LIMIT 3) SELECT r_name, n_name, round(sum(rev), 2) AS revenue, (2 - grouping(r_name) - grouping(n_name))::INT AS depth FROM r WHERE n_name IN (SELECT n_name FROM k) GROUP BY ROLLUP(r_name, n_name)""")
def _(s, d):
    kept = pivot.keep_members(_revenue(s, d), "n_name", F.sum("rev"), "top", count=3)
    return pivot.hierarchy(kept, ["r_name", "n_name"], {"revenue": F.round(F.sum("rev"), 2)})


@query("a32_value_filter_between", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) BETWEEN 12 AND 14")
def _(s, d):
    return pivot.keep_members(load(s, d, "orders"), "o_custkey", F.count("*"), "between", low=12, high=14).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("a33_date_group", """SELECT 'Q' || quarter(o_orderdate) AS quarter, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(o_orderdate)] AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def _(s, d):
    day = F.col("o_orderdate")
    return load(s, d, "orders").groupBy(coerce.date_label(day, "quarter").alias("quarter"), coerce.date_label(day, "month").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a34_range_group", """SELECT regexp_replace(printf('%.10f', b), '\\.?0+$', '') || '-' || regexp_replace(printf('%.10f', b + 100), '\\.?0+$', '') AS label, count(*) AS n
    FROM (SELECT floor(p_retailprice / 100.0) * 100.0 AS b FROM part) GROUP BY 1""")
def _(s, d):
    return load(s, d, "part").groupBy(coerce.bucket_label(F.col("p_retailprice"), 0.0, 100.0).alias("label")).agg(F.count("*").alias("n"))


@query("a35_group_pass_through", "SELECT coalesce(try_cast(substr(p_brand, 7) AS DOUBLE)::BIGINT::VARCHAR, p_brand, '') AS label, count(*) AS n FROM part GROUP BY 1")
def _(s, d):
    n = coerce.to_number(F.substring("p_brand", 7, 20)).cast("long").cast("string")
    return load(s, d, "part").groupBy(F.coalesce(n, "p_brand", F.lit("")).alias("label")).agg(F.count("*").alias("n"))


@query("a36_calculated_field", "SELECT l_returnflag, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0) * (1 - 0.1), 6) AS unit FROM lineitem GROUP BY 1")
def _(s, d):
    g = load(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("qty"))
    return g.select("l_returnflag", F.round(pivot.calculated("= Price / 'qty' * (1 - 0.1)", {"price": F.col("price"), "qty": F.col("qty")}), 6).alias("unit"))


@query("a37_formula_parser", "SELECT l_linestatus, round(-(sum(l_tax) + 2) * 3 + power(count(*), 0.5), 4) AS v FROM lineitem GROUP BY 1")
def _(s, d):
    g = load(s, d, "lineitem").groupBy("l_linestatus").agg(F.sum("l_tax").alias("tax"), F.count("*").alias("n"))
    return g.select("l_linestatus", F.round(pivot.calculated("-(TAX + 2) * 3 + n ^ 0.5", {"tax": F.col("tax"), "n": F.col("n")}), 4).alias("v"))


@query("a38_consolidate_positions", """SELECT r, c, round(sum(value), 4) AS value FROM (SELECT l_linenumber AS r, year(l_shipdate)::INT AS c, l_quantity AS value FROM lineitem UNION ALL
    SELECT l_linenumber, year(l_shipdate)::INT, l_tax FROM lineitem) GROUP BY 1, 2""")
def _(s, d):
    l = load(s, d, "lineitem").select(F.col("l_linenumber").alias("r"), F.year("l_shipdate").alias("c"), "l_quantity", "l_tax")
    return stats.consolidate_positions([l.select("r", "c", F.col(v).alias("value")) for v in ("l_quantity", "l_tax")]).withColumn("value", F.round("value", 4))


@query("a39_consolidate_labels", "SELECT c_mktsegment AS label, round(sum(c_acctbal) / count(*), 6) AS value, min(c_custkey) AS first_seen FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1")
def _(s, d):
    return stats.consolidate_labels(load(s, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", "average").withColumn("value", F.round("value", 6))


@query("a40_subtotal", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS value, grouping(o_orderstatus)::BIGINT AS level FROM orders GROUP BY ROLLUP(o_orderstatus)")
def _(s, d):
    return stats.subtotal(load(s, d, "orders"), "o_orderstatus", "o_totalprice", "average").withColumn("value", F.round("value", 4))


@query("a41_status_bar", "SELECT round(avg(c_acctbal), 6) AS average, count(c_acctbal) AS counta, count(c_acctbal) AS count, min(c_acctbal) AS min, max(c_acctbal) AS max, round(sum(c_acctbal), 2) AS sum FROM customer")
def _(s, d):
    return stats.status_bar(load(s, d, "customer"), "c_acctbal").withColumn("average", F.round("average", 6)).withColumn("sum", F.round("sum", 2))


@query("a42_conditional_aggregates", """SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus='F'), 2), 0) AS sumifs, count(*) FILTER (o_orderstatus='F') AS countifs,
    round(avg(o_totalprice) FILTER (o_orderstatus='F'), 6) AS averageifs FROM orders GROUP BY 1""")
def _(s, d):
    c = stats.conditional(stats.criterion(F.col("o_orderstatus"), "f"), F.col("o_totalprice"))
    return load(s, d, "orders").groupBy("o_orderpriority").agg(F.round(c["sumifs"], 2).alias("sumifs"), c["countifs"].alias("countifs"), F.round(c["averageifs"], 6).alias("averageifs"))


@query("a43_ifs_empty_set", "SELECT o_orderpriority, coalesce(min(o_totalprice) FILTER (o_totalprice > 1e12), 0) AS minifs, coalesce(max(o_totalprice) FILTER (o_totalprice > 100000), 0) AS maxifs FROM orders GROUP BY 1")
def _(s, d):
    low, high = stats.conditional(F.col("o_totalprice") > 1e12, F.col("o_totalprice")), stats.conditional(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return load(s, d, "orders").groupBy("o_orderpriority").agg(low["minifs"].cast("double").alias("minifs"), high["maxifs"].cast("double").alias("maxifs"))


@query("a44_percent_of", "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus='O') / sum(o_totalprice), 8) AS share FROM orders GROUP BY 1")
def _(s, d):
    return load(s, d, "orders").groupBy("o_orderpriority").agg(F.round(stats.percent_of(F.col("o_orderstatus") == "O", F.col("o_totalprice")), 8).alias("share"))


@query("a45_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))


@query("a46_withheld", """SELECT count(*) AS cells, count(*) FILTER (c_nationkey >= 5) AS non_empty, count(DISTINCT c_acctbal) FILTER (c_nationkey >= 5) AS distinct_count, count(*) FILTER (c_nationkey >= 5) AS numeric_count,
    round(sum(c_acctbal) FILTER (c_nationkey >= 5), 2) AS sum, min(c_acctbal) FILTER (c_nationkey >= 5) AS min, max(c_acctbal) FILTER (c_nationkey >= 5) AS max, round(avg(c_acctbal) FILTER (c_nationkey >= 5), 6) AS avg, count(*) FILTER (c_nationkey < 5) AS withheld FROM customer""")
def _(s, d):
    r = stats.range_stats(load(s, d, "customer"), "c_acctbal", F.col("c_nationkey") < 5)
    return r.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round("avg", 6))


@query("a47_index_totals", "SELECT count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS bytes, max(doc_id) AS last FROM documents")
def _(s, d):
    return load(s, d, "documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"), F.max("doc_id").alias("last"))


@query("a48_media_counts", "SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (value > 50) AS large FROM events")
def _(s, d):
    return load(s, d, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("value") > 50).alias("large"))


@query("a49_issue_rollup", "SELECT CASE WHEN event_type IN ('click','view') THEN 'seen' ELSE 'other' END AS section, count(*)::BIGINT AS n, bool_or(value > 90) AS retryable FROM events GROUP BY 1")
def _(s, d):
    e = load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("k"), F.bool_or(F.col("value") > 90).alias("r"))
    return stats.rollup_issues(e, "event_type", "k", "r", {"click": "seen", "view": "seen"})


@query("a50_folder_progress", """SELECT source, count(*) AS total, count(*) FILTER (n_chars > 300) AS done, 0::BIGINT AS failed,
    CASE WHEN count(*) FILTER (n_chars > 300) < count(*) THEN least(99, count(*) FILTER (n_chars > 300) * 100 // count(*)) ELSE 100 END::BIGINT AS percent FROM documents GROUP BY 1""")
def _(s, d):
    return stats.progress(load(s, d, "documents"), "source", F.col("n_chars") > 300, F.lit(False))


@query("a51_distinct_documents", "SELECT count(DISTINCT o_custkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def _(s, d):
    l = load(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(s, d, "orders").join(l, "o_orderkey", "left_semi").agg(F.count_distinct("o_custkey").alias("n"))


@query("a52_complete_groups", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS pages FROM (SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = max(t) AND min(l_linenumber) = 1")
def _(s, d):
    l = load(s, d, "lineitem")
    total = l.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("t"))
    return stats.complete_groups(l.join(total, "l_orderkey"), "l_orderkey", "l_linenumber", "t", F.lit(True))


_CELLS = f"SELECT n_name, year(l_shipdate)::INT AS yr, sum(l_extendedprice*(1-l_discount)) AS rev FROM {_REV} GROUP BY 1, 2"


def _cells(s, d):
    return _revenue(s, d).groupBy("n_name", F.year("l_shipdate").alias("yr")).agg(F.sum("rev").alias("rev"))


def _mode(name, mode, sql, row="n_name", column="yr", digits=8, **more):
    @query(name, f"SELECT n_name, yr, {sql} AS v FROM ({_CELLS})")
    def _(s, d):
        cells = _cells(s, d)
        v = pivot.show_as(cells, mode, "rev", row, column, **more)
        return cells.select("n_name", "yr", (v.cast("long") if mode.startswith("rank") else F.round(v, digits)).alias("v"))


_mode("w01_percent_of_total", "percentOfTotal", "round(rev / sum(rev) OVER (), 8)")
_mode("w01_percent_of_row", "percentOfRow", "round(rev / sum(rev) OVER (PARTITION BY n_name), 8)")
_mode("w01_percent_of_col", "percentOfCol", "round(rev / sum(rev) OVER (PARTITION BY yr), 8)")
_mode("w02_percent_of_parent", "percentOfParent", "round(rev / sum(rev) OVER (PARTITION BY yr), 8)")
_mode("w03_difference", "difference", "CASE WHEN yr <> 1995 THEN round(rev - max(CASE WHEN yr = 1995 THEN rev END) OVER (PARTITION BY n_name), 4) END", row="yr", column="n_name", digits=4, base_item=1995)
_mode("w03_percent_diff", "percentDiff", "CASE WHEN yr <> 1995 THEN round((rev - max(CASE WHEN yr = 1995 THEN rev END) OVER (PARTITION BY n_name)) / max(CASE WHEN yr = 1995 THEN rev END) OVER (PARTITION BY n_name), 6) END", row="yr", column="n_name", digits=6, base_item=1995)
_mode("w03_percent_of", "percentOf", "round(rev / max(CASE WHEN yr = 1995 THEN rev END) OVER (PARTITION BY n_name), 6)", row="yr", column="n_name", digits=6, base_item=1995)
_mode("w04_run_total", "runTotal", "round(sum(rev) OVER (PARTITION BY n_name ORDER BY yr ROWS UNBOUNDED PRECEDING), 0)", row="yr", column="n_name", digits=0)
_mode("w04_percent_of_running_total", "percentOfRunningTotal", "round(sum(rev) OVER (PARTITION BY n_name ORDER BY yr ROWS UNBOUNDED PRECEDING) / sum(rev) OVER (PARTITION BY n_name), 8)", row="yr", column="n_name")
_mode("w05_rank_descending", "rankDescending", "rank() OVER (PARTITION BY yr ORDER BY rev DESC)")
_mode("w05_rank_ascending", "rankAscending", "rank() OVER (PARTITION BY yr ORDER BY rev)")
_mode("w06_index", "index", "round(rev * sum(rev) OVER () / (sum(rev) OVER (PARTITION BY n_name) * sum(rev) OVER (PARTITION BY yr)), 6)", digits=6)


_NESTED = f"SELECT r_name, n_name, year(l_shipdate)::INT AS yr, quarter(l_shipdate)::INT AS qtr, sum(l_extendedprice*(1-l_discount)) AS rev FROM {_REV} GROUP BY ALL"


def _parents(name: str, mode: str, within: str, **more):
    @query(name, f"SELECT r_name, n_name, yr, qtr, round(rev / sum(rev) OVER (PARTITION BY {within}), 8) AS v FROM ({_NESTED})")
    def _(s, d):
        cells = _revenue(s, d).groupBy("r_name", "n_name", F.year("l_shipdate").alias("yr"), F.quarter("l_shipdate").alias("qtr")).agg(F.sum("rev").alias("rev"))
        v = pivot.show_as(cells, mode, "rev", "n_name", "qtr", row_parents=["r_name"], column_parents=["yr"], **more)
        return cells.select("r_name", "n_name", "yr", "qtr", F.round(v, 8).alias("v"))


_parents("w02_parent_row_nested", "percentOfParentRow", "r_name, yr, qtr")
_parents("w02_parent_col_nested", "percentOfParentCol", "r_name, n_name, yr")
_parents("w02_parent_row_field", "percentOfParent", "r_name, yr, qtr", base_field="r_name")
_parents("w02_parent_column_field", "percentOfParent", "r_name, n_name, yr", base_field="yr")


def _relative(name: str, mode: str, item: str, sql: str, digits: int):
    @query(name, f"SELECT n_name, yr, round({sql}, {digits}) AS v FROM (SELECT *, {'lag' if item == pivot.PREVIOUS else 'lead'}(rev) OVER (PARTITION BY n_name ORDER BY yr) AS near FROM ({_CELLS}))")
    def _(s, d):
        cells = _cells(s, d)
        return cells.select("n_name", "yr", F.round(pivot.show_as(cells, mode, "rev", "yr", "n_name", base_item=item), digits).alias("v"))


# sums are multiples of 0.0001: with four digits the order of summing makes no difference
_relative("w08_previous_item", "difference", pivot.PREVIOUS, "rev - near", 4)
_relative("w08_next_percent", "percentDiff", pivot.NEXT, "(rev - near) / near", 6)
_relative("w08_previous_share", "percentOf", pivot.PREVIOUS, "rev / near", 6)


@query("w09_linear_fit", f"SELECT n_name, round(regr_slope(rev, yr), 2) AS slope, round(regr_intercept(rev, yr) / 1000, 0) AS intercept FROM ({_CELLS}) GROUP BY 1")
def _(s, d):
    f = ordering.linear_fit(_cells(s, d), "rev", "yr", "n_name")
    return f.select("n_name", F.round("slope", 2).alias("slope"), F.round(F.col("intercept") / 1000, 0).alias("intercept"))


@query("w10_growth_fit", f"SELECT n_name, round(exp(regr_slope(ln(rev), yr - 1992)), 6) AS factor, round(exp(regr_intercept(ln(rev), yr - 1992)), 0) AS start FROM ({_CELLS}) GROUP BY 1")
def _(s, d):
    f = ordering.growth_fit(_cells(s, d).withColumn("x", F.col("yr") - 1992), "rev", "x", "n_name")
    return f.select("n_name", F.round("factor", 6).alias("factor"), F.round("start", 0).alias("start"))


@query("w11_cap_per_group", """WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS nth FROM documents)
    SELECT doc_id, lang, n_chars, nth > 2 AS overflow FROM r ORDER BY (nth > 2)::INT, n_chars DESC, doc_id LIMIT 12""")
def _(s, d):
    return ordering.cap_per_group(load(s, d, "documents").select("doc_id", "lang", "n_chars"), "lang", [F.desc("n_chars"), F.asc("doc_id")], 2, 12)


@query("w12_age_bucket", "SELECT CASE WHEN dd <= 30 THEN 'fresh' WHEN dd > 365 THEN 'archive' ELSE 'recent' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS dd FROM orders) GROUP BY 1")
def _(s, d):
    days = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    return load(s, d, "orders").groupBy(ordering.age_bucket(days).alias("bucket")).agg(F.count("*").alias("n"))


@query("w13_running_budget", "SELECT * FROM (SELECT o_custkey, o_orderkey, sum(o_shippriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS o_shippriority FROM orders)) WHERE used <= 500000")
def _(s, d):
    o = load(s, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("size"))
    return ordering.within_budget(o, "o_custkey", ["o_orderkey"], "size", 500000).select("o_custkey", "o_orderkey", "used")


@query("o01_sort_range", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
def _(s, d):
    c = load(s, d, "customer").select("c_custkey", "c_acctbal")
    return records.numbered(c, ordering.range_keys(c, "c_acctbal", "c_custkey", False), "place")


@query("o02_typed_comparator", "SELECT p_partkey, p_brand, row_number() OVER (ORDER BY try_cast(substr(p_brand, 7) AS DOUBLE) NULLS LAST, lower(p_brand), p_partkey) AS place FROM part")
def _(s, d):
    n = coerce.to_number(F.substring("p_brand", 7, 20))
    tagged = F.struct(F.when(n.isNotNull(), "number").when(F.col("p_brand").isNotNull(), "text").alias("t"), n.alias("n"), F.when(n.isNull(), F.col("p_brand")).alias("s"), F.lit(None).cast("boolean").alias("b"))
    p = load(s, d, "part").select("p_partkey", "p_brand", tagged.alias("v"))
    return records.numbered(p, [*ordering.typed_keys("v"), F.col("p_partkey")], "place").drop("v")


@query("o04_top_scores", "SELECT event_id, value FROM events WHERE NOT isnan(value) AND NOT isinf(value) ORDER BY value DESC, event_id LIMIT 100")
def _(s, d):
    return ordering.top_scores(load(s, d, "events").select("event_id", "value"), "value", "event_id", 100)


@query("o05_pivot_top_n", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 5")
def _(s, d):
    return pivot.keep_members(load(s, d, "part"), "p_brand", F.count("*"), "top", order="p_partkey", count=5).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("o06_multi_key_sort", "SELECT c_custkey, c_mktsegment, c_name, row_number() OVER (ORDER BY lower(c_mktsegment) DESC NULLS LAST, lower(c_name) NULLS LAST, c_custkey) AS place FROM customer")
def _(s, d):
    keys = ordering.multi_keys([("c_mktsegment", False), ("c_name", True)], ["c_mktsegment", "c_name"], "c_custkey")
    return records.numbered(load(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), keys, "place")


@query("o07_index_sort", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents")
def _(s, d):
    return records.numbered(load(s, d, "documents").select("doc_id", "n_chars"), ordering.index_keys("size", False, {"size": "n_chars", "id": "doc_id"}), "place")


@query("o08_queue_order", "SELECT doc_id, CASE WHEN source = 'src3' THEN 4.0::DOUBLE WHEN lang = 'de' THEN 0.0 WHEN lang = 'fr' THEN 0.5 WHEN n_chars <= 500 THEN 1.0 WHEN n_chars <= 5000 THEN 2.0 ELSE 3.0 END AS rank FROM documents")
def _(s, d):
    r = ordering.queue_rank(F.col("lang") == "de", F.col("lang") == "fr", F.col("n_chars"), F.col("source") == "src3", 500, 5000)
    return load(s, d, "documents").select("doc_id", r.alias("rank"))


@query("o09_best_of", "SELECT doc_id, n_chars AS rank FROM documents WHERE lang <> 'en' ORDER BY n_chars, doc_id LIMIT 1")
def _(s, d):
    return ordering.best_of(load(s, d, "documents").withColumn("rank", F.col("n_chars")).withColumn("place", F.col("doc_id")), "rank", "place", "doc_id", F.col("lang") == "en")


@query("o10_upgrade_queue", "SELECT doc_id FROM documents ORDER BY (lang = 'en')::INT DESC, coalesce(n_chars, 0), doc_id LIMIT 50")
def _(s, d):
    return load(s, d, "documents").orderBy((F.col("lang") == "en").cast("int").desc(), F.coalesce("n_chars", F.lit(0)), "doc_id").limit(50).select("doc_id")
