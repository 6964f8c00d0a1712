"""Queries of joins, set operations and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..operators import relations as r
from ..registry import load, query


@query("j01_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def _(s, d):
    o = load(s, d, "orders").where("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(load(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("j02_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(s, d):
    n = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return load(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("j03_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def _(s, d):
    big = load(s, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return r.missing(load(s, d, "customer").select("c_custkey"), big, "c_custkey")


@query("j04_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return r.having(load(s, d, "customer").select("c_custkey"), load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("j05_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return r.missing(load(s, d, "documents").select("doc_id"), load(s, d, "labels"), "doc_id")


@query("j06_correlated_count", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier")
def _(s, d):
    l = load(s, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return r.counted(load(s, d, "supplier").select("s_suppkey"), l, "s_suppkey")


@query("j08_range_join", "SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_retailprice * 100 AS low, p_retailprice * 100 + 50 AS high FROM part WHERE p_partkey % 7 < 7) ON o_totalprice >= low AND o_totalprice < high")
def _(s, d):
    p = load(s, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 50).alias("high"))
    return r.in_ranges(load(s, d, "orders"), "o_totalprice", p, "low", "high", 50.0).select("o_orderkey", "p_partkey")


@query("j10_candidates_exist", "WITH c AS MATERIALIZED (SELECT doc_id FROM documents WHERE n_chars > 3000) SELECT doc_id FROM c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND quality = 1)")
def _(s, d):
    return r.having(load(s, d, "documents").where("n_chars > 3000").select("doc_id"), load(s, d, "labels").where("quality = 1"), "doc_id")


@query("j11_merge_ranked", "WITH a AS (SELECT c_nationkey, row_number() OVER (ORDER BY sum(c_acctbal) DESC) AS rank FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS c_nationkey, row_number() OVER (ORDER BY sum(s_acctbal) DESC) AS rank FROM supplier GROUP BY 1) SELECT coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey, a.rank AS left_rank, b.rank AS right_rank FROM a FULL JOIN b ON a.c_nationkey = b.c_nationkey")
def _(s, d):
    from pyspark.sql import Window

    def ranked(t, k, v):
        g = load(s, d, t).groupBy(F.col(k).alias("c_nationkey")).agg(F.sum(v).alias("v"))
        return g.select("c_nationkey", F.row_number().over(Window.orderBy(F.desc("v"))).cast("long").alias("rank"))

    return r.merge_ranked(ranked("customer", "c_nationkey", "c_acctbal"), ranked("supplier", "s_nationkey", "s_acctbal"), "c_nationkey")


@query("j12_lookup", "SELECT n_nationkey, (SELECT arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS found FROM nation")
def _(s, d):
    return r.lookup(load(s, d, "nation").select("n_nationkey"), "n_nationkey", load(s, d, "customer"), "c_nationkey", "c_name", "c_custkey")


@query("j12_match_position", "SELECT count(*) AS position FROM nation WHERE n_nationkey <= (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)")
def _(s, d):
    return r.match_position(load(s, d, "nation"), "n_regionkey", "n_nationkey", 3)


_ROOTS = "SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)/', 1) FROM pages"


@query("j13_longest_prefix", f"""WITH roots AS ({_ROOTS}) SELECT page_id, max_by(root, length(root)) AS owner FROM pages JOIN roots ON root <> '' AND (url = root OR starts_with(url, root || '/')) GROUP BY 1""")
def _(s, d):
    p = load(s, d, "pages").select("page_id", "url")
    cut = lambda x: F.regexp_extract("url", x, 1).alias("root")
    roots = p.select(cut("^(https?://[^/]+)")).union(p.select(cut("^(https?://[^/]+/[^/]+)/"))).where("root <> ''")
    return r.longest_prefix(p, "url", roots, "root", "page_id").where("owner IS NOT NULL").select("page_id", "owner")


@query("j14_nearest_parent", f"""WITH roots AS (SELECT root FROM ({_ROOTS}) WHERE root <> '') SELECT a.root AS root, max_by(b.root, length(b.root)) AS parent FROM roots a LEFT JOIN roots b ON starts_with(a.root, b.root || '/') GROUP BY 1""")
def _(s, d):
    p = load(s, d, "pages").select("page_id", "url")
    cut = lambda x: F.regexp_extract("url", x, 1).alias("root")
    roots = p.select(cut("^(https?://[^/]+)")).union(p.select(cut("^(https?://[^/]+/[^/]+)/"))).where("root <> ''").distinct()
    return r.nearest_parent(roots, "root")


@query("u01_union_distinct", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49")
def _(s, d):
    return load(s, d, "orders").where("o_totalprice > 300000").select("o_orderkey").union(load(s, d, "lineitem").where("l_quantity >= 49").select("l_orderkey")).distinct()


@query("u02_dedupe", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text)")
def _(s, d):
    return r.dedupe(load(s, d, "documents"), ["text"], "doc_id").select("doc_id")


@query("u03_merge_groups", """WITH i AS (SELECT c_custkey AS k, c_name AS v, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer WHERE c_acctbal < 6000), e AS (SELECT c_custkey AS k, upper(c_name) AS v, row_number() OVER (ORDER BY c_custkey DESC) AS rank FROM customer WHERE c_acctbal >= 0)
    SELECT coalesce(i.k, e.k) AS k, coalesce(e.v, i.v) AS v, (i.rank IS NULL)::INT AS appended, coalesce(i.rank, e.rank) AS rank FROM i FULL JOIN e ON i.k = e.k""")
def _(s, d):
    c = load(s, d, "customer")
    i = records.numbered(c.where("c_acctbal < 6000").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), ["k"], "rank")
    e = records.numbered(c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v")), [F.desc("k")], "rank")
    return r.merge_groups(i, e, "k", ["v"])


@query("u04_except_by_key", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(s, d):
    return r.missing(load(s, d, "documents").where("lang = 'en'").select("doc_id"), load(s, d, "labels").where("quality = 0").select("doc_id"), "doc_id")


@query("u05_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(s, d):
    c = load(s, d, "customer").select("c_custkey", "c_acctbal")
    return r.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


def _index(s, d):
    docs = load(s, d, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("id"))
    every = load(s, d, "documents")
    sets = every.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.when(F.col("lang") == "de", "retired").otherwise("active").alias("state"))
    chunks = every.select((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("chunk_set_id"), F.col("doc_id").alias("document_id"))
    vectors = load(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("chunk_id"), F.lit("m").alias("space_id"))
    return docs, sets, chunks, vectors


@query("u06_garbage_collection", "SELECT doc_id AS document_id, 'm' AS space_id, count(*) AS completed_chunks FROM embeddings JOIN documents ON vec_id = doc_id * 2 WHERE n_chars > 1000 AND lang <> 'de' GROUP BY 1")
def _(s, d):
    return r.collect_garbage(*_index(s, d))["counts"]


@query("u07_activation", "SELECT l_orderkey AS document_id, l_linenumber AS id, CASE WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 'active' ELSE 'retired' END AS state FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def _(s, d):
    sets = load(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("id"), F.lit("building").alias("state")).distinct()
    return r.activate(sets, sets.groupBy("document_id").agg(F.max("id").alias("id")))


@query("u08_marker_diff", "WITH a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_partkey, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS unknown FROM a FULL JOIN b USING (l_partkey) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def _(s, d):
    l = load(s, d, "lineitem")
    return r.marker_diff(l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'R'"), "l_partkey")


@query("x_as_of_join", "SELECT a.event_id, (SELECT arg_max(value, ts) FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts <= a.ts) AS as_of FROM events a WHERE a.event_type = 'click'")
def _(s, d):
    e = load(s, d, "events")
    return r.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "as_of")
