"""Queries of corpus upkeep and text work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as co
from ..operators import filters, generate, records
from ..functions import sheet
from ..registry import load, query


@query("c02_fingerprint_groups", "SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(strip_accents(lower(text)), '[^\\p{L}]+', '', 'g')) AS first FROM documents WHERE length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) >= 8")
def _(s, d):
    f = load(s, d, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("f")).where("f IS NOT NULL")
    return f.join(f.groupBy("f").agg(F.min("doc_id").alias("first")), "f").select("doc_id", "first")


@query("c04_split_lines", """
WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS line FROM documents),
     p AS (SELECT doc_id, unnest(CASE WHEN length(line) <= 200 THEN [line] ELSE string_split(regexp_replace(line, '([.!?;]) ', '\\1' || chr(1), 'g'), chr(1)) END) AS part FROM l WHERE line <> '')
SELECT doc_id, sum(CASE WHEN length(part) <= 400 THEN 1 ELSE ceil(length(part) / 400.0) END)::BIGINT AS n, sum(length(part))::BIGINT AS chars FROM p WHERE part <> '' GROUP BY 1""")
def _(s, d):
    """Lines of every document, long ones cut: their number and characters."""
    got = load(s, d, "documents").select("doc_id", tx.split_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    return got.select("doc_id", F.size("lines").cast("long").alias("n"), F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("chars"))


@query("c04_split_lines_all")
def _(s, d):
    """Every line of every document, long ones cut; DuckDB has no split after a sign that is kept."""
    each = load(s, d, "documents").select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("pos", "line"))
    return each.withColumn("pos", F.col("pos").cast("long"))


#: Copy signs without look-around, and the words of a name that siblings share.
_COPY = co.COPY.replace("'", "''")
_TELLING = "array_to_string(list_transform(list_filter(list_transform(range(1, len({t}) + 1), lambda i: struct_pack(w := {t}[i], c := coalesce(regexp_matches({t}[i + 1], '^[0-9]'), false))), lambda p: NOT regexp_matches(p.w, '^[0-9]') AND NOT (p.c AND list_contains([" + ", ".join(f"'{c}'" for c in co.COUNTERS) + "], p.w))), lambda p: p.w), ' ')"


@query("c05_family_key", f"""
WITH names AS (SELECT p_partkey, 'Week ' || p_size || '/Lesson ' || (p_partkey % 9) || ' ' || p_name || ' v' || p_size || '.' || 'DOCX' AS path FROM part),
     cut AS (SELECT p_partkey, regexp_extract_all(regexp_replace(lower(split_part(path, '/', 1)), '[^a-z0-9]+', ' ', 'g'), '[a-z]+|[0-9]+') AS a,
                    regexp_extract_all(regexp_replace(regexp_replace(lower(regexp_replace(split_part(path, '/', 2), '[.][^.]+$', '')), '{_COPY}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '[a-z]+|[0-9]+') AS b FROM names)
SELECT p_partkey, {_TELLING.format(t="a")} || '|' || array_to_string(string_split({_TELLING.format(t="b")}, ' ')[1:3], ' ') || '|docx' AS family FROM cut""")
def _(s, d):
    path = F.concat(F.lit("Week "), "p_size", F.lit("/Lesson "), F.col("p_partkey") % 9, F.lit(" "), "p_name", F.lit(" v"), "p_size", F.lit(".DOCX"))
    return load(s, d, "part").select("p_partkey", co.family_key(path).alias("family"))


@query("c06_copy_penalty", "SELECT p_partkey, regexp_matches(lower(p_name), '\\b(old|copy|final|draft)\\b')::INT AS penalty FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", co.copy_penalty(F.col("p_name")).alias("penalty"))


@query("c07_boilerplate_lines", "SELECT source, line, count(*) AS documents FROM (SELECT DISTINCT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def _(s, d):
    return co.repeated_lines(load(s, d, "documents"), "text", "source")


def _lines(s, d):
    docs = load(s, d, "documents")
    return co.line_priorities(docs, "doc_id", "text", "source", co.family_lines(docs, "doc_id", "text", "source"))


@query("c08_line_priorities")
def _(s, d):
    return _lines(s, d).groupBy("doc_id").agg(*(F.count_if(F.col("priority") == p).alias(f"p{p}") for p in (0, 1, 2, 3, 4, 9)))


@query("c08_boilerplate_ratio")
def _(s, d):
    return co.boilerplate_ratio(_lines(s, d), "doc_id").select("doc_id", "chars", "boiler_chars")


@query("c09_skeleton")
def _(s, d):
    return co.skeleton(_lines(s, d), "doc_id")


@query("c10_exact_copies", "SELECT doc_id, f AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents WHERE text IS NOT NULL) WHERE doc_id <> f")
def _(s, d):
    return co.exact_copies(load(s, d, "documents"), "doc_id", "text")


@query("c11_marker_lines")
def _(s, d):
    each = load(s, d, "documents").select("doc_id", F.explode(tx.split_lines(F.col("text"))).alias("line"))
    return each.groupBy("doc_id").agg(F.count_if(tx.is_marker(F.col("line"))).alias("markers"))


@query("c12_headings")
def _(s, d):
    each = load(s, d, "documents").select("doc_id", F.explode(tx.split_lines(F.col("text"))).alias("line"))
    return each.groupBy("doc_id").agg(F.count_if(tx.is_heading(F.col("line"))).alias("headings"))


@query("c13_distinctive", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{4,}|[0-9]{1,3}([.,][0-9]{3})+|[A-Za-z]{1,8}[-/_]?[0-9]{3,}|[0-9]{3,}[-/_]?[A-Za-z]{1,8}|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]+')")
def _(s, d):
    return load(s, d, "documents").where(tx.is_distinctive(F.col("text"))).select("doc_id")


@query("c14_importance", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\b(ring|bolt)\\b') THEN 'high' WHEN regexp_matches(p_name, '\\b(widget)\\b') THEN 'low' ELSE 'normal' END AS level FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", co.importance(tx.fold_ascii(F.col("p_name")), F.lit(""), {"high": ["ring", "bolt"], "low": ["widget"]}).alias("level"))


@query("c15_effective_importance", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END, CASE WHEN n_chars > 3000 THEN 'high' END, 'normal') AS level FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    l = load(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("o"))
    return load(s, d, "documents").join(l, "doc_id", "left").select("doc_id", co.effective_importance(F.col("o"), F.when(F.col("n_chars") > 3000, "high")).alias("level"))


@query("c16_issue_classes", "SELECT event_type, CASE WHEN contains(event_type, 'click') THEN 'seen' WHEN contains(event_type, 'error') THEN 'bad' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    c = co.classify(F.col("event_type"), [("click", "seen"), ("error", "bad")], "other")
    return load(s, d, "events").groupBy("event_type", c.alias("class")).agg(F.count("*").alias("n"))


#: One error for each reason; the first is of none.
_ERRORS = ("Odd", "Local embedding model unavailable", "File is Encrypted", "EBUSY: it is locked", "request timed out", "it exceeds 128 MB", "File changed while it was read",
           "ENOENT: no such file", "Bad zip: end of central directory", "No readable text in this file", "OCR found nothing", "Unsupported or invalid")
_REASONS = ("other", "model", "password", "permission", "timeout", "too-large", "changed", "unavailable", "corrupt", "empty", "no-text", "unsupported")


@query("c16_issue_reasons", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'waiting' WHEN o_orderstatus = 'F' AND o_orderkey % 13 IN (0, 11, 12) THEN 'no-text' ELSE coalesce({list(_REASONS)}[o_orderkey % 13 + 1], 'other') END AS reason FROM orders")
def _(s, d):
    """Orders as documents: pending, empty or failed, with an error of each kind or none."""
    error = F.get(F.array(*map(F.lit, _ERRORS)), (F.col("o_orderkey") % 13).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "empty").otherwise("failed")
    return load(s, d, "orders").select("o_orderkey", co.issue_reason(error, status).alias("reason"))


@query("c19_refused_paths", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'temporary-file' WHEN 1 THEN 'generated-build-directory' WHEN 2 THEN 'generated-build-directory'
    WHEN 3 THEN 'generated-build-file' WHEN 4 THEN 'temporary-file' END AS reason FROM pages""")
def _(s, d):
    ends = ("/~$plan.docx", "/Win-Unpacked/a.txt", "\\dist_electron\\b.tmp", "/LICENSES.chromium.html", "/film.PART", "/LICENSE.txt/")
    path = F.concat("url", F.get(F.array(*map(F.lit, ends)), (F.col("page_id") % 6).cast("int")))
    return load(s, d, "pages").select("page_id", co.refusal(path).alias("reason"))


@query("c17_sensitive_names", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '\\b(red|old)\\b')")
def _(s, d):
    return load(s, d, "part").where(co.has_terms(tx.fold_ascii(F.col("p_name")), ["red", "old"])).select("p_partkey")


@query("c18_junk_paths", "SELECT page_id, (len(list_intersect(string_split(lower(url), '/'), ['node_modules','windows','program files','appdata','cache','temp','tmp','.git','__pycache__','dist','build'])) > 0 OR regexp_matches(lower(url), '\\.(tmp|log|bak|dll|exe|sys|cache|lock)$')) AS junk FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", co.is_junk(F.col("url")).alias("junk"))


@query("c20_media_admission", "SELECT l_orderkey, l_linenumber, least(l_quantity * 8, l_linenumber * 40) >= 64 AND l_partkey % 5 IN (0, 3, 4) AS ok FROM lineitem")
def _(s, d):
    """Lines as pictures of their own sizes, some of them in folders or files that nobody made."""
    paths = ("a/b.png", "C:\\Windows\\b.png", "x/node_modules/y/b.png", "cached/windows.png", "dist-1/b.png")
    path = F.get(F.array(*map(F.lit, paths)), (F.col("l_partkey") % 5).cast("int"))
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", co.media_admitted(F.col("l_quantity") * 8, F.col("l_linenumber") * 40, path).alias("ok"))


@query("c21_retention", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'keep-running' WHEN o_totalprice <= 50000 THEN 'keep-unverified' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') < 30 THEN 'keep-recent' ELSE 'delete' END AS decision FROM orders")
def _(s, d):
    days = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    return load(s, d, "orders").select("o_orderkey", co.retention(F.col("o_orderstatus"), F.col("o_totalprice") > 50000, days, F.col("o_orderstatus") == "P").alias("decision"))


@query("c22_backup_retention", "SELECT o_orderkey, (o_orderdate > TIMESTAMP '1998-08-01' OR (o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey) <= 3)) AS kept FROM orders")
def _(s, d):
    o = load(s, d, "orders").withColumn("v", F.col("o_orderstatus") == "F")
    return co.backups_kept(o, "o_orderdate", F.lit("1998-08-02").cast("timestamp"), "v", "o_custkey", tie="o_orderkey").select("o_orderkey", "kept")


@query("c23_redact", "SELECT doc_id, regexp_replace(regexp_replace(text, '\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[EMAIL]', 'gi'), '(^|[^0-9])\\+?[0-9][0-9 ()-]{7,}[0-9]', '\\1[PHONE]', 'g') AS text FROM documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", filters.redact(F.col("text")).alias("text"))


@query("c24_placeholders", "SELECT c_custkey, list_transform([c_name, c_mktsegment || ' no. (' || c_nationkey || ')'], lambda x: regexp_replace(trim(x), '[^\\p{L}\\p{N} _-]', '', 'g')) AS labels FROM customer")
def _(s, d):
    t = F.concat(F.lit("Dear {{ "), "c_name", F.lit(" }}, {not one} {{"), "c_mktsegment", F.lit(" no. ("), "c_nationkey", F.lit(")}}"))
    return load(s, d, "customer").select("c_custkey", co.placeholders(t).alias("labels"))


@query("c25_redact_spans", """SELECT c_custkey, CASE WHEN c_nationkey % 4 < 2 THEN '[WITHHELD]' || substr(c_name, 6 + c_nationkey % 4)
    ELSE '[WITHHELD]' || substr(c_name, 4, c_nationkey % 4 - 1) || '[WITHHELD]' || substr(c_name, 8) END AS name FROM customer""")
def _(s, d):
    """Two spans: in half of the rows they overlap, in the others one or two characters lie between."""
    k = (F.col("c_nationkey") % 4).cast("int")
    two = F.when(k < 2, F.struct(F.lit(2).alias("s"), (5 + k).alias("e"))).otherwise(F.struct((2 + k).alias("s"), F.lit(7).alias("e")))
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(3).alias("e")), two)
    return load(s, d, "customer").select("c_custkey", co.redact_spans(F.col("c_name"), spans).alias("name"))


@query("c26_profile", "SELECT 'c_name' AS \"column\", count(*) AS cells, count(*) FILTER (c_name IS NULL OR trim(c_name) = '') AS blanks, count(DISTINCT c_name) AS distinct_count, 0::BIGINT AS numeric FROM customer UNION ALL SELECT 'c_nationkey', count(*), 0, count(DISTINCT c_nationkey), count(*) FROM customer")
def _(s, d):
    return co.profile(load(s, d, "customer"), ["c_name", "c_nationkey"])


@query("b42_chunks")
def _(s, d):
    return co.chunk_texts(load(s, d, "documents"), "doc_id", "text")


_A = "[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"


@query("m12_text_stats", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9À-ɏ]+(?:[''-][A-Za-z0-9À-ɏ]+)*'))::BIGINT AS words, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS no_space, length(replace(text, chr(10), ''))::BIGINT AS with_space, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS paragraphs FROM documents")
def _(s, d):
    t = tx.text_stats(F.col("text"))
    return load(s, d, "documents").select("doc_id", t["words"].cast("long").alias("words"), t["chars_no_space"].cast("long").alias("no_space"), t["chars_with_space"].cast("long").alias("with_space"), t["paragraphs"].cast("long").alias("paragraphs"))


@query("m02_record_condition", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) = 'building' AND NOT contains(lower(c_name), '7')")
def _(s, d):
    return load(s, d, "customer").where(records.test("c_mktsegment", "equals", " Building ") & records.test("c_name", "notContains", "7")).select("c_custkey")


@query("m03_condition_chain", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' OR (lower(c_mktsegment) = 'machinery' AND contains(lower(c_name), '12'))")
def _(s, d):
    return load(s, d, "customer").where(records.chain([("", "c_mktsegment", "equals", "BUILDING"), ("or", "c_mktsegment", "equals", "machinery"), ("and", "c_name", "contains", "12")])).select("c_custkey")


@query("m05_exclude_filter_sort", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY lower(c_name) DESC NULLS LAST, c_custkey) AS place FROM customer WHERE c_custkey NOT IN (1, 2, 3) AND lower(c_mktsegment) = 'building'")
def _(s, d):
    from ..operators import ordering

    c = load(s, d, "customer").where(~F.col("c_custkey").isin(1, 2, 3) & records.test("c_mktsegment", "equals", "building"))
    return records.numbered(c.select("c_custkey", "c_name"), ordering.multi_keys([("c_name", False)], ["c_name"], "c_custkey"), "place")


@query("m06_record_range", "SELECT c_custkey, place FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer) WHERE place BETWEEN 100 AND 300")
def _(s, d):
    return records.numbered(load(s, d, "customer").select("c_custkey"), ["c_custkey"], "place").where(records.in_range("place", "range", 300, 100))


@query("m07_template", "SELECT c_custkey, 'Dear ' || c_name || ' (' || c_mktsegment || ')' AS line FROM customer")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", records.template("Dear «c_name» («c_mktsegment»)").alias("line"))


@query("m08_skip_number", "SELECT c_custkey, merge_rec, row_number() OVER (ORDER BY c_custkey) AS merge_seq FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS merge_rec FROM customer) WHERE NOT c_acctbal < 1000")
def _(s, d):
    return records.skip_and_number(load(s, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", F.col("c_acctbal") < 1000).select("c_custkey", "merge_rec", "merge_seq")


@query("m09_next_record", "SELECT (c_custkey // 3 + 1)::BIGINT AS output, list(c_name ORDER BY c_custkey) AS \"values\" FROM customer GROUP BY 1")
def _(s, d):
    c = load(s, d, "customer").select((F.col("c_custkey") + 1).alias("place"), "c_name")
    return records.grouped_output(c, "place", 3, "c_name")


@query("m10_typed_cells", "SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS value, '\"$\"#,##0' AS format FROM orders")
def _(s, d):
    from ..functions.coerce import typed_cell

    t = typed_cell(F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)))
    return load(s, d, "orders").select("o_orderkey", t["value"].alias("value"), t["format"].alias("format"))


@query("m11_bare_number", "SELECT o_orderkey, o_custkey::DOUBLE AS value FROM orders")
def _(s, d):
    from ..functions.coerce import bare_number

    return load(s, d, "orders").select("o_orderkey", bare_number(F.col("o_custkey").cast("string")).alias("value"))


@query("m13_normal_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n FROM documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", F.size(records.normal_lines(F.col("text"))).cast("long").alias("n"))


@query("m15_page_compare", "SELECT doc_id AS page, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) - (trim(string_split(text, chr(10))[1]) <> '')::INT, 0)::BIGINT AS removed_count FROM documents")
def _(s, d):
    docs = load(s, d, "documents")
    return records.compare(docs, docs.withColumn("text", F.substring_index("text", "\n", 1)), "doc_id", "text").select("page", "removed_count")


@query("m19_pick_list", "SELECT min(p_type) AS value FROM part WHERE trim(p_type) <> '' GROUP BY lower(p_type)")
def _(s, d):
    return records.pick_list(load(s, d, "part"), "p_type")


@query("m18_dependents", "SELECT l_orderkey AS cell FROM lineitem WHERE 5 BETWEEN l_linenumber AND l_quantity GROUP BY 1")
def _(s, d):
    e = load(s, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("r1"), F.col("l_quantity").alias("r2"), F.lit(1).alias("c1"), F.lit(2).alias("c2"))
    return records.dependents(e, 5, 2)


@query("f03_percentiles", "SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem")
def _(s, d):
    return load(s, d, "lineitem").agg(sheet.percentile_inc(F.col("l_quantity"), 0.25).alias("q1"), sheet.percentile_inc(F.col("l_extendedprice"), 0.5).alias("q2"), F.round(sheet.percentile_inc(F.col("l_extendedprice"), 0.9), 6).alias("p90"))


@query("f04_rank_average", "SELECT p_partkey, (rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE) AS rank_avg FROM part")
def _(s, d):
    return sheet.rank_avg(load(s, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", F.col("rank_avg").cast("double").alias("rank_avg"))


@query("f05_statistics", "SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(corr(l_quantity, l_extendedprice), 8) AS c FROM lineitem GROUP BY 1")
def _(s, d):
    q, p = "l_quantity", "l_extendedprice"
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.covar_samp(q, p), 2).alias("cs"), F.round(F.covar_pop(q, p), 2).alias("cp"), F.round(F.corr(q, p), 8).alias("c"))


@query("f05_skew", "SELECT l_returnflag, round((avg(q * q * q) - 3 * avg(q) * avg(q * q) + 2 * avg(q) ** 3) / stddev_pop(q) ** 3, 6) AS skew FROM (SELECT l_returnflag, l_quantity::DOUBLE AS q FROM lineitem) GROUP BY 1")
def _(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(sheet.skew_p(F.col("l_quantity")), 6).alias("skew"))


@query("f05_mode_single", "SELECT c_mktsegment, min_by(c_nationkey, {'a': -n, 'b': c_nationkey}) AS mode FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) WHERE n > 1 GROUP BY 1")
def _(s, d):
    return sheet.modes(load(s, d, "customer"), "c_nationkey", ["c_mktsegment"])


@query("f05_mode_multiple", "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_size AS mode FROM c WHERE n > 1 QUALIFY n = max(n) OVER (PARTITION BY p_brand)")
def _(s, d):
    return sheet.modes(load(s, d, "part"), "p_size", ["p_brand"], multiple=True)


@query("f06_math", "SELECT p_partkey, ceil(p_retailprice / 5) * 5 AS up, floor(p_retailprice / 5) * 5 AS down, round(1 / cos(p_size), 6) AS sec, lower(to_base(p_partkey, 16)) AS hex FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", sheet.ceiling_math(F.col("p_retailprice"), 5.0).alias("up"), sheet.floor_math(F.col("p_retailprice"), 5.0).alias("down"), F.round(F.sec("p_size"), 6).alias("sec"), F.lower(sheet.base(F.col("p_partkey"), 16)).alias("hex"))


@query("f07_bits", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 7 AS o, xor(o_orderkey, 85) AS x, o_orderkey << 2 AS l FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    return load(s, d, "orders").select("o_orderkey", k.bitwiseAND(255).alias("a"), k.bitwiseOR(7).alias("o"), k.bitwiseXOR(85).alias("x"), F.shiftleft(k, 2).alias("l"))


@query("f08_dates", "SELECT o_orderkey, (SELECT count(*) FROM (SELECT unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 13, INTERVAL 1 DAY)) AS x) WHERE isodow(x) < 6) AS workdays, week(o_orderdate)::INT AS iso_week FROM orders")
def _(s, d):
    day = F.col("o_orderdate").cast("date")
    return load(s, d, "orders").select("o_orderkey", sheet.network_days(day, F.date_add(day, 13)).alias("workdays"), F.weekofyear("o_orderdate").alias("iso_week"))


_OFF = ("1994-07-04", "1995-12-25", "1996-01-01", "1996-01-02", "1997-05-01", "1997-05-04")
_OFF_SQL = "(" + ", ".join(f"DATE '{x}'" for x in _OFF) + ")"


@query("f08_network_days_intl", f"SELECT o_orderkey, len(list_filter(generate_series(o_orderdate::DATE, o_orderdate::DATE + 45, INTERVAL 1 DAY), lambda x: isodow(x) NOT IN (5, 6) AND x::DATE NOT IN {_OFF_SQL}))::BIGINT AS workdays FROM orders")
def _(s, d):
    """Fridays and Saturdays off (code 7), and holidays."""
    day = F.col("o_orderdate").cast("date")
    return load(s, d, "orders").select("o_orderkey", sheet.network_days_intl(day, F.date_add(day, 45), 7, _OFF).alias("workdays"))


@query("f08_workday_intl", f"""SELECT o_orderkey, (list_filter(generate_series(o_orderdate::DATE + 1, o_orderdate::DATE + 60, INTERVAL 1 DAY), lambda x: isodow(x) NOT IN (3, 7) AND x::DATE NOT IN {_OFF_SQL}))[20]::DATE AS later,
    (list_filter(generate_series(o_orderdate::DATE - 1, o_orderdate::DATE - 60, INTERVAL (-1) DAY), lambda x: isodow(x) NOT IN (3, 7) AND x::DATE NOT IN {_OFF_SQL}))[20]::DATE AS earlier FROM orders""")
def _(s, d):
    """Wednesdays and Sundays off by a mask, and holidays; forwards and backwards."""
    day = F.col("o_orderdate").cast("date")
    return load(s, d, "orders").select("o_orderkey", sheet.workday_intl(day, 20, "0010001", _OFF).alias("later"), sheet.workday_intl(day, -20, "0010001", _OFF).alias("earlier"))


@query("f09_logic", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'A' WHEN o_totalprice > 100000 THEN 'B' ELSE 'C' END AS ifs, (o_orderstatus = 'F') <> (o_totalprice > 100000) AS x FROM orders")
def _(s, d):
    t = F.col("o_totalprice")
    return load(s, d, "orders").select("o_orderkey", F.when(t > 200000, "A").when(t > 100000, "B").otherwise("C").alias("ifs"), ((F.col("o_orderstatus") == "F") != (t > 100000)).alias("x"))


@query("f10_text", "SELECT p_partkey, split_part(p_name, ' ', 1) AS before, substr(p_name, strpos(p_name, ' ') + 1) AS after, p_brand || '|' || p_type AS joined FROM part WHERE contains(p_name, ' ')")
def _(s, d):
    n = F.col("p_name")
    return load(s, d, "part").where(F.contains(n, F.lit(" "))).select("p_partkey", sheet.text_before(n, " ").alias("before"), sheet.text_after(n, " ").alias("after"), F.concat_ws("|", "p_brand", "p_type").alias("joined"))


@query("f10_text_split", "SELECT p_partkey, list_filter(regexp_split_to_array(p_type || '#' || p_brand, '[ #]'), lambda x: x <> '') AS parts FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", sheet.text_split(F.concat("p_type", F.lit("#"), "p_brand"), [" ", "#"], ignore_empty=True).alias("parts"))


@query("f10_number_value", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 1000 + 0.5 WHEN 1 THEN o_orderkey / 100.0 END::DOUBLE AS value FROM orders")
def _(s, d):
    """Points between thousands and a decimal comma, a per cent sign, and a point after the comma, which is no number."""
    k, form = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    text = F.when(form == 0, F.concat(k, F.lit(".000 ,5"))).when(form == 1, F.concat(F.lit(" "), k, F.lit("%"))).otherwise(F.concat(k, F.lit(",5.0")))
    return load(s, d, "orders").select("o_orderkey", sheet.number_value(text, ",", ".").alias("value"))


@query("f12_dynamic_arrays", "SELECT *, row_number() OVER (ORDER BY p_brand NULLS FIRST, p_type NULLS FIRST) AS place FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def _(s, d):
    return records.numbered(load(s, d, "part").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"], "place")


@query("f13_lambdas", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS ss FROM embeddings")
def _(s, d):
    return load(s, d, "embeddings").select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x), 6).alias("ss"))


@query("f14_choose", "WITH r AS (SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_name) AS nth, count(*) OVER () AS n FROM nation) SELECT 1 AS place, n_regionkey, n_name FROM r WHERE nth = 3 UNION ALL SELECT 2, n_regionkey, n_name FROM r WHERE nth = n UNION ALL SELECT 3, n_regionkey, n_name FROM r WHERE nth = 3")
def _(s, d):
    """The third row, the last one and the third again; the last column, then the first."""
    rows = sheet.choose_rows(load(s, d, "nation").select("n_name", "n_nationkey", "n_regionkey"), ["n_name"], [3, -1, 3])
    return rows.select("place", *sheet.choose_columns(rows.drop("place"), [-1, 1]).columns)


@query("f15_forecast_linear", "SELECT n_regionkey, round(regr_intercept(n_nationkey, length(n_name)) + regr_slope(n_nationkey, length(n_name)) * 10, 6) AS v FROM nation GROUP BY 1")
def _(s, d):
    x = F.length("n_name")
    return load(s, d, "nation").groupBy("n_regionkey").agg(F.round(F.regr_intercept(F.col("n_nationkey"), x) + F.regr_slope(F.col("n_nationkey"), x) * 10, 6).alias("v"))


@query("f16_regex_test", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '(?i)brand#1[0-5]$')")
def _(s, d):
    return load(s, d, "part").where(sheet.regex_test(F.col("p_brand"), "BRAND#1[0-5]$", True)).select("p_partkey")


@query("f17_regex_extract", "SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS first, regexp_extract_all(p_name, '[a-z]+') AS every FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", sheet.regex_extract(F.col("p_brand"), "[0-9]+").alias("first"), sheet.regex_extract(F.col("p_name"), "[a-z]+", 1).alias("every"))


@query("f18_regex_replace_nth", "SELECT p_partkey, regexp_replace(p_name, '^([a-z]+ )[a-z]+', '\\1X') AS second FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", sheet.regex_replace(F.col("p_name"), "[a-z]+", "X", 2).alias("second"))


@query("f20_rate")
def _(s, d):
    return load(s, d, "customer").select("c_custkey", F.round(sheet.rate(F.lit(24.0), -(F.col("c_acctbal") / 20), F.col("c_acctbal"), F.lit(0.0)), 8).alias("rate"))


@query("f22_serial_dates", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def _(s, d):
    from ..functions.coerce import serial_date

    n = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return load(s, d, "orders").select("o_orderkey", serial_date(n.cast("double")).alias("day"))


@query("f24_add_months", "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS next FROM orders")
def _(s, d):
    return load(s, d, "orders").select("o_orderkey", sheet.add_months(F.col("o_orderdate").cast("date"), 1).alias("next"))


@query("f27_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("g01_fill_series", """SELECT c_custkey, i::INT AS i, round(c_acctbal + i * (c_nationkey - 12) * 100.0, 4) AS value FROM customer, range(12) AS t(i)
    WHERE i = 0 OR CASE WHEN c_nationkey >= 12 THEN c_acctbal + i * (c_nationkey - 12) * 100.0 <= 5000 ELSE c_acctbal + i * (c_nationkey - 12) * 100.0 >= 5000 END""")
def _(s, d):
    """Every balance goes on in its own steps, up or down, until it passes 5,000."""
    c = generate.row_series(load(s, d, "customer"), F.col("c_acctbal"), (F.col("c_nationkey") - 12) * 100.0, 12, stop=F.lit(5000.0))
    return c.select("c_custkey", "i", F.round("value", 4).alias("value"))


@query("g01_growth_series", """SELECT c_custkey, i::INT AS i, round(c_acctbal * power(1 + c_nationkey / 50.0, i), 4) AS value FROM customer, range(8) AS t(i)
    WHERE i = 0 OR CASE WHEN c_nationkey = 0 OR c_acctbal >= 0 THEN c_acctbal * power(1 + c_nationkey / 50.0, i) <= 9000 ELSE c_acctbal * power(1 + c_nationkey / 50.0, i) >= 9000 END""")
def _(s, d):
    c = generate.row_series(load(s, d, "customer"), F.col("c_acctbal"), 1 + F.col("c_nationkey") / 50.0, 8, "growth", F.lit(9000.0))
    return c.select("c_custkey", "i", F.round("value", 4).alias("value"))


@query("g01_date_series", "SELECT o_orderkey, i::INT AS i, (o_orderdate::DATE + to_months(i::INT))::DATE AS value FROM orders, range(6) AS t(i)")
def _(s, d):
    """Half a year of dates from every order."""
    return generate.row_dates(load(s, d, "orders"), F.col("o_orderdate"), "month", 1, 6).select("o_orderkey", "i", "value")


#: A customer's orders as a line of cells; those whose status is P hold text.
_CELLS = """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders"""
_HEADS = f"c AS ({_CELLS}), h AS (SELECT *, bool_and(v IS NOT NULL) OVER (PARTITION BY o_custkey ORDER BY place) AS head FROM c)"


def _cell_lines(s, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return load(s, d, "orders").select("o_orderkey", "o_custkey", place.alias("place"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))


@query("g02_fill_planner", f"""WITH {_HEADS}, s AS (SELECT o_custkey, count(*) AS k, arg_max(v, place) AS last, coalesce(max(v) FILTER (place = 1) - max(v) FILTER (place = 0), 1) AS gap FROM h WHERE head GROUP BY 1)
    SELECT o_orderkey, CASE WHEN place >= k THEN round(last + (place - k + 1) * gap, 4) END AS filled, coalesce(place >= k, false) AS written FROM h LEFT JOIN s ON h.o_custkey = s.o_custkey""")
def _(s, d):
    """Each customer's orders as a line: the numbers it starts with are the seeds, and what follows is filled."""
    return generate.fill_lines(_cell_lines(s, d), "o_custkey", "place", "v").select("o_orderkey", F.round("filled", 4).alias("filled"), "written")


@query("g02_fill_trend", f"""WITH {_HEADS}, s AS (SELECT o_custkey, coalesce(regr_slope(v, place) FILTER (head), 250) AS slope, avg(v) FILTER (head) AS my, avg(place) FILTER (head) AS mi, max(place) FILTER (head) AS m FROM h GROUP BY 1)
    SELECT o_orderkey, CASE WHEN m >= 0 THEN round(my + CASE WHEN m = 0 THEN 250 ELSE slope END * (place - mi), 6) END AS filled, m IS NOT NULL AS written FROM h JOIN s ON h.o_custkey = s.o_custkey""")
def _(s, d):
    return generate.fill_lines(_cell_lines(s, d), "o_custkey", "place", "v", "linear", step=250, trend=True).select("o_orderkey", F.round("filled", 6).alias("filled"), "written")


@query("g03_tile", "SELECT r_name, range::INT AS tile FROM region, range(3)")
def _(s, d):
    return generate.tile(load(s, d, "region").select("r_name"), "r_name", 3)


@query("g04_flash_fill", "SELECT n_nationkey, n_name || ' / ' || r_name AS filled FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    t = generate.learn_template([(["NATION_3", "ASIA"], "NATION_3 / ASIA"), (["X_1", "EU"], "X_1 / EU")])
    n = load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", generate.flash_fill(t, ["n_name", "r_name"]).alias("filled"))


@query("g05_goal_seek", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 4) END AS input FROM customer")
def _(s, d):
    return generate.seek_column(load(s, d, "customer"), lambda x: x * x, F.col("c_acctbal"), 0, 1000).select("c_custkey", F.round("input", 4).alias("input"))


@query("g06_data_table", """SELECT p_partkey, rate, years, round(p_retailprice * power(1 + rate, years), 6) AS value
    FROM part, (SELECT unnest([0.01::DOUBLE, 0.02, 0.05]) AS rate), (SELECT unnest([1.0::DOUBLE, 5, 10]) AS years)""")
def _(s, d):
    """Every part's price under each pair of a rate and a number of years."""
    grid = generate.what_if(load(s, d, "part"), {"rate": [0.01, 0.02, 0.05], "years": [1, 5, 10]}, lambda r, y: F.round(F.col("p_retailprice") * F.pow(1 + r, y), 6))
    return grid.select("p_partkey", "rate", "years", "value")


@query("g07_chart_shape", "SELECT count(DISTINCT c_mktsegment) AS categories, 1 AS series, bool_or(c_acctbal < 0) AS negatives FROM customer")
def _(s, d):
    return generate.chart_shape(load(s, d, "customer"), "c_mktsegment", ["c_acctbal"])


@query("g08_chart_rows", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 500")
def _(s, d):
    from ..operators import pivot

    p = pivot.hierarchy(load(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*")})
    return generate.chart_rows(p, "depth", 2, "l_returnflag").drop("depth")


@query("g09_sparklines")
def _(s, d):
    o = load(s, d, "orders").withColumn("t", F.unix_date(F.col("o_orderdate").cast("date")))
    return generate.sparklines(o, "o_orderpriority", "t", "o_totalprice", 24)


def _revised(s, d):
    """Documents whose second line is gone and which have a line more at the end."""
    docs = load(s, d, "documents").select("doc_id", "text")
    lines = F.split("text", "\n")
    return docs, docs.select("doc_id", F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(lines, 3, 1 << 30), F.array(F.lit("a line of the end"))), "\n").alias("text"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query("m14_line_diff", f"""WITH p AS (SELECT doc_id, {_LINES} AS a, {_LINES.replace('string_split(text, chr(10))', "(list_concat(string_split(text, chr(10))[1:1], string_split(text, chr(10))[3:]))")} AS b FROM documents)
    SELECT doc_id AS "key", (len(a) - len(b))::INT AS removed, 1 AS added, ['a line of the end'] AS added_units FROM p""")
def _(s, d):
    """Every document against a revised form of it: one line was added at the end, and at most one removed."""
    from ..operators import diff

    got = diff.compare(*_revised(s, d), "doc_id", "text", "line")
    return got.select("key", F.size("removed").alias("removed"), F.size("added").alias("added"), "added_units")


@query("m16_word_compare", "SELECT p_partkey AS \"key\", CASE WHEN p_partkey % 3 = 0 THEN [] ELSE [string_split(p_name, ' ')[-1]] END AS removed_units, CASE WHEN p_partkey % 3 = 0 THEN [] ELSE ['Made', ' ', 'up'] END AS added_units FROM part")
def _(s, d):
    """Names of parts against a form with other case and spaces, in which two of three have another last word."""
    from ..operators import diff

    part = load(s, d, "part").select("p_partkey", "p_name")
    other = F.when(F.col("p_partkey") % 3 == 0, F.replace(F.upper("p_name"), F.lit(" "), F.lit("\t "))).otherwise(F.regexp_replace(F.initcap("p_name"), r"\S+$", "Made up"))
    return diff.compare(part, part.select("p_partkey", other.alias("p_name")), "p_partkey", "p_name", "word", case=False, space=False).select("key", "removed_units", "added_units")


@query("f15_forecast_ets")
def _(s, d):
    """Six months ahead of the mean price by priority; the season is looked for."""
    from ..functions import forecast

    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return forecast.forecast_ets(load(s, d, "orders"), "o_orderpriority", month, F.col("o_totalprice"), 6)
