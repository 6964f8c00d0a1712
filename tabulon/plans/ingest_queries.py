"""Queries of sources and sinks, over text made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.coerce import csv_number
from ..lineage import shared_dir
from ..registry import load, query
from ..sources import files


#: Cells of each kind that a number is told from, # for the row's key, and the number meant (in SQL) or none.
_NUMERIC = (("#", "k"), ("00#", None), ("+#", None), (".5#", "('.5' || o_orderkey)::DOUBLE"), ("#.", "k"), ("#e2", "k * 100"), ("#.25", "k + 0.25"), ("1,000", None), ("-#", "-k"), ("9999999999999999", None), (" #", None), ("0x#", None))


@query("d06_numeric_cells", f"SELECT o_orderkey, CASE o_orderkey % {len(_NUMERIC)} " + " ".join(f"WHEN {i} THEN {n or 'NULL'}" for i, (_, n) in enumerate(_NUMERIC)) + " END AS number FROM (SELECT o_orderkey, o_orderkey::DOUBLE AS k FROM orders)")
def _(s, d):
    """Cells made of every order's key: plain, padded, signed, grouped, with a point or an exponent, too long."""
    form = F.get(F.array(*(F.lit(f) for f, _ in _NUMERIC)), (F.col("o_orderkey") % len(_NUMERIC)).cast("int"))
    return load(s, d, "orders").select("o_orderkey", csv_number(F.replace(form, F.lit("#"), F.col("o_orderkey").cast("string"))).alias("number"))


@query("d08_csv_shape", """SELECT p_brand AS path, count(*) AS rows, max(len(string_split(p_name, ' ')) + p_size % 4)::BIGINT AS columns, max(len(string_split(p_name, ' ')))::BIGINT AS used_columns, ',' AS sep
    FROM part GROUP BY 1""")
def _(s, d):
    """Brands as files: a part's words are the cells of a row, with up to three empty ones behind them."""
    cells = F.concat(F.split("p_name", " "), F.array_repeat(F.lit(""), F.col("p_size") % 4))
    return files.shape(load(s, d, "part").select(F.col("p_brand").alias("path"), cells.alias("cells"), F.lit(",").alias("sep")))


@query("d11_html_text", "SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')) > 0 AS has_text FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", (F.length(files.html_text_column(F.col("html"))) > 0).alias("has_text"))


@query("d13_magic_bytes", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'zip' WHEN 1 THEN 'ole2' WHEN 2 THEN CASE WHEN page_id * 13 % 1500 <= 1020 THEN 'pdf' ELSE 'unknown' END ELSE 'unknown' END AS kind FROM pages""")
def _(s, d):
    """Pages behind the marks of a format; a PDF's mark counts within the first 1,024 bytes, and only as whole bytes."""
    html = F.encode("html", "UTF-8")
    made = F.get(F.array(
        F.concat(F.unhex(F.lit("504B0304")), html), F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), html), F.concat(F.encode(F.repeat(F.lit(" "), (F.col("page_id") * 13 % 1500).cast("int")), "UTF-8"), F.encode(F.lit("%PDF-1.7"), "UTF-8"), html),
        F.concat(F.unhex(F.lit("1255044461")), html), html), (F.col("page_id") % 5).cast("int"))
    return load(s, d, "pages").select("page_id", files.magic(made).alias("kind"))


@query("d16_range_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 500")
def _(s, d):
    return load(s, d, "lineitem").where(F.col("l_orderkey").between(100, 500)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("d17_merge_tables", "SELECT 'customer' AS source_table, c_nationkey AS k, c_acctbal AS bal, NULL AS extra FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, s_name FROM supplier")
def _(s, d):
    return files.merge_tables({
        "customer": load(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal")),
        "supplier": load(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("extra")),
    })


@query("d19_clipboard_lines", "SELECT n_nationkey || chr(9) || n_name || chr(9) || CASE WHEN n_regionkey = 1 THEN 'TRUE' ELSE 'FALSE' END AS line FROM nation")
def _(s, d):
    return files.tsv_line(load(s, d, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") == 1).alias("b")))


@query("d01_csv_round_trip", "SELECT doc_id, source, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def _(s, d):
    """All documents, with their line feeds and quotes, through one CSV file that is read in as many tasks as it has blocks."""
    path = f"{shared_dir(s).rstrip('/')}/csv-{uuid.uuid4().hex}"
    docs = load(s, d, "documents").select("doc_id", "source", "text")
    docs.coalesce(1).write.option("escape", '"').option("quoteAll", True).csv(path)
    rows = files.read_split(s, path, ",")
    return rows.select(F.col("cells")[0].cast("long").alias("doc_id"), F.col("cells")[1].alias("source"), F.col("cells")[2].alias("text"))
