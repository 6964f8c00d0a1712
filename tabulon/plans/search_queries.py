"""Queries of document search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records
from ..operators import search as se
from ..registry import load, query

_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')"


@query("b01_fold_text")
def _(s, d):
    """Class codes and number pairs included; DuckDB has no Unicode normalization."""
    return load(s, d, "documents").select("doc_id", tx.fold_any("text").alias("folded"))


@query("b02_tokenize", f"SELECT doc_id, len({_W}) AS n, array_to_string({_W}, ' ') AS tokens FROM documents")
def _(s, d):
    t = tx.index_tokens(F.col("text"))
    return load(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query("b05_postings", f"SELECT term, doc_id AS id, count(*) AS tf, max(n)::INT AS len FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM (SELECT doc_id, {_W} AS w FROM documents)) GROUP BY 1, 2")
def _(s, d):
    return se.postings(load(s, d, "documents"), "doc_id", "text")


@query("b06_token_coverage", f"SELECT doc_id, i - 1 AS pos, coalesce(sum(length(t)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT r, doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents))")
def _(s, d):
    lens = load(s, d, "documents").select("doc_id", F.transform(tx.words(F.col("text")), lambda t: F.length(t).cast("long")).alias("n"))
    each = lens.select("doc_id", F.posexplode(tx.sums_before("n")).alias("pos", "before"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), "before")


@query("b09_name_words", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['brand', string_split(p_brand, '#')[2], 'la', 'me', 'ha', 'noi']))), ' ') AS words,
    len(list_distinct(list_concat(string_split(p_name, ' '), ['brand', string_split(p_brand, '#')[2], 'la', 'me', 'ha', 'noi', 'tim', 'files', 'cua', 'the'])))::INT AS with_fillers FROM part""")
def _(s, d):
    """Questions for every part: fillers go as they are typed ("là", "la"), words that only fold to one stay ("lá", "mẹ"), and so do name words behind accents."""
    question = F.concat(F.lit("Tìm files "), F.col("p_name"), F.lit(" của la là THE lá, MẸ; tài liệu "), F.col("p_brand"), F.lit(" Hà Nội"))
    found, every = se.name_words(question), se.name_words(question, fillers=True)
    return load(s, d, "part").select("p_partkey", F.array_join(F.array_sort(found), " ").alias("words"), F.size(every).alias("with_fillers"))


@query("b10_identifiers", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '([a-z]+[0-9]+)', 1)), '^([a-z]+)0+([0-9])', '\\1\\2') AS code FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", tx.canonical_identifier(F.lower(F.regexp_extract("url", "([a-z]+[0-9]+)", 1))).alias("code"))


@query("b11_grouped_numbers", "SELECT o_orderkey, (floor(o_totalprice) + 1000)::BIGINT::VARCHAR AS amount FROM orders")
def _(s, d):
    shown = F.concat(F.lit("total "), F.format_number(F.floor("o_totalprice") + 1000, 0), F.lit(" paid"))
    return load(s, d, "orders").select("o_orderkey", F.get(tx.amounts(shown), F.lit(0)).alias("amount"))


def _vector(s, d, i):
    return [float(x) for x in load(s, d, "embeddings").where(F.col("vec_id") == i).first()["embedding"]]


@query("b16_vector_top_k", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 9) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) DESC, vec_id LIMIT 10")
def _(s, d):
    return se.vector_search(load(s, d, "embeddings"), "vec_id", "embedding", _vector(s, d, 0), 10).withColumn("score", F.round("score", 9))


_LEX = "SELECT doc_id AS c, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, source AS s FROM documents"
_SEM = "SELECT doc_id AS c, row_number() OVER (ORDER BY n_chars, doc_id) AS rank, source AS s FROM documents"


def _lists(s, d):
    docs = load(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring("source", 4, 9).cast("int").alias("document_id"), "n_chars")
    lex = docs.orderBy(F.desc("n_chars"), "chunk_id").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "chunk_id"))).withColumn("strict", F.col("rank") <= 2)
    sem = docs.orderBy("n_chars", "chunk_id").limit(900).withColumn("rank", F.row_number().over(Window.orderBy("n_chars", "chunk_id")))
    return lex, sem


@query("b18_reciprocal_rank_fusion", f"SELECT c AS chunk_id, round(sum(w), 9) AS score FROM (SELECT c, 2.0::DOUBLE / (60 + rank) AS w FROM ({_LEX}) WHERE rank <= 200 UNION ALL SELECT c, 1.0::DOUBLE / (60 + rank) FROM ({_SEM}) WHERE rank <= 900) GROUP BY 1")
def _(s, d):
    return se.fuse(*_lists(s, d)).select("chunk_id", F.round("score", 9).alias("score"))


@query("b19_adaptive_weights", f"SELECT c AS chunk_id, round(sum(w), 9) AS score FROM (SELECT c, 1.0::DOUBLE / (60 + rank) AS w FROM ({_LEX}) WHERE rank <= 200 UNION ALL SELECT c, 2.0::DOUBLE / (60 + rank) FROM ({_SEM}) WHERE rank <= 900) GROUP BY 1")
def _(s, d):
    return se.fuse(*_lists(s, d), query="where are all reports about water quality", strong=True).select("chunk_id", F.round("score", 9).alias("score"))


_FUSED = f"SELECT c, s, sum(w) + max(pin) AS o, sum(w) AS score FROM (SELECT c, s, 2.0::DOUBLE / (60 + rank) AS w, CASE WHEN rank <= 2 THEN 1001 - rank ELSE 0 END AS pin FROM ({_LEX}) WHERE rank <= 200 UNION ALL SELECT c, s, 1.0::DOUBLE / (60 + rank), 0 FROM ({_SEM}) WHERE rank <= 900) GROUP BY 1, 2"


@query("b20_strict_gate", f"SELECT c AS chunk_id, round(o, 9) AS order_score FROM ({_FUSED})")
def _(s, d):
    return se.fuse(*_lists(s, d), query="hd433").select("chunk_id", F.round("order_score", 9).alias("order_score"))


@query("b21_diversify", f"SELECT c AS chunk_id, round(score, 9) AS score, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(o, 12) DESC, c) AS nth FROM ({_FUSED})) ORDER BY (nth > 2)::INT, round(o, 12) DESC, c LIMIT 50")
def _(s, d):
    f = se.fuse(*_lists(s, d), query="hd433").withColumn("order_score", F.round("order_score", 12))
    return se.diversify(f, 2, 50).select("chunk_id", F.round("score", 9).alias("score"), "nth")


@query("b22_promote_names", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang = 'de'), c AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source <> 'src3'), b AS (SELECT coalesce(n.doc_id, c.doc_id) AS document_id, n.rank AS nr, c.rank AS cr FROM n FULL JOIN c ON n.doc_id = c.doc_id) SELECT document_id, coalesce(nr, 1000000 + cr) AS place FROM b WHERE cr IS NOT NULL UNION ALL SELECT * FROM (SELECT document_id, nr FROM b WHERE cr IS NULL ORDER BY nr LIMIT 3)")
def _(s, d):
    docs = load(s, d, "documents").withColumnRenamed("doc_id", "document_id")
    n = records.numbered(docs.where("lang = 'de'").select("document_id"), ["document_id"], "rank")
    c = records.numbered(docs.where("source <> 'src3'").select("document_id", "n_chars"), [F.desc("n_chars"), "document_id"], "rank").drop("n_chars")
    return se.promote_names(n, c)


@query("b23_name_score", """SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN 140.0::DOUBLE WHEN starts_with(p_name, 'red ring') THEN 130.0 WHEN contains(replace(p_name, ' ', ''), 'redring') THEN 115.0
    WHEN list_contains(w, 'red') OR list_contains(w, 'ring') THEN 25.01 ELSE 0.0 END AS score FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)""")
def _(s, d):
    return load(s, d, "part").select("p_partkey", se.name_score(tx.fold_ascii(F.col("p_name")), F.lit(""), ["red", "ring"]).alias("score"))


@query("b24_one_edit", """SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: len(x) >= 4 AND levenshtein(x, 'widgot') <= 1)) > 0 AS misspelled, len(list_filter(string_split(p_name, ' '), lambda x: x = 'red')) > 0 AS short,
    len(list_filter(string_split(p_name, ' '), lambda x: len(x) >= 4 AND levenshtein(x, 'rings') <= 1)) > 0 AS shortened FROM part""")
def _(s, d):
    """One edit is forgiven in words of four letters or more ("widgot", "rings"), shorter ones are exact ("red", not "bed")."""
    has = lambda term: F.exists(F.split("p_name", " "), lambda w: se.one_edit(w, term))
    return load(s, d, "part").select("p_partkey", has("widgot").alias("misspelled"), has("red").alias("short"), has("rings").alias("shortened"))


@query("b25_matched_words", "SELECT p_partkey, (contains(replace(p_name, ' ', ''), 'red'))::INT + (contains(replace(p_name, ' ', ''), 'bolt'))::INT AS n FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", se.matched_words(tx.fold_ascii(F.col("p_name")), ["red", "bolt"]).alias("n"))


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("b27_snippet", f"SELECT doc_id, CASE WHEN strpos(lower(t), 'the') > 0 THEN strpos(lower(t), 'the') END::INT AS first FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents) WHERE contains(lower(t), 'the')")
def _(s, d):
    docs = load(s, d, "documents").withColumn("s", tx.snippet(F.col("text"), "the")).where("s IS NOT NULL")
    flat = F.regexp_replace("text", r"\s+", " ")
    lead = F.instr(F.col("s"), "[") - F.col("s").startswith("…").cast("int")
    start = F.greatest(F.lit(1), F.locate("the", F.lower(flat)) - 40)
    return docs.select("doc_id", (start + lead - 1).alias("first"))


@query("b28_excerpt", f"SELECT doc_id, substr({_FLAT}, CASE WHEN strpos(lower({_FLAT}), 'and') > 0 THEN greatest(1, strpos(lower({_FLAT}), 'and') - 25) ELSE 1 END, 100) AS part FROM documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", tx.excerpt(F.col("text"), "and", 100).alias("part"))


@query("b29_contains_any", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'thetion') OR contains(strip_accents(lower(text)), 'geber')")
def _(s, d):
    return load(s, d, "documents").where(tx.contains_any(F.col("text"), ["Thetion", "geber"])).select("doc_id")


@query("b32_media_search", "SELECT event_id, ts FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' AND contains(props, '\"k\": 4') ORDER BY ts DESC, props LIMIT 40")
def _(s, d):
    intent = se.media_intent("2024-01-03") | {"kind": "view", "words": ['"k": 4']}
    return se.media_search(load(s, d, "events"), intent, "event_type", "ts", "props", 40).select("event_id", "ts")


@query("b33_best_per_key", "SELECT user_id, max(value) AS value FROM events GROUP BY 1")
def _(s, d):
    return se.best_per_key(load(s, d, "events"), "user_id", "value", "event_id").select("user_id", "value")


@query("b34_rerank", "SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place FROM events")
def _(s, d):
    return records.numbered(load(s, d, "events").select("event_id", "value"), se.rerank_keys("value", "event_id"), "place").drop("value")


@query("b35_recency_tie_break", "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY date_trunc('day', ts) DESC, event_id) AS nth FROM events) WHERE nth = 1")
def _(s, d):
    """The freshest event of each kind and user by day; of one day the smallest id."""
    return se.freshest(load(s, d, "events"), ["event_type", "user_id"], F.date_trunc("day", "ts"), "event_id")


@query("b36_truncate_vectors", "WITH u AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 7) AS first, round(v[16] / sqrt(list_dot_product(v, v)), 7) AS last FROM u")
def _(s, d):
    t = load(s, d, "embeddings").select("vec_id", se.truncated(F.col("embedding"), 16).alias("t"))
    return t.select("vec_id", F.round(F.get("t", F.lit(0)), 7).alias("first"), F.round(F.get("t", F.lit(15)), 7).alias("last"))


@query("b38_merge_vectors", "WITH u AS (SELECT vec_id, (embedding[1:32]::DOUBLE[]) AS a, (embedding[33:64]::DOUBLE[]) AS b FROM embeddings), m AS (SELECT vec_id, list_transform(list_zip(a, b), lambda x: x[1] + x[2]) AS s FROM u) SELECT vec_id, round(s[1] / sqrt(list_dot_product(s, s)), 7) AS first FROM m")
def _(s, d):
    m = se.merged_vectors(F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")))
    return load(s, d, "embeddings").select("vec_id", F.round(F.get(m, F.lit(0)), 7).alias("first"))


@query("b39_quantize", "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, (list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127)::FLOAT::DOUBLE AS k FROM embeddings) SELECT vec_id, list_sum(list_transform(v, lambda x: greatest(-127, least(127, floor(x / k + 0.5))))::BIGINT[])::BIGINT AS total, round(k, 9) AS scale FROM u")
def _(s, d):
    q = load(s, d, "embeddings").select("vec_id", se.quantized(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.round(F.col("q.scale").cast("double"), 9).alias("scale"))


@query("b40_quantized_cosine")
def _(s, d):
    e = load(s, d, "embeddings").select("vec_id", se.quantized(F.col("embedding"))["q"].alias("q"))
    first = [int(x) for x in e.where("vec_id = 0").first()["q"]]
    return e.select("vec_id", se.cosine(F.col("q"), F.array(*map(F.lit, first))).alias("score"))


@query("b41_space_id", "SELECT vec_id, 'model:main:' || label || ':64' AS space FROM embeddings")
def _(s, d):
    return load(s, d, "embeddings").select("vec_id", se.space_id(F.lit("model"), F.lit("main"), F.col("label").cast("string"), F.lit("64")).alias("space"))
