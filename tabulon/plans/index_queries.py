"""Queries over stored indexes: full text by term, neighbours by cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, fulltext
from ..operators import search as se
from ..registry import load, query

_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')"
_HAS = lambda q: f"list_contains(w, '{q}')"
_DOCS = f"(SELECT doc_id, source, n_chars, {_W} AS w FROM documents)"


def documents(s, d) -> fulltext.FullText:
    """The index of the documents' texts; whoever asks first builds it."""
    return fulltext.stored(s, load(s, d, "documents"), "doc_id", "text", f"{d}/documents")


def _scores(terms: list[str]) -> str:
    """BM25 of some terms in DuckDB: t0.. are the counts, s0.. the sums over all documents."""
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    sums = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN t{i} > 0 THEN ln(1 + (s.n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * r.len / s.a)) ELSE 0 END" for i in range(len(terms)))
    some = " OR ".join(f"t{i} > 0" for i in range(len(terms)))
    return f"""r AS (SELECT doc_id, source, n_chars, len(w) AS len, {counts} FROM {_DOCS}), s AS (SELECT count(*) AS n, avg(len) AS a, {sums} FROM r),
    x AS (SELECT doc_id, source, n_chars, {part} AS score, {" + ".join(f"(t{i} > 0)::INT" for i in range(len(terms)))} AS matched FROM r, s WHERE {some})"""


@query("j09_build_postings", f"SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM {_DOCS}) GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    """The stored index, read whole: documents and occurrences of every term."""
    rows = documents(s, d).postings().select("term", "n", F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("tf"))
    return rows.groupBy("term").agg(F.sum("n").alias("documents"), F.sum("tf").alias("occurrences"))


@query("j09_fulltext_join", f"WITH {_scores(['was', 'the', 'it'])} SELECT doc_id, source, n_chars, round(score, 8) AS score FROM x WHERE matched = 3")
def _(s, d):
    docs = load(s, d, "documents").select("doc_id", "source", "n_chars")
    return documents(s, d).joined(docs, "doc_id", ["was", "the", "it"]).select("doc_id", "source", "n_chars", F.round("score", 8).alias("score"))


@query("j09_fulltext_top", f"WITH {_scores(['der', 'la', 'was'])} SELECT doc_id AS id, round(score, 8) AS score, matched FROM x ORDER BY x.score DESC, doc_id LIMIT 20")
def _(s, d):
    return documents(s, d).top(["der", "la", "was"], 20).select("id", F.round("score", 8).alias("score"), "matched")


@query("b04_boolean_match", f"SELECT doc_id AS id FROM {_DOCS} WHERE {_HAS('the')} AND {_HAS('and')} AND NOT {_HAS('his')}")
def _(s, d):
    q = se.parse_query('the "and" -his')
    return documents(s, d).boolean([t for x in q["include"] for t in x["tokens"]], [t for x in q["exclude"] for t in x["tokens"]])


@query("b12_staged_plan", f"SELECT doc_id AS id, CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' was it ') THEN 0 WHEN {_HAS('was')} AND {_HAS('it')} THEN 1 ELSE 2 END::INT AS stage FROM {_DOCS} WHERE {_HAS('was')} OR {_HAS('it')}")
def _(s, d):
    tokens = se.query_tokens("was it")
    return documents(s, d).staged(tokens, [se.identifier_variants(t) for t in tokens])


@query("b13_bm25", f"WITH {_scores(['was', 'it'])} SELECT doc_id AS id, round(score, 8) AS score, matched FROM x")
def _(s, d):
    return documents(s, d).bm25(["was", "it"]).withColumn("score", F.round("score", 8))


@query("b17_ann_neighbours")
def _(s, d):
    """Ten neighbours of every row whose id is divisible by 50; approximate, so its recall is tested against the exact ones."""
    vectors = load(s, d, "embeddings")
    index = ann.stored(s, vectors, "vec_id", "embedding", f"{d}/embeddings")
    return index.search(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding").select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 9).alias("score"))


@query("b17_exact_neighbours", """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, round(score, 9) AS score FROM s QUALIFY rank <= 10""")
def _(s, d):
    vectors = load(s, d, "embeddings")
    return ann.exact_neighbours(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding").select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 9).alias("score"))


def registered(name: str):
    from .. import registry

    return registry.queries()[name]
