"""Long words that linear hashes take for each other; many languages, and languages of long texts only."""

import pyarrow as pa
from pyspark.sql import functions as F

from tabulon.llm import jaccard, langid


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_words_of_equal_polynomials_are_told_apart(spark):
    for n in (1024, 2048, 4096):
        x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        (p,), (q,) = (jaccard.shingle_sets(pa.array([t]), 3) for t in (x, y))
        assert p.tolist() != q.tolist()
        p, q = jaccard.shingle_sets(pa.array([f"one two {x} three four", f"one two {y} three four"]), 3)
        assert not set(p.tolist()) & set(q.tolist())
    n = 2048
    docs = spark.createDataFrame([(1, thue_morse(n, "a", "b")), (2, thue_morse(n, "b", "a")), (3, thue_morse(n, "A", "B")), (4, "x " + thue_morse(n, "a", "b") + " y"), (5, "x " + thue_morse(n, "b", "a") + " y")], "doc_id long, text string")
    for parts in (1, 3):
        got = {r.doc_id: r.component_id for r in jaccard.linked(docs.repartition(parts), width=3, percent=90).collect()}
        assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_every_language_is_learned(spark):
    """70 languages of two words each, and one of which all texts are longer than a quarter of the sample."""
    names = [f"l{i:02d}" for i in range(70)]
    word = lambda i, k: "".join(chr(97 + (i * 7 + k * 3 + j * (1 + i % 5)) % 26) for j in range(6))
    rows = [(i * 20 + k, " ".join([word(i, 1), word(i, 2)] * 10), names[i]) for i in range(70) for k in range(6)]
    rows += [(9000 + k, "ωψχ φυτ " * 60_000, "el") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.fit(docs)
    assert trees.langs == sorted([*names, "el"])
    pred = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("lang IN ('l03', 'l69', 'el')"), trees).collect()}
    assert all(pred[i] == lang for i, _, lang in rows if lang in ("l03", "l69", "el"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = langid.fit(docs)
    got = langid.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred").where("lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 100
