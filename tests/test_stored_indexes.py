"""Versions, the full-text index and the neighbour index against plain Python, with a writer that is killed."""

import math
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tabulon.operators import ann, fulltext
from tabulon.plans import index_queries
from tabulon.sources.versions import MARKER, Versions

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
KILLED = """
import os, sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
from tabulon.sources.versions import Versions
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
v = Versions(spark, {path!r})
v.commit = lambda *a: os._exit(9)  # dies between the files and the marker
v.write({{"t": spark.range(7)}})
"""


def test_half_built_versions_are_found_and_redone(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.current() is None and v.recover() == [] and v.half_built() == []
    with pytest.raises(FileNotFoundError):
        v.table("t")
    first = v.write({"t": spark.range(3)}, {"by": "a"})
    died = subprocess.run([sys.executable, "-c", KILLED.format(here=HERE, path=str(tmp_path / "v"))], capture_output=True, timeout=120)
    assert died.returncode == 9
    assert len(v.half_built()) == 1 and v.current() == first and v.table("t").count() == 3  # readers don't see it
    lost = v.recover(lambda: {"t": spark.range(7)})
    assert len(lost) == 1 and v.half_built() == [] and v.table("t").count() == 7
    assert v.notes() == {"tables": ["t"], "redone": lost} and v.notes(first) == {"tables": ["t"], "by": "a"} and v.table("t", first).count() == 3
    assert v.recover(lambda: {"t": spark.range(1)}) == [] and v.table("t").count() == 7


def test_versions_of_two_writers_and_old_ones(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    a, b = v.begin(), v.begin()
    assert a.split("-")[1] == b.split("-")[1]
    for name, n in ((a, 1), (b, 2)):
        spark.range(n).write.parquet(f"{v.path}/{name}/t")
    v.commit(b)
    with pytest.raises(RuntimeError):
        v.commit(a)
    with pytest.raises(RuntimeError):
        v.commit(b)
    assert v.current() == b and v.table("t").count() == 2
    for n in range(3, 6):
        v.write({"t": spark.range(n)})
    assert len(v.expire(2)) == 2 and v.table("t").count() == 5 and v.half_built() == [a]
    assert not os.path.exists(f"{v.path}/{b}/{MARKER}")


DOCS = [(1, "the cat sat on the mat"), (2, "The mat, the cat"), (3, None), (4, ""), (5, "a dog"), (6, "cat " * 50 + "dog"), (None, "cat"), (7, "cat sat"), (7, "dog sat"), (8, "été cat-sat")]


def plain_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain_bm25(terms):
    docs = [(i, plain_words(t)) for i, t in DOCS if i is not None]
    avg, n = sum(len(w) for _, w in docs) / len(docs), len(docs)
    out = {}
    for t in set(terms):
        df = sum(t in w for _, w in docs)
        for i, w in docs:
            if t in w:
                tf = w.count(t)
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    return out


@pytest.fixture(scope="module", params=[4096, 2])
def index(request, spark, tmp_path_factory):
    df = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, term string").repartition(3)
    return fulltext.FullText(spark, str(tmp_path_factory.mktemp("ft"))).build(df, "doc_id", "text", request.param)


def test_full_text_answers(spark, index):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(index.boolean(["cat", "sat"])) == [1, 7, 8] and ids(index.boolean(["cat", "dog"], join="or")) == [1, 2, 5, 6, 7, 7, 8]
    assert ids(index.boolean(["cat"], ["mat"])) == [6, 7, 8] and ids(index.boolean([])) == [] and ids(index.boolean(["none"])) == []
    stages = lambda *a: sorted((r.id, r.stage) for r in index.staged(*a).collect())
    assert stages(["cat", "sat"]) == [(1, 0), (2, 2), (6, 2), (7, 0), (7, 2), (8, 0)]
    assert stages(["the", "cat", "sat"]) == [(1, 0), (2, 2), (6, 2), (7, 2), (7, 2), (8, 2)]
    assert stages(["mat", "cat"], [["mat", "dog"], ["cat"]]) == [(1, 1), (2, 1), (5, 2), (6, 1), (7, 2), (7, 2), (8, 2)]
    want = plain_bm25(["cat", "mat"])
    got = {r.id: r.score for r in index.bm25(["cat", "mat", "cat"]).where("id <> 7").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items() if k != 7}
    best = sorted((i for i in want if i != 7), key=lambda i: (-want[i], i))
    assert [r.id for r in index.top(["cat", "mat"], 2).collect()] == best[:2] and len(index.top(["cat"], 50).collect()) == 5
    assert index.top(["none"], 3).collect() == [] and index.bm25([]).collect() == []
    names = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], "doc_id long, name string")
    assert sorted((r.doc_id, r.name) for r in index.joined(names, "doc_id", ["cat", "the"]).collect()) == [(1, "a"), (2, "b")]
    empty = fulltext.FullText(spark, index.versions.path + "-empty").build(names.limit(0).withColumn("text", F.lit("x")), "doc_id", "text")
    assert empty.bm25(["x"]).collect() == [] and empty.staged(["x"]).collect() == []


def test_full_text_top_is_exact_and_reads_few_blocks(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(50)).cast("string")))).alias("text"))
    index = fulltext.FullText(spark, str(tmp_path / "i")).build(rows, "doc_id", "text", 64)
    every = index.bm25(["w1", "w2", "w3"]).orderBy(F.desc("score"), "id").limit(10).collect()
    assert [(r.id, round(r.score, 9)) for r in index.top(["w1", "w2", "w3"], 10).collect()] == [(r.id, round(r.score, 9)) for r in every]
    plan = index.rows(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "hits" not in index.rows(["w1"], ("term", "block", "most"))._jdf.queryExecution().executedPlan().toString()


def test_neighbours(spark, tmp_path):
    rows = spark.range(900).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: ((F.pmod(F.xxhash64(F.pmod("id", F.lit(30)), k), F.lit(600)) + F.pmod(F.xxhash64("id", k), F.lit(1000))) / 1000.0 - 0.8).cast("float")).alias("embedding")).cache()
    odd = spark.createDataFrame([(2001, None), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (None, [1.0] * 16), (2004, [])], "vec_id long, embedding array<float>")
    index = ann.AnnIndex(spark, str(tmp_path / "a")).rebuild(rows.unionByName(odd), "vec_id", "embedding", cells=25)
    assert index.codes().count() == 900
    asks = rows.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in ann.exact_neighbours(asks, rows, "vec_id", "embedding").collect()}

    def recall(**kw):
        got = index.search(asks, rows, "vec_id", "embedding", **kw).collect()
        assert all(round(r.score, 9) <= exact[r.query_id, r.rank][1] for r in got)
        true = {(q, i) for (q, _), (i, _) in exact.items()}
        return sum((r.query_id, r.id) in true for r in got) / len(exact)

    assert len(exact) == 180 and recall(probes=25, refine=10) > 0.98 and recall(probes=20) >= 0.9 and recall(probes=1) < recall(probes=12)
    # what is removed isn't found, and what comes again is
    gone = exact[50, 1][0]
    index.remove(spark.createDataFrame([(gone,), (None,)], "vec_id long"))
    assert index.codes().count() == 899 and gone not in {r.id for r in index.search(asks, rows, "vec_id", "embedding").where("query_id = 50").collect()}
    index.add(rows.where(F.col("vec_id") == gone), "vec_id", "embedding")
    assert index.codes().count() == 900 and gone in {r.id for r in index.search(asks, rows, "vec_id", "embedding", probes=25).where("query_id = 50").collect()}
    index.rebuild(rows.where("vec_id < 100"), "vec_id", "embedding")
    assert index.codes().count() == 100 and index.versions.notes()["gone"] == []
    none = ann.AnnIndex(spark, str(tmp_path / "b")).rebuild(odd, "vec_id", "embedding")
    assert none.search(asks, rows, "vec_id", "embedding").collect() == []


def test_one_query_reads_its_cells_only(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(2000)) / 1000.0 - 1.0)).alias("embedding"))
    index = ann.AnnIndex(spark, str(tmp_path / "a")).rebuild(rows, "vec_id", "embedding", cells=20)
    plan = index.search(rows.where("vec_id = 3"), rows, "vec_id", "embedding", probes=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    rows = index_queries.registered("b17_ann_neighbours")(spark, sf).collect()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.query_id, r.id) for r in ann.exact_neighbours(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding").collect()}
    assert len({(r.query_id, r.vec_id) for r in rows} & exact) >= 0.9 * len(exact) and len(rows) == len(exact)


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_full_text_is_built_without_a_shuffle_of_words(spark, tmp_path):
    """Blocks are bounded by documents and by words; a text of more words is a block by itself. Answers don't depend on the blocks."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.when(F.col("id") == 70, 900).otherwise(40)), lambda k: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", k), F.lit(300)).cast("string"))))
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    before = shuffled(spark)
    index = fulltext.FullText(spark, str(tmp_path / "a")).build(rows, "doc_id", "text", 512)
    assert shuffled(spark) - before < 20_000  # the texts have over a million bytes
    small = fulltext.FullText(spark, str(tmp_path / "b")).build(rows, "doc_id", "text", 64, 800)
    blocks = small.hits([f"word{i}" for i in range(300)]).select("block", "id", "len").distinct().groupBy("block").agg(F.sum("len").alias("words"), F.count("*").alias("n"), F.max("id").alias("id")).collect()
    assert all(b.words <= 800 and b.n <= 20 or (b.n, b.id, b.words) == (1, 70, 900) for b in blocks) and sum(b.n for b in blocks) == 4000
    every = lambda i, t: sorted((r.id, r.tf, r.len, tuple(r.places)) for r in i.hits([t], ("id", "tf", "len", "places")).collect())
    words_of = {r.doc_id: r.text.split() for r in rows.collect()}
    for t in ("word1", "word299"):
        assert every(index, t) == every(small, t) == sorted((d, w.count(t), len(w), tuple(k for k, x in enumerate(w) if x == t)) for d, w in words_of.items() if t in w)
        assert small.rows([t]).agg(F.sum("n")).first()[0] == len(every(small, t))


def test_exact_neighbours_are_those_of_the_plain_sum(spark, monkeypatch):
    """Equal vectors, repeated query ids, other lengths and several passes: against Python sums in the same order; vectors are neither joined nor shuffled."""
    monkeypatch.setattr(ann, "PASS_BYTES", 300)
    monkeypatch.setattr(ann, "_ASKS", 3)
    monkeypatch.setattr(ann, "_ROWS", 16)
    import random

    rng = random.Random(3)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(120)]
    vectors = [(i, v if any(v) else [1.0] * 6) for i, v in vectors] + [(500, vectors[3][1]), (3, [5.0, 1.0, 1.0, 0.0, 0.0, 0.5]), (501, [1.0, 2.0]), (502, [2.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)

    def unit(v):
        n = 0.0
        for x in v:
            n += x * x
        return [x / math.sqrt(n) for x in v]

    units, want = [(i, unit(v)) for i, v in vectors], {}
    for q, a in ((i, v) for i, v in units if i in (3, 7, 11, 60, 61, 62, 63, 501)):
        for i, b in units:
            if i != q and len(a) == len(b):
                score = 0.0
                for x, y in zip(a, b, strict=True):
                    score += x * y
                want.setdefault(q, []).append((-score, i))
    got = ann.exact_neighbours(df.where("vec_id IN (3, 7, 11, 60, 61, 62, 63, 501)"), df, "vec_id", "embedding", 5)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.id))
    assert found == {q: sorted(x)[:5] for q, x in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") > 1


def test_neighbours_of_many_cells_are_few_files_and_no_join_of_codes(spark, tmp_path):
    rows = spark.range(0, 600, 1, 6).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(2000)) / 1000.0 - 1.0)).alias("embedding"))
    index = ann.AnnIndex(spark, str(tmp_path / "a")).rebuild(rows, "vec_id", "embedding", cells=80)
    files = [f for _, _, fs in os.walk(f"{index.versions.path}/{index.versions.current()}/codes") for f in fs if f.endswith(".parquet")]
    assert len(files) == len({r.cell for r in index.codes().select("cell").distinct().collect()}) <= 80 and index.codes().count() == 600
    asks = rows.where("vec_id % 5 = 0")
    got = index.search(asks, rows, "vec_id", "embedding", probes=80, refine=20)
    exact = {(r.query_id, r.rank, r.id, round(r.score, 9)) for r in ann.exact_neighbours(asks, rows, "vec_id", "embedding").collect()}
    assert {(r.query_id, r.rank, r.id, round(r.score, 9)) for r in got.collect()} == exact  # with every cell and many candidates nothing is missed
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("cell" in x for x in joins)
