"""Golden cases of text functions, search, records, sources, streaming and commands."""

import json

import pytest
from pyspark.sql import functions as F

from tabulon.functions import text as tx
from tabulon.operators import corpus, records, search
from tabulon.plans import commands
from tabulon.sources import files
from tabulon.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_folding(spark):
    assert tx.fold_text("Quyết ĐỊNH lop5a, 1/2") == "quyet dinh lop5a 1 2"
    df = spark.createDataFrame([("Été à la Đà Nẵng!",), (None,)], "t string")
    assert [tuple(r) for r in df.select(tx.fold_any("t"), tx.fold_ascii(F.col("t"))).collect()] == [("ete a la da nang", "ete a la da nang"), (None, None)]


def test_tokens(spark):
    assert one(spark, tx.index_tokens(F.lit("Tokyo東京都2"))) == ["tokyo", "東京", "京都", "2"]
    assert one(spark, tx.unigram_tokens(F.lit("東京a"))) == ["東", "京", "a"]
    assert tx.identifier_variants("hd0433") == ["hd0433", "hd433", "hd00433", "hd000433"]
    assert one(spark, tx.canonical_identifier(F.lit("hd0433"))) == "hd433"
    assert one(spark, tx.amounts(F.lit("16.432.095 and 16,432,095 and 16 432 095, not 1.2"))) == ["16432095"] * 3


def test_line_signs(spark):
    lines = ["Tuần 5", "Invoice No: 12", "hello world", "CHAPTER ONE", "the end of it."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i")
    got = [tuple(r) for r in df.select(tx.is_marker(F.col("x")), tx.is_heading(F.col("x"))).collect()]
    assert [g[0] for g in got] == [True, True, False, True, False] and [g[1] for g in got][2:] == [False, True, False]


def test_staged_and_bm25(spark):
    docs = spark.createDataFrame([(1, "red blue green"), (2, "blue red"), (3, "red"), (4, "none"), (5, None)], "id long, t string")
    assert {r.id: r.stage for r in search.staged(docs, "id", "t", "red blue").collect()} == {1: 0, 2: 1, 3: 2}
    scores = {r.id: r.score for r in search.bm25(docs.where("id < 5"), "id", "t", ["red", "blue"]).collect()}
    assert scores[2] > scores[1] > scores[3] and 4 not in scores


def test_fusion(spark):
    schema = "chunk_id int, document_id int, rank int, strict boolean"
    lex = spark.createDataFrame([(1, 1, 1, False), (2, 1, 2, True), (3, 1, 3, False)], schema)
    sem = spark.createDataFrame([(4, 2, 1, False), (1, 1, 2, False)], schema)
    plain = {r.chunk_id: r.score for r in search.fuse(lex, sem).collect()}
    assert abs(plain[1] - (2 / 61 + 1 / 62)) < 1e-12
    pinned = search.fuse(lex, sem, query="hd433")
    assert [r.chunk_id for r in search.diversify(pinned, 2, 4).collect()] == [2, 1, 4, 3]


def test_names_and_vectors(spark):
    def score(name, words):
        return one(spark, search.name_score(F.lit(name), F.lit(""), words))

    assert score("my le", ["my", "le"]) == 140 and score("my le 2", ["my", "le"]) == 130 and score("x myle", ["my", "le"]) == 115
    assert 90 <= score("annual report", ["anual", "report"]) < 100 and score("other", ["anual"]) == 0
    q = one(spark, search.quantized(F.array(F.lit(1.0), F.lit(0.25))))
    assert q.q == [127, 32] and one(spark, search.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert search.media_intent("photos from 2024-05")["kind"] == "image" and str(search.media_intent("12/2024")["to"]) == "2025-01-01"
    assert search.name_aliases(["ra", "vien"]) == [["xuat", "vien"]]


def test_records(spark):
    df = spark.createDataFrame([(1, "Ada", "London"), (2, "Alan", " WILMSLOW "), (3, "Grace", None)], "id int, name string, city string")
    keep = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert keep(records.chain([("", "city", "equals", "london"), ("or", "name", "contains", "a"), ("and", "city", "blank", "")])) == [1, 3]
    assert keep(records.chain([])) == [1, 2, 3]
    assert [r.n for r in records.numbered(df, ["id"], "n").orderBy("id").collect()] == [1, 2, 3]
    assert records.named_fields(spark.createDataFrame([(1, 2, 3)], ["Name", " ", "Name"])).columns == ["Name", "Column2", "Name2"]
    a = spark.createDataFrame([(1, "x\ny\nz"), (2, "only")], "p long, t string")
    b = spark.createDataFrame([(1, "x\n  q \nz"), (3, "new\nlines")], "p long, t string")
    got = {r.page: (r.removed, r.added) for r in records.compare(a, b, "p", "t").collect()}
    assert got == {1: ([1], [1]), 2: ([0], []), 3: ([], [0, 1])}
    assert records.precedents("=SUM(A1:B2)+$A$1+Other!C3") == [(1, 1, 2, 2), (1, 1, 1, 1)]


def test_corpus(spark):
    docs = spark.createDataFrame([(i, f"Title {i}\nsame line here\nunique words number {'abc'[i % 3]} {i}", "f") for i in range(4)], "id long, t string, f string")
    lines = corpus.family_lines(docs, "id", "t", "f")
    assert [r.documents for r in lines.collect()] == [4]
    pr = corpus.line_priorities(docs, "id", "t", "f", lines)
    assert corpus.skeleton(pr, "id").count() == 4
    chunks = corpus.chunk_texts(spark.createDataFrame([(1, "a" * 4000), (2, None), (3, "")], "id long, t string"), "id", "t").collect()
    assert [len(c.chunk) for c in chunks] == [1800, 1800, 400]
    span = F.array(F.struct(F.lit(1).alias("s"), F.lit(3).alias("e")))
    assert one(spark, corpus.redact_spans(F.lit("abcdef"), span)) == "a[WITHHELD]def"
    a, b = (one(spark, corpus.family_key(F.lit(f"/x/Giao an Toan 3 - Tuan {n} - Bai {n}.docx"))) for n in (5, 6))
    assert a == b


def test_sources(spark, tmp_path):
    assert files.sniff("a;b\n1;2")[0] == ";" and files.sniff("a,b;c\n1,2;3")[0] == "," and files.sniff("sep=|\na|b") == ("|", 1)
    assert files.sniff("Hello, world\nno more\nof it\nhere")[0] == ","
    assert files.decode("é".encode("cp1252")) == "é" and files.decode(b"\xff\xfe" + "hé".encode("utf-16-le")) == "hé" and files.decode("name".encode("utf-16-le")) == "name"
    with pytest.raises(ValueError):
        files.decode(b"\xff\xfe\x00\x00abcd")
    (tmp_path / "a.csv").write_bytes('x;y\r\n"q;1";"two\nlines"\r\n;\r\n'.encode())
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.docx").write_text("not a zip")
    cells = [r.cells for r in files.read_cells(spark, str(tmp_path / "a.csv")).orderBy("row").collect()]
    assert cells == [["x", "y"], ["q;1", "two\nlines"]]
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in files.extract(spark, str(tmp_path)).collect()}
    assert got["b.txt"] == ("plain", None) and got["c.docx"][0] is None and got["c.docx"][1]
    assert files.html_text("<p>a &amp; b</p><script>x</script>") == "a & b"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, f"v{i}") for i in range(20)], "k int, at int, v string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    q = incremental.upsert_stream(incremental.stream_table(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), "k", "at", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.k: r.v for r in incremental.current_version(spark, str(tmp_path / "out")).collect()} == {k: f"v{15 + k}" for k in range(5)}


def test_commands(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(["b", "a", "A", None])], "row_idx long, v string")
    book = commands.Book({"t": t})
    new = commands.apply(book, commands.Batch([{"type": "set_cell", "table": "t", "row": 3, "column": "v", "value": "c"}, {"type": "remove_duplicates", "table": "t", "columns": ["v"]},
                                               {"type": "delete_rows", "table": "t", "first": 0, "last": 0}]))
    assert new.revision == 1 and sorted((r.row_idx, r.v) for r in new.tables["t"].collect()) == [(0, "a"), (2, "c")]
    assert book.tables["t"].count() == 4
    for bad in (commands.Batch([{"type": "explode", "table": "t"}]), commands.Batch([], base_revision=3)):
        with pytest.raises(ValueError):
            commands.apply(book, bad)


def test_registry_names_match():
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150 and json.dumps(sorted(q))


def test_paths_without_steps_are_admitted(spark):
    df = spark.createDataFrame([("",), ("///",), (None,), ("a.bak/b.txt",), ("~$x",)], "p string")
    assert [r[0] for r in df.select(corpus.refusal(F.col("p"))).collect()] == [None, None, None, None, "temporary-file"]
    row = spark.range(1).select(corpus.issue_reason(F.lit(None).cast("string"), F.lit(None).cast("string")), corpus.issue_reason(F.lit(None).cast("string"), F.lit("empty"))).first()
    assert tuple(row) == ("other", "no-text")


def test_skeleton_is_the_greedy_walk_in_one_plan(spark):
    """Against a walk in plain Python over equal lines, lines that don't fit, repeated titles and droppable ones; no group is handed to Python, and text isn't shuffled."""
    import random

    rng, docs = random.Random(5), []
    for i in range(60):
        some = [f"{rng.choice('abcdefg')}{k} " + rng.choice(["word ", "été "]) * rng.randint(1, 40) for k in range(12)] + ["Part 3: one", "call 555-1234 now", "SHARED HEADING", "shared line that is common to all."]
        docs.append((i, "\n".join(rng.choice(some) for _ in range(rng.randint(0, 60))), f"f{i % 2}"))
    df = spark.createDataFrame(docs, "id long, t string, f string")
    lines = corpus.line_priorities(df, "id", "t", "f", corpus.family_lines(df, "id", "t", "f"))
    want = {}
    by = {}
    for r in lines.collect():
        by.setdefault(r.id, []).append(r)
    for i, rows in by.items():
        room, used, seen, kept = max(300, -(-sum(r.chars for r in rows) // 5)), 0, set(), 0
        for r in sorted(rows, key=lambda r: (r.priority, r.order)):
            if r.priority < corpus.DROPPABLE and (r.priority == 0 or not (r.line in seen or used + r.chars + 1 > room)):
                seen.add(r.line)
                kept, used = kept + 1, used + r.chars + 1
        want[i] = (kept, used)
    got = corpus.skeleton(lines, "id", 300)
    assert {r.id: (r.kept, r.kept_chars) for r in got.collect()} == want and {x.priority for r in by.values() for x in r} >= {0, 1, 3, 4, 9}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and not any("line#" in x for x in plan.split("\n") if "Exchange hashpartitioning(id" in x or "Exchange hashpartitioning(family" in x)
