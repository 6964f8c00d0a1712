"""Vector codes and fill-in-middle rows against plain Python."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import fim, vafile

pytest.importorskip("tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.data())
def test_va_file_finds_the_nearest(dims, data):
    number = st.integers(-20, 20) | st.integers(-2**70, 2**70)
    rows = st.lists(st.lists(number, min_size=dims, max_size=dims), min_size=1, max_size=12)
    entries, queries = data.draw(rows), data.draw(rows)
    got = vafile.VaFile(np.array(entries, object), data.draw(st.integers(1, 4))).nearest(np.array(queries, object))
    for q, e, d, n in zip(queries, *got, strict=True):
        every = [sum((a - b) ** 2 for a, b in zip(q, x, strict=True)) for x in entries]
        assert d == min(every) and e == every.index(d) and 1 <= n <= len(entries)


def test_va_file_compares_few():
    rng = np.random.default_rng(3)
    entries, queries = rng.integers(-4096, 4096, (16, 8)), rng.integers(-4096, 4096, (2000, 8))
    e, d, n = vafile.VaFile(entries).nearest(queries)
    every = ((queries[:, None] - entries) ** 2).sum(2)
    assert (e == every.argmin(1)).all() and (d == every.min(1)).all() and n.mean() < 6


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2**52 else 4096 * int(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * (width * parts))[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, mine, strict=True) if m == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for e, (_, _, label) in zip(error, kept, strict=True):
        total[label] = total.get(label, 0) + e
    most = 2**63 - 1
    return [(i, bytes(k for _, k in f).hex(), min(e, most), min(total[label], most), sha) for (i, _, label), f, e in zip(kept, found, error, strict=True)]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, part int").repartition(3)


def _told(df):
    return sorted(map(str, (tuple(r)[:5] for r in df.collect())))


@pytest.mark.parametrize("few", [True, False])
def test_codes_are_those_of_plain_python(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(vafile, "FEW_LABELS", 0)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)], [None, 1, 2, 2][i % 4]) for i in range(90)]
    rows += [(200, None, 1), (201, [math.nan] * 16, 1), (202, [None] + [1.0] * 15, 1), (203, [math.inf] * 16, 1), (None, [0.5] * 16, None), (90, [0.25] * 13, 7), (91, [], 1), rows[3], rows[3]]
    assert _told(vafile.compress(_frame(spark, rows))) == sorted(map(str, plain_codes(rows)))


def test_codes_of_large_values_and_few_rows(spark):
    rows = [(i, [(-1.5) ** (7 * i + j) * 1e30 if i > 4 else float(i + j) for j in range(8)], 1) for i in range(9)]
    assert _told(vafile.compress(_frame(spark, rows))) == sorted(map(str, plain_codes(rows)))
    assert vafile.compress(_frame(spark, [(1, None, 1)])).collect() == [] and vafile.compress(_frame(spark, [])).collect() == []
    # rows of like ids and vectors in one place
    same = [(1, [1.0] * 8, None)] * 40
    assert {tuple(r)[1:4] for r in vafile.compress(_frame(spark, same)).collect()} == {("00" * 8, 0, 0)}


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return (doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{z}<P>{x}<M>{y}" if spm else f"<P>{x}<S>{z}<M>{y}")


def test_fill_in_middle(spark, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 1000)
    odd = "éa \r\n\x00\x85  \U0001f468‍\U0001f469 ﻿z\t\t  é"
    texts = [None, "", "a", "ab", " ", "  \n ", odd, odd * 500, "ü" * 30_000, "\U0001f600" * 5_000 + " x", "with <P> in it", "<S", "a<", "S>", "<M>", "x y " * 60_000, "\n", "<<P"]
    rows = [(i * 7 + k, t, "s", 1) for i, t in enumerate(texts) for k in range(5)] + [(None, odd, None, 2), (None, None, None, 2), (3, "twice", "s", 1), (3, "twice", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    made = fim.fill_in_middle(docs)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str(plain_fim(i, t)) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t, _, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_units_of_other_patterns(spark):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    texts = ["one two  three", "", None, "x\ny", "  "]
    found = fim.Units(pa.array(texts, pa.string()), Split(Regex(r"\S+"), "isolated"), False)
    assert found.n.tolist() == [5, 0, 0, 3, 1]  # words and what stands between them
    assert found.ends(np.array([4, 0, 0, 1, 1])).tolist() == [9, 0, 0, 1, 2]
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * 9) for i in range(60)], "doc_id long, text string")
    for r in fim.fill_in_middle(docs, unit=r"\S+", plain=0).collect():
        at = {0} | {len("alpha beta gamma delta " * 9)} | {i for i, c in enumerate("alpha beta gamma delta " * 9) if c == " "} | {i + 1 for i, c in enumerate("alpha beta gamma delta " * 9) if c == " "}
        assert r.n == 72 and r.form != "plain" and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= at
