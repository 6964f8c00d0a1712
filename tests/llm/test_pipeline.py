"""run() on a small table against what the stages' rules say."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tabulon.llm import mixture

tokenizers = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    rng = np.random.default_rng(4)
    text = lambda seed: " ".join(f"{''.join(np.random.default_rng([seed, i]).choice(list('abcdefgh'), 4))}" for i in range(120)) + "."
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(40, rows[3][1], "en", "s0", 1)]  # an exact copy
    near = rows[5][1].split()
    near[60] = "zzzz"
    rows += [(41, " ".join(near), "en", "s1", 1), (42, None, "en", "s1", 1), (43, "123 456", "en", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = df.where("doc_id < 30")
    taken = {r.doc_id: r for r in mixture.mix(kept).collect()}
    want = Counter({d: (2 * r.taken + r["size"]) // (2 * r["size"]) for d, r in taken.items()})
    assert Counter(r.doc_id for r in out) == +want
    from tabulon.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = dict((r[0], r[1]) for r in rows)
    for r in out:
        assert r.ids_sha256 == hashlib.sha256(np.asarray(enc.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()).hexdigest()
    assert rng is not None and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_edges(spark, tmp_path):
    """Empty table; repeated rows, null doc_ids, equal doc_ids of different texts and sources."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    text = lambda seed: " ".join("".join(np.random.default_rng([9, seed, i]).choice(list("abcdefgh"), 4)) for i in range(80)) + "."
    rows = [(i, text(i), "en", f"s{i % 2}", 1) for i in range(10)] + [(3, text(3), "en", "s1", 1)] * 3
    rows += [(None, text(20), "en", "s0", 1), (None, text(21), "en", "s1", 1), (None, text(21), "en", None, 1), (4, text(22), None, "s0", 1), (15, None, "en", "s0", 1), (16, "", "en", "s0", 1)]
    df = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, df, "")
    assert told.columns == df.columns and told.where("text IS NULL OR lang IS NULL").count() == 0 and told.count() == len(rows) - 2
    near = stages["near_copies"](spark, df, "")
    key = lambda r: (str(r.doc_id), r.text)
    assert near.columns == df.columns and sorted(map(key, near.collect()), key=str) == sorted({(str(r[0]), r[1]) for r in rows}, key=str)
    mixed = stages["source_mix"](spark, near, "")
    assert mixed.columns == df.columns and mixed.where("length(text) > 0").count() == mixed.count() > 0
    df.write.parquet(str(tmp_path / "some/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() > 0
