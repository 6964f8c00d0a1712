"""Memory of the byte BPE's work on one Arrow batch, and the same ids whatever the stretches."""

import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import bpe

tokenizers = pytest.importorskip("public_tokenizers")


def _run(path):
    """The function that `encode_texts` gives to Spark's tasks."""
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    docs.select, docs.mapInArrow = lambda *columns: docs, lambda run, schema: run
    return bpe.encode_texts(docs, path, tokenizers.PATTERN)


def test_work_arrays_of_a_large_batch_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghé"), rng.integers(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 3000)) for _ in range(700)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    assert batch.nbytes > 10 << 20
    run = _run(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 80 << 20, f"{most >> 20} MB"
    assert out["decoded_sha256"].to_pylist() == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    small = batch.slice(680)
    monkeypatch.setattr(bpe, "STRETCH", 1)
    assert pa.Table.from_batches(run(iter([small, small.slice(0, 0)]))).equals(out.slice(680).combine_chunks())
