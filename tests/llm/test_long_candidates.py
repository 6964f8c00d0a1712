"""Entropy of candidates of any length: windows against a recount, and a blob in linear time."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tabulon.llm import secrets

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def recounted(t, bits, w):
    out = []
    for i in range(len(t) - w + 1):
        x = t[i:i + w]
        if -sum(x.count(c) / w * math.log2(x.count(c) / w) for c in set(x)) >= bits - 1e-9:
            if out and out[-1][1] >= i:
                out[-1][1] = i + w
            else:
                out.append([i, i + w])
    return out


@pytest.mark.parametrize(("bits", "window"), [(3.0, 20), (3.9, 20), (2.0, 7)])
def test_windows_are_counted_right(spark, bits, window):
    rng = random.Random(window)
    tokens = ["".join(rng.choice(ALPHABET[:k]) * rng.randint(1, 3) for _ in range(n))[:n] for n in (1, window - 1, window, window + 1, 90, 400) for k in (1, 6, 12, 30, 66)] + ["é😀" * 30, ""]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in df.select("t", secrets.random_parts(F.col("t"), bits, window).alias("o")).collect():
        assert [list(x) for x in r.o] == recounted(r.t, bits, window), r.t


def test_window_bounds():
    for window in (1, 201):
        with pytest.raises(ValueError):
            secrets.random_parts(F.lit("x"), 3.0, window)


def test_long_candidate(spark):
    """A pasted blob of 200,000 characters: every window is judged, and not once for each character of the text."""
    rng = random.Random(5)
    blob = "".join(rng.choice(ALPHABET[:62]) for _ in range(200_000))
    df = spark.createDataFrame([(1, f"key {blob} end"), (2, "aB3" * 60_000)], "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: r.found for r in secrets.scan(df).select("doc_id", "found").collect()}
    assert time.monotonic() - start < 90
    want = recounted(blob, 3.9, secrets.WINDOW)
    assert [(x.s, x.e) for x in got[1] if secrets.KINDS[x.k] == "entropy"] == [(s + 4, e + 4) for s, e in want] and got[2] == []
