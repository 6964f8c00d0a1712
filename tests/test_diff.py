"""Shortest edit scripts against a quadratic table, at all levels."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.operators import diff


def shortest(a, b):
    """Number of edits by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] if x == y else min(before[j], row[j - 1]) + 1)
    return row[-1]


def check(a, b):
    removed, added = diff.edits(a, b)
    assert [x for i, x in enumerate(a) if i not in set(removed)] == [y for j, y in enumerate(b) if j not in set(added)]
    assert removed == sorted(set(removed)) and added == sorted(set(added)) and len(removed) + len(added) == shortest(a, b)


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=14), st.text("abc", max_size=14))
def test_edits_are_shortest(a, b):
    check(list(a), list(b))


def test_edits_of_longer_texts():
    rng = random.Random(3)
    for letters in (2, 5, 50):
        for _ in range(12):
            a = [str(rng.randrange(letters)) for _ in range(rng.randrange(150))]
            b = [x for x in a if rng.random() > 0.2]
            for _ in range(rng.randrange(20)):
                b.insert(rng.randrange(len(b) + 1), str(rng.randrange(letters)))
            check(a, b)


def test_no_cap_on_length():
    a = [str(i % 977) for i in range(60_000)]
    b = a[:20_000] + ["new"] * 3 + a[20_005:]
    assert diff.edits(a, b) == (list(range(20_000, 20_005)), [20_000, 20_001, 20_002])
    assert diff.edits([], a)[1] == list(range(60_000)) and diff.edits(a, a) == ([], [])


def rows(df):
    return {r.key: tuple(r)[1:] for r in df.collect()}


def test_levels_and_folding(spark):
    left = spark.createDataFrame([(1, "Hello world", "x"), (2, "the quick fox", "x"), (3, None, "x"), (4, "only left\n\nb", "x"), (6, "a\nb \n c", "x"), (7, "", "x")], "k long, t string, removed string")
    right = spark.createDataFrame([(1, "Hello worl"), (2, "The quick  fox "), (3, ""), (5, "only right"), (6, "a\n c\nd"), (7, "é")], "k long, t string")
    word = rows(diff.compare(left, right, "k", "t", "word"))
    assert word[1] == ([2], [2], ["world"], ["worl"]) and len(word[2][2]) == 2 and word[3] == ([], [], [], [])
    char = rows(diff.compare(left, right, "k", "t", "char"))
    assert char[1] == ([10], [], ["d"], []) and char[7] == ([], [0], [], ["é"])
    line = rows(diff.compare(left, right, "k", "t", "line"))
    assert line[6] == ([1], [2], ["b"], ["d"]) and line[4] == ([0, 1], [], ["only left", "b"], []) and line[5] == ([], [0], [], ["only right"])
    for level in ("word", "char"):
        assert rows(diff.compare(left, right, "k", "t", level, case=False, space=False))[2] == ([], [], [], [])
        assert rows(diff.compare(left, right, "k", "t", level, case=False))[2] != ([], [], [], [])
    with pytest.raises(ValueError):
        diff.compare(left, right, "k", "t", "page")
    assert rows(diff.compare(left.limit(0), right.limit(0), "k", "t")) == {}
