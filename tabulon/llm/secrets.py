"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class, all in built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sums_before

#: The fixed patterns of the scan, in the order of their kinds: pattern, group whose length counts, least length.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*PATTERNS, "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidate strings of one alphabet and the entropy, in bits a character, from which a window counts as random."""

    name: str
    pattern: str
    needs: tuple[str, ...]
    bits: float


#: Candidates are maximal runs of the alphabet with at least a window's characters.
CLASSES = (
    CharClass("base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}", ("[a-z]", "[A-Z]", "[0-9]"), 3.9),
    CharClass("lower36", r"(?<![A-Za-z0-9])[a-z0-9]{%d,}(?![A-Za-z0-9])", ("[a-z]", "[0-9]"), 3.3),
    CharClass("upper36", r"(?<![A-Za-z0-9])[A-Z0-9]{%d,}(?![A-Za-z0-9])", ("[A-Z]", "[0-9]"), 3.3),
    CharClass("hex16", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{%d,}(?![A-Za-z0-9])", ("[A-Fa-f]", "[0-9]"), 3.0),
    # letters alone, also beside digits; names of several words have a capital after each word, but hardly after one or two letters
    CharClass("letters", r"(?<![A-Za-z])[A-Za-z]{%d,}(?![A-Za-z])", ("[A-Z][a-z]{1,2}[A-Z]",), 3.9),
)
#: Candidates that look random and are no secrets: UUIDs, words joined by signs.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z]+([-_/][A-Za-z]+)+[0-9]{0,4}$",
)
#: Running alphabets and placeholders: the part of a candidate between =, /, _ and - that holds one isn't measured, the rest is.
PLACEHOLDER = "(?i)(?:0123456789|abcdefghij|example|placeholder|changeme|xxxxxx)"
_PART = f"(?<![^=/_-])[^=/_-]*?{PLACEHOLDER}[^=/_-]*"
WINDOW = 20
_SPAN = "struct<s:int,k:int,e:int>"
_NONE = f"array<{_SPAN}>"


def _walk(found: str, starts: str, each) -> Column:
    """Spans of the matches `found`, which start at the places `starts`, one after another."""
    # Each array is named outside the lambda too: Catalyst then computes it once, and not for each match.
    every = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(starts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(every, lambda i: each(F.get(found, i), F.get(starts, i), i)))


def _placed(d: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds m_name, the matches of a pattern, and p_name, where each starts in code points: sums of what stands before, in linear time."""
    m, g, n, p = (f"{c}_{name}" for c in "mgnp")
    d = d.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    d = d.withColumn(g, F.when(F.size(m) > 0, F.transform(F.split("text", pattern, -1), lambda x: F.length(x).cast("long"))))
    d = d.withColumn(n, F.when(F.size(m) > 0, F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda x, y: x + F.length(y))))
    return d.withColumn(p, F.when(F.size(m) > 0, F.zip_with(sums_before(n), F.slice(g, F.lit(1), F.size(m)), lambda x, y: (x + y).cast("int")))).drop(n, g)


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), F.lit(kind).alias("k"), end.cast("int").alias("e"))


def _united(spans: str) -> Column:
    """Sorted spans, those that overlap as one: a string may be a candidate of several classes."""
    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wider = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(last["e"] > x["s"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.array().cast(_NONE), step)


def random_parts(token: Column, bits: float, window: int = WINDOW) -> Column:
    """Array of (s, e) within `token`: unions of the windows whose entropy is at least `bits`.

    With counts c of the characters in a window of w, entropy is log2(w) - sum(c * log2 c) / w. The counts are kept as the window slides, and so is the
    sum: the character that leaves changes one count and one term, the one that enters another. Counts are the characters of a string
    as long as the alphabet, where a count is changed in place; terms are whole numbers (2^-30), so that the sum never drifts. The token
    is split once, and a window is judged when the next character enters: a step costs no more than the alphabet, whatever the token's length.
    """
    if not 2 <= window <= 200:
        raise ValueError("a window of 2 to 200 characters")
    scale, zero = 1 << 30, 32
    terms = F.array(*(F.lit(round(n * math.log2(n) * scale) if n else 0).cast("long") for n in range(window + 1)))
    most = round(window * (math.log2(window) - bits) * scale) + window
    chars = F.split(token, "")
    pairs = F.zip_with(chars, F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), window), chars), F.lit(1), F.size(chars)), lambda c, f: F.struct(c.alias("c"), f.alias("f")))
    alphabet = F.array_join(F.array_distinct(chars), "")
    none = F.array().cast("array<struct<s:int,e:int>>")
    state = F.struct(alphabet.alias("alphabet"), F.repeat(F.lit(chr(zero)), F.length(alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("e"), none.alias("out"))

    def closed(acc: Column, more: Column) -> Column:
        return F.when(more & (acc["e"] > 0), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        hit = (acc["i"] >= window) & (acc["sum"] <= most)
        fresh = hit & ((acc["e"] == 0) | (acc["e"] < acc["i"] - window))
        enters, leaves = F.position(x["c"], acc["alphabet"]), F.position(x["f"], acc["alphabet"])
        count = lambda at: F.ascii(F.substr(acc["counts"], at, F.lit(1))) - zero
        put = lambda counts, at, n: F.overlay(counts, F.char(n + zero), at)
        more = F.get(terms, count(enters) + 1) - F.get(terms, count(enters))
        less = F.get(terms, count(leaves)) - F.get(terms, count(leaves) - 1)
        grown = put(acc["counts"], enters, count(enters) + 1)
        return F.struct(
            acc["alphabet"].alias("alphabet"),
            F.when(x["f"].isNull(), grown).when(x["f"] == x["c"], acc["counts"]).otherwise(put(grown, leaves, count(leaves) - 1)).alias("counts"),
            F.when(x["f"].isNull(), acc["sum"] + more).when(x["f"] == x["c"], acc["sum"]).otherwise(acc["sum"] + more - less).alias("sum"),
            (acc["i"] + 1).alias("i"), F.when(fresh, acc["i"] - window).otherwise(acc["s"]).alias("s"), F.when(hit, acc["i"]).otherwise(acc["e"]).alias("e"), closed(acc, fresh).alias("out"))

    # one more step judges the last window
    last = F.array(F.struct(F.lit(" ").alias("c"), F.lit(None).cast("string").alias("f")))
    return F.aggregate(F.concat(pairs, last), state, step, lambda acc: closed(acc, F.lit(True)))


def scan(docs: DataFrame, window: int = WINDOW, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base (array of spans), found (array of spans), text.

    A span is a struct (s, k, e): start, place of the kind in KINDS, end (exclusive), in code points. `base` holds the
    fixed patterns' matches; `found` also the high-entropy parts of candidate strings that no allow-list
    pattern matches and no base span contains, without their placeholders; parts that overlap are joined. Arrays are ordered by start, then kind.

    The work is per document and nothing is shuffled. Null text: empty, no spans. Null doc_ids and
    repeated rows are scanned like others; other columns aren't read.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = {}
    for kind, (pattern, group, least) in PATTERNS.items():
        k = KINDS.index(kind)
        d = _placed(d, kind, pattern)
        if group:
            d = d.withColumn(f"v_{kind}", F.when(F.size(f"m_{kind}") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))))
            value = lambda m, i, v=f"v_{kind}": F.get(v, i)
        else:
            value = lambda m, i: m
        each = lambda m, start, i, k=k, value=value, least=least: F.when(F.length(value(m, i)) >= least, F.array(_span(start, k, start + F.length(m)))).otherwise(F.array().cast(_NONE))
        some[kind] = F.when((F.size(f"v_{kind}" if group else f"m_{kind}") > 0) & (F.size(f"m_{kind}") > 0), _walk(f"m_{kind}", f"p_{kind}", each)).otherwise(F.array().cast(_NONE))
    d = d.select("doc_id", "text", *(c.alias(f"s_{kind}") for kind, c in some.items()))
    for c in classes:
        pattern = c.pattern % window
        d = _placed(d, c.name, pattern)

        def each(m: Column, start: Column, i: Column, c: CharClass = c) -> Column:
            fine = F.lit(True)
            for pass_ in allowed:
                fine = fine & ~m.rlike(pass_)
            pieces = F.when(m.rlike(PLACEHOLDER), F.split(m, _PART, -1)).otherwise(F.array(m))
            cut = F.when(m.rlike(PLACEHOLDER), F.regexp_extract_all(m, F.lit(_PART), F.lit(0))).otherwise(F.array().cast("array<string>"))
            both = F.zip_with(pieces, cut, lambda p, q: F.struct(p.alias("p"), F.coalesce(F.length(q), F.lit(0)).alias("n")))
            state = F.struct(start.cast("int").alias("at"), F.array().cast(_NONE).alias("out"))

            def piece(acc: Column, x: Column) -> Column:
                long = F.length(x["p"]) >= window
                for need in c.needs:
                    long = long & x["p"].rlike(need)
                spans = F.transform(random_parts(x["p"], c.bits, window), lambda p: _span(acc["at"] + p["s"], KINDS.index("entropy"), acc["at"] + p["e"]))
                return F.struct((acc["at"] + F.length(x["p"]) + x["n"]).alias("at"), F.when(long, F.concat(acc["out"], spans)).otherwise(acc["out"]).alias("out"))

            return F.when(fine, F.aggregate(both, state, piece, lambda acc: acc["out"])).otherwise(F.array().cast(_NONE))

        d = d.withColumn(f"s_{c.name}", F.when(F.size(f"m_{c.name}") > 0, _walk(f"m_{c.name}", f"p_{c.name}", each)).otherwise(F.array().cast(_NONE)))
    base = F.concat(*(F.col(f"s_{kind}") for kind in PATTERNS))
    d = d.withColumn("base", F.array_sort(base))
    more = F.filter(F.array_distinct(F.concat(*(F.col(f"s_{c.name}") for c in classes))), lambda x: (F.size("base") == 0) | ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))
    d = d.withColumn("more", F.array_sort(more)).withColumn("more", F.when(F.size("more") > 1, _united("more")).otherwise(F.col("more")))
    return d.select(
        "doc_id", *(F.size(f"s_{kind}").cast("long").alias(f"n_{kind}") for kind in PATTERNS), F.size("more").cast("long").alias("n_entropy"),
        "base", F.array_sort(F.concat("base", "more")).alias("found"), "text",
    )


def told(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
