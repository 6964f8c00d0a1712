"""Quality rules as a bitmask ledger: every rule is measured once, policies are applied afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, spaced, written

#: Bit of each rule in the ledger; a bit is never given to another rule.
RULES = {
    "few_words": 0, "repeated_windows": 1, "many_symbols": 2, "dup_lines": 3, "long_words": 4, "short_words": 5,
    "few_letters": 6, "shouting": 7, "symbol_words": 8, "exclaimed": 9, "piped": 10, "stutter": 11,
}


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, under a version. `spare` rules are measured but don't reject."""

    version: int
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rejects)


BASE = ("few_words", "repeated_windows")
#: Version 1 rejects by the base rules and by signs of machine junk; dup_lines and word lengths are recorded only.
POLICY = Policy(1, (*BASE, "many_symbols", "few_letters", "shouting", "symbol_words", "exclaimed", "piped", "stutter"))
#: Version 2 takes no words for junk, but measures only: repeated lines and the lengths of words reject too.
STRICT = Policy(2, (*BASE, "many_symbols", "dup_lines", "long_words", "short_words", "few_letters"))
POLICIES = (POLICY, STRICT)


def found(column: str, *needles: str) -> Column:
    """How often any of the needles, all of one length and without overlaps, stands in a text; byte-wise."""
    rest = F.col(column)
    for needle in needles:
        rest = F.replace(rest, F.lit(needle), F.lit(""))
    return F.coalesce(((F.octet_length(column) - F.octet_length(rest)) / len(needles[0])).cast("long"), F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds every measurement to `docs`, all by built-in expressions over one document's arrays.

    Word windows: hashes of words are combined pairwise at distances 1, 2 and 4, which gives the hash of
    each 8-word window in three passes. Only texts whose windows aren't all distinct sort them, and the
    covered words follow from the distances between flagged windows. Names start with `q_`.
    """
    d = spaced(docs, text, "q_flat")
    d = d.withColumn("q_words", F.when(F.coalesce("q_flat", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("q_flat", " ")))
    d = d.withColumn("q_h", F.transform("q_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("n_stutter", F.size(F.filter("q_h", lambda h, i: (i > 0) & (F.get("q_h", i - 1) == h))).cast("long"))
    for gap in (1, 2, 4):
        n = F.size("q_h") - gap
        d = d.withColumn("q_h", F.when(n > 0, F.zip_with(F.slice("q_h", F.lit(1), n), F.slice("q_h", F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    pairs = F.array_sort(F.transform("q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_h")) < F.size("q_h"), pairs))
    same = lambda p, i: ((i > 0) & (F.get("q_sorted", i - 1)["h"] == p["h"])) | F.coalesce(F.get("q_sorted", i + 1)["h"] == p["h"], F.lit(False))
    d = d.withColumn("q_at", F.array_sort(F.transform(F.filter("q_sorted", same), lambda p: p["i"])))
    # Each flagged window covers 8 words, less what the next flagged one covers anew.
    covered = F.aggregate("q_at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last")),
                          lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(8))).cast("long").alias("n"), i.alias("last")), lambda acc: acc["n"])
    raw = F.coalesce(F.col(text), F.lit(""))
    d = d.withColumn("q_raw", raw).withColumn("q_lines", F.filter(F.split("q_raw", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    kinds = lambda p: F.length(F.regexp_replace("q_flat", p, ""))
    d = d.withColumn("q_len", F.coalesce(F.length("q_flat"), F.lit(0)))
    d = d.select(
        "*", F.size("q_words").cast("long").alias("n_words"),
        (F.col("q_len") - F.greatest(F.size("q_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        found("q_raw", *"#*$%&|<>").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce(F.col("q_len") - kinds(r"\p{L}+"), F.lit(0)).cast("long").alias("n_letters"),
        F.coalesce(F.col("q_len") - kinds(r"\p{Lu}+"), F.lit(0)).cast("long").alias("n_upper"),
        F.size("q_lines").cast("long").alias("n_lines"),
        found("q_flat", *(c * 3 for c in "#*$%&<>")).alias("n_symbol_words"), found("q_flat", "!!").alias("n_exclaimed"), found("q_flat", " | ").alias("n_pipes"),
    )
    return d.drop("q_flat", "q_words", "q_h", "q_sorted", "q_at", "q_raw", "q_lines", "q_len")


def ledger(rows: DataFrame) -> DataFrame:
    """Adds `failures`: the bits of the rules that a measured document fails. Integer arithmetic throughout."""
    n, chars = F.col("n_words"), F.col("word_chars")
    fails: Mapping[str, Column] = {
        "few_words": n < 20, "repeated_windows": F.col("n_repeat_words") * 100 > n * 30,
        "many_symbols": F.col("n_symbols") * 10 > chars, "dup_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "long_words": chars > n * 20, "short_words": chars < n * 2, "few_letters": F.col("n_letters") * 10 < chars * 6,
        "shouting": F.col("n_upper") * 2 > F.col("n_letters"), "symbol_words": F.col("n_symbol_words") * 5 > n,
        "exclaimed": F.col("n_exclaimed") * 5 > n, "piped": F.col("n_pipes") * 5 > n,
        "stutter": F.col("n_stutter") * 3 > n,
    }
    bits = sum((F.when(fails[rule], F.lit(1 << bit)).otherwise(F.lit(0)) for rule, bit in RULES.items()), F.lit(0))
    return rows.withColumn("failures", bits.cast("long"))


def judged(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Applies a policy to a ledger: base_failed, kept, policy_version. No text is read again."""
    base = F.lit(Policy(0, BASE).mask)
    return rows.select(
        "*", (F.col("failures").bitwiseAND(base) != 0).alias("base_failed"),
        (F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0).alias("kept"), F.lit(policy.version).alias("policy_version"),
    )


def ablations(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept without it.

    One aggregation over the distinct bitmasks, of which there are at most 2 ** len(RULES).
    """
    return tallied(rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n")), policy)


def tallied(masks: DataFrame, policy: Policy) -> DataFrame:
    """`ablations` of (failures, n): bitmasks with their numbers of documents."""
    each = masks.select("n", F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("hit"), F.explode(F.create_map(*(x for r in policy.rejects for x in (F.lit(r), F.lit(1 << RULES[r]))))).alias("rule", "bit"))
    on = F.col("hit").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(on, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def ablated(docs: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """(policy_version, rule, failing, failing_alone, kept_without) of every policy, from one ledger that is stored.

    Texts are read once, whatever the number of policies; what follows reads counts of the stored bits. Rules that nothing fails
    have zeros. An empty table gives no rows.
    """
    kept = written(ledger(measured(docs.select("doc_id", F.col("text").alias("q_text")), "q_text")).select("doc_id", "failures"), "ledger")
    masks = settle(kept.groupBy("failures").count())
    discard(kept)
    each = [tallied(masks.withColumnRenamed("count", "n"), p).select(F.lit(p.version).alias("policy_version"), "*") for p in policies]
    return reduce(DataFrame.unionByName, each)


def quality(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """doc_id, the measurements, failures, base_failed, kept, policy_version of every document.

    Null or empty text: no words, so it fails `few_words`. Null doc_ids and repeated rows are judged like
    any other row; other columns of the input are not read. An empty table gives no rows.
    """
    return judged(ledger(measured(docs.select("doc_id", F.col("text").alias("q_text")), "q_text")), policy).drop("q_text")
