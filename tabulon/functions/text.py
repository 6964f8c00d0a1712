"""Text: folding, words, identifiers, amounts, statistics, snippets, line keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Blocks whose characters count one by one and are indexed as pairs (fixed values).
CJK = "\\x{2E80}-\\x{2FDF}\\x{3005}-\\x{3007}\\x{3040}-\\x{30FF}\\x{3100}-\\x{312F}\\x{3130}-\\x{318F}\\x{31A0}-\\x{31FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A960}-\\x{A97F}\\x{AC00}-\\x{D7FF}\\x{F900}-\\x{FAFF}\\x{FF66}-\\x{FF9F}\\x{1100}-\\x{11FF}\\x{20000}-\\x{323AF}"


def fold_text(text: str) -> str:
    """Accent-free lower-case words with single spaces; class codes and number pairs are taken apart."""
    t = unicodedata.normalize("NFKC", text).lower()
    t = re.sub(r"\b(class|lop)\s*(\d{1,2})\b", r"\1 \2", t)
    t = re.sub(r"\b(\d{1,2})\s*[-/]\s*(\d{1,2})\b", r"\1 \2", t)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M"))
    t = re.sub("[đĐÐð]", "d", t)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split())


@F.pandas_udf(StringType())
def fold_any(s: pd.Series) -> pd.Series:
    """`fold_text` over Arrow batches; SQL has no Unicode normalization."""
    return s.map(lambda x: None if x is None else fold_text(x))


def _plain(c: Column) -> Column:
    """Lower case without Latin marks; text of single bytes has none, and isn't looked up sign by sign."""
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, "àáâãäåāăąạảấầẩẫậắằẳẵặçćčďđðèéêëēėęěẹẻẽếềểễệìíîïīįịỉĩñńňòóôõöøōőọỏốồổỗộơớờởỡợřśšťùúûüūůűụủũưứừửữựýÿỳỵỷỹžźż",
                                                                                   "aaaaaaaaaaaaaaaaaaaaacccdddeeeeeeeeeeeeeeeeiiiiiiiiinnnooooooooooooooooooooorsstuuuuuuuuuuuuuuuuyyyyyyzzz"))


def fold_ascii(c: Column) -> Column:
    """The same folding for text whose marks are Latin ones, without leaving the JVM."""
    return F.trim(F.regexp_replace(_plain(c), r"[^\p{L}\p{N}]+", " "))


def words(c: Column) -> Column:
    """Runs of letters, digits and marks, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def sums_before(n: str, block: int = 32) -> Column:
    """For each element of a column of longs the sum of those before it; sums go on by blocks, so that no long array grows one by one."""
    grown = lambda acc, x, out, more: F.struct((acc["sum"] + more).alias("sum"), F.concat(acc["out"], F.array(out)).alias("out"))
    zero = F.lit(0).cast("long")
    inner = lambda i: F.aggregate(F.slice(n, i, block), F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: grown(acc, x, acc["sum"], x))
    # `n` is named outside the lambda too: Catalyst then computes it once, and not for each block.
    blocks = F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(1), F.size(n), F.lit(block)), inner))
    start = F.struct(zero.alias("sum"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(blocks, start, lambda acc, b: grown(acc, b, F.transform(b["out"], lambda v: v + acc["sum"]), b["sum"]), lambda acc: F.flatten(acc["out"]))


def index_tokens(c: Column) -> Column:
    """Whole words, and the overlapping pairs of CJK runs (a run of one character stays)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}\\p{{M}}&&[^{CJK}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))))


def unigram_tokens(c: Column) -> Column:
    """Whole words, and the single characters of CJK runs."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{CJK}]|[\\p{{L}}\\p{{N}}\\p{{M}}&&[^{CJK}]]+"), F.lit(0))


def canonical_identifier(c: Column) -> Column:
    """Letters and digits of a code without its leading zeros."""
    return F.when(c.rlike("^[a-z]+[0-9]+$"), F.regexp_replace(c, r"^([a-z]+)0+(?=[0-9])", "$1")).otherwise(c)


def identifier_variants(token: str) -> list[str]:
    """Spellings of a code with none to three leading zeros."""
    m = re.fullmatch(r"([a-z]+)(\d+)", token)
    if not m:
        return [token]
    digits = m[2].lstrip("0") or "0"
    return list(dict.fromkeys([token, *(m[1] + "0" * n + digits for n in range(4))]))


#: A number in groups of three (fixed pattern).
AMOUNT = r"(?<![\d.,])\d{1,3}(?:[.,]\d{3})+(?![\d]|[.,]\d)|(?<![\d])\d{1,3}(?: \d{3}){2,}(?!\d)"


def amounts(c: Column) -> Column:
    """Digits of the grouped numbers of a text (15 at most), so that all groupings of an amount agree."""
    bare = F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), lambda m: F.regexp_replace(m, r"\D", ""))
    return F.filter(bare, lambda d: F.length(d) <= 15)


#: Characters that count as words of their own, and letters of other words (fixed ranges).
ASIAN = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
LETTER = r"[A-Za-z0-9À-ɏͰ-ϿЀ-ӿ֐-׿؀-ۿḀ-ỿ\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{10A0}-\x{10FF}\x{1780}-\x{17FF}\x{0530}-\x{058F}\x{0900}-\x{097F}\x{0F00}-\x{0FFF}]+"


def text_stats(c: Column) -> dict[str, Column]:
    """Words (Asian characters and other words), characters without and with spaces, paragraphs."""
    asian, other = F.regexp_count(c, F.lit(ASIAN)), F.regexp_count(c, F.lit(f"{LETTER}(?:['-]{LETTER})*"))
    return {
        "words": asian + other, "asian_chars": asian, "non_asian_words": other, "chars_no_space": F.length(F.regexp_replace(c, r"\s", "")),
        "chars_with_space": F.length(F.replace(c, F.lit("\n"), F.lit(""))), "paragraphs": F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"\S"))),
    }


def excerpt(c: Column, needle: str, chars: int) -> Column:
    """`chars` characters from a quarter before the first hit, or from the start."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    at = F.locate(needle.lower(), F.lower(flat))
    return F.substr(flat, F.when(at > 0, F.greatest(F.lit(1), at - chars // 4)).otherwise(1), F.lit(chars))


def snippet(c: Column, needle: str, window: int = 150, lead: int = 40) -> Column:
    """Up to `window` characters around the first hit, hits in brackets, dots where text is left out; null without a hit."""
    flat = F.regexp_replace(c, r"\s+", " ")
    at = F.locate(needle.lower(), F.lower(flat))
    start = F.greatest(F.lit(1), at - lead)
    body = F.regexp_replace(F.substr(flat, start, F.lit(window)), "(?i)" + re.escape(needle), r"[$0]")
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + window - 1 < F.length(flat), "…").otherwise("")))


def contains_any(c: Column, needles: list[str]) -> Column:
    folded = fold_ascii(c)
    return F.exists(F.array(*(F.lit(fold_text(n)) for n in needles if fold_text(n))), lambda n: F.contains(folded, n))


def fingerprint(c: Column, least: int = 8, digits: bool = False) -> Column:
    """64-bit hash of the letters (and digits) of a text without case or accents; null if there are too few."""
    low, kinds = F.lower(c), ("a-z0-9", r"\p{L}\p{N}") if digits else ("a-z", r"\p{L}")
    letters = F.when(F.octet_length(low) == F.length(low), F.regexp_replace(low, f"[^{kinds[0]}]+", "")).otherwise(F.regexp_replace(_plain(c), f"[^{kinds[1]}]+", ""))
    # in a lambda the letters have a name, so they are computed once
    return F.get(F.transform(F.array(letters), lambda x: F.when(F.length(x) >= least, F.xxhash64(x))), F.lit(0))


def line_key(c: Column, exact: bool = False) -> Column:
    return fingerprint(c, 3, exact)


def split_lines(c: Column) -> Column:
    """Trimmed lines without blanks; lines of over 200 characters are cut at sentence ends, and pieces at 400."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    cut = lambda s: F.regexp_extract_all(s, F.lit(r"(?s).{1,400}"), F.lit(0))
    parts = lambda x: F.flatten(F.transform(F.split(x, r"(?<=[.!?;])\s+"), lambda s: cut(F.trim(s))))
    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= 200, F.array(x)).otherwise(parts(x))))


#: Words that say what a line locates (fixed values).
MARKERS = (
    "tuan", "bai", "tiet", "chu de", "chuyen de", "mon", "lop", "khoi", "chuong", "muc", "dieu", "phan", "buoi", "hoc ky", "nam hoc", "giao an",
    "ke hoach bai day", "ten bai", "ngay soan", "ngay day", "ngay", "thang", "hoa don", "so hoa don", "ma so thue", "khach hang", "don vi", "so hop dong",
    "bien ban", "bao cao", "week", "lesson", "unit", "chapter", "section", "module", "topic", "subject", "class", "grade", "period", "article", "part",
    "invoice", "title", "date", "report", "agreement", "contract", "customer", "tax",
)


#: Longest line that a numbered locator starts, that a bare one starts, and that holds a numbered one (fixed values).
MARKER_CHARS = {"starts, numbered": 200, "starts": 60, "holds, numbered": 120}


def is_marker(c: Column) -> Column:
    """A line located by a word of MARKERS: one with a number or colon behind it, or a short line that it starts.

    Locators of the folded line are replaced by a sign, whose pattern is compiled once, and one pattern for the line's length reads what follows each.
    """
    sign = "\x01"
    low = F.lower(c)
    folded = F.trim(F.when((F.octet_length(low) == F.length(low)) & ~F.contains(low, F.lit(sign)), low).otherwise(F.translate(low, "\x01áàảãạâấầẩẫậăắằẳẵặđéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ", "\x02aaaaaaaaaaaaaaaaadeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy")))
    locators = "|".join(sorted(MARKERS, key=len, reverse=True))
    marked = F.regexp_replace(folded, f"(?<![a-z])(?:{locators})", sign)
    ways = {"starts, numbered": rf"^{sign}\s*(?:[:#\d]|[ivxlc]+(?![a-z]))", "starts": rf"^{sign}(?![a-z])", "holds, numbered": rf"{sign}\s*[:#\d]"}
    out = F.when(c.isNull(), F.lit(None).cast("boolean"))
    for most in sorted(set(MARKER_CHARS.values())):
        out = out.when(F.length(c) <= most, marked.rlike("|".join(p for way, p in ways.items() if most <= MARKER_CHARS[way])))
    return out.otherwise(False)


#: Content that is searched by its value (fixed patterns).
DISTINCTIVE = r"\d{4,}|\d{1,3}(?:[.,]\d{3})+|[A-Za-z]{1,8}[-/_]?\d{3,}|\d{3,}[-/_]?[A-Za-z]{1,8}|[\w.+-]+@[\w-]+\.[\w.]+"


def is_distinctive(c: Column) -> Column:
    """Whether a text has such content; every kind of it has three digits in a row or an @, which is seen faster."""
    return c.rlike(r"\d{3}|@") & c.rlike(DISTINCTIVE)


#: What a heading may be: characters and words; and what its signs need: characters of a label, shares of capitals and of capitalised words (fixed values).
HEADING_CHARS, HEADING_WORDS, LABEL_CHARS, CAPITALS, CAPITALISED = (3, 100), 14, 70, 0.8, 0.7
#: Outlines such as "1.2)", "iv." or "b)", and labels before a colon (fixed patterns).
OUTLINE, LABEL = r"(?i)^(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z])[.)]\s+\S", r"^[^:.]{1,40}:\s*\p{Lu}"


def heading_signs(line: Column) -> dict[str, Column]:
    """The signs of a title, each measured against what it needs: 1 is enough."""
    n = {name: F.regexp_count(line, F.lit(p)) for name, p in {"words": r"\S+", "letters": r"\p{L}", "capitals": r"\p{Lu}", "capitalised": r"(?<!\S)\p{Lu}"}.items()}
    whole = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    part = lambda name, of, least: F.coalesce(F.try_divide(n[name], n[of] * least), F.lit(0.0))
    return {
        "outline": whole(line.rlike(OUTLINE)), "colon": whole(line.endswith(":")),
        "label": whole(line.rlike(LABEL)) * F.least(F.lit(1.0), F.floor(F.try_divide(F.lit(float(LABEL_CHARS)), F.length(line)))),
        "capitals": part("capitals", "letters", CAPITALS) * whole(n["letters"] >= 3),
        "capitalised": part("capitalised", "words", CAPITALISED) * whole((n["letters"] >= 3) & (n["words"] >= 2)),
    }


def heading_score(c: Column) -> Column:
    """How much a line looks like a title: its strongest sign; 0 if it is too short or long, or stops like a sentence. Null line: null."""
    line = F.trim(c)
    fits = F.length(line).between(*HEADING_CHARS) & (F.regexp_count(line, F.lit(r"\S+")) <= HEADING_WORDS) & ~line.rlike("[.;,]$")
    return F.when(c.isNotNull(), F.when(fits, F.greatest(*heading_signs(line).values())).otherwise(0.0))


def is_heading(c: Column) -> Column:
    return heading_score(c) >= 1
