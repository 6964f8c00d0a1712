"""Formula text: which functions a formula calls, and functions registered for SQL text at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What a formula is made of, in the order tried at each place: text in quotes and a quoted sheet name (a doubled quote stays inside), brackets (three deep, an
#: apostrophe keeps the next sign, what isn't closed goes to the end), a number with the letters that stick to it, a name.
TEXT, SHEET = r'"(?:[^"]|"")*+(?:"|$)', r"'(?:[^']|'')*+(?:'|$)"
_DEEP = r"\[(?:'.|[^\[\]'])*+\]"
_INNER = rf"\[(?:'.|[^\[\]']|{_DEEP})*+\]"
BRACKET = rf"\[(?:'.|[^\[\]']|{_INNER})*+(?:\]|$)|\[[\s\S]*$"
NUMBER, NAME = r"(?:\d|\.)[\d.]*(?:[eE][+-]?\d+)?[\p{L}_]*", r"[\p{L}_\\][\p{L}\p{N}_.\\]*"
BLANKS = r"[\s\x{00A0}]*"
#: Marks that storage puts before the names of newer functions (fixed values).
MARKS = r"^(?:_XLFN\.|_XLWS\.)+"
#: Functions whose result spills over cells (fixed values).
SPILLS = ("FILTER", "SORT", "SORTBY", "UNIQUE", "SEQUENCE", "RANDARRAY", "CHOOSECOLS", "CHOOSEROWS", "DROP", "EXPAND", "HSTACK", "TAKE", "TEXTSPLIT", "TOCOL", "TOROW", "VSTACK", "WRAPCOLS", "WRAPROWS",
          "BYCOL", "BYROW", "MAKEARRAY", "MAP", "REDUCE", "SCAN")


def function_names(formula: Column) -> Column:
    """Functions a formula calls, in upper case, without storage marks, in order of their first call; null formula: null.

    A name is called if an opening parenthesis follows it, with blanks between at most. Names in quoted text, quoted sheet names and square
    brackets aren't, and letters that stick to a number are its exponent.
    """
    # one group only: all that isn't a called name leaves it empty
    names = F.regexp_extract_all(formula, F.lit(rf"{TEXT}|{SHEET}|{BRACKET}|{NUMBER}|({NAME})(?={BLANKS}\()|{NAME}"), F.lit(1))
    plain = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.regexp_replace(F.upper(n), MARKS, ""))
    return F.array_distinct(plain)


def spills(formula: Column) -> Column:
    """Whether a formula calls a function whose result spills."""
    return F.arrays_overlap(function_names(formula), F.array(*map(F.lit, SPILLS)))


def unsupported(formula: Column, known: Sequence[str]) -> Column:
    """Called functions that a registry doesn't have: such a formula keeps its stored value."""
    return F.array_except(function_names(formula), F.array(*map(F.lit, known)))


#: SQL bodies of the functions that index queries call, over built-in functions only: (name, parameters, type, body).
NATIVE = (
    ("index_type", "path STRING", "STRING", "lower(element_at(split(path, '[.]'), -1))"),
    ("sheet_bool", "x STRING", "BOOLEAN", "CASE upper(trim(x)) WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END"),
    ("sheet_pmt", "rate DOUBLE, periods DOUBLE, value DOUBLE", "DOUBLE", "CASE WHEN rate = 0 THEN -value / periods ELSE -value * rate / (1 - power(1 + rate, -periods)) END"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the index and sheet functions known to SQL text of this session; returns their names.

    Bodies in SQL become part of the caller's plan. `index_fold` needs Unicode normalization, which SQL hasn't, and is an Arrow function;
    `index_reason` is built of expressions, so its patterns are written out into a body too.
    """
    from ..operators.corpus import ISSUES
    from .text import fold_any

    for name, parameters, kind, body in NATIVE:
        override(spark, name, parameters, kind, body)
    spark.udf.register("index_fold", fold_any)
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    signs = "concat_ws('\\n', lower(error), CASE WHEN status = 'empty' THEN 'no text' END)"
    cases = " ".join(f"WHEN rlike({signs}, {quoted(pattern)}) THEN {quoted(reason)}" for pattern, reason in ISSUES)
    override(spark, "index_reason", "error STRING, status STRING", "STRING", f"CASE WHEN status IN ('pending', 'text-only') THEN 'waiting' {cases} ELSE 'other' END")
    return ["index_fold", "index_reason", *(n[0] for n in NATIVE)]


def override(spark: SparkSession, name: str, parameters: str, kind: str, body: str) -> None:
    """Registers a SQL function, or puts another body under a name that is registered: later queries call it, earlier plans keep theirs."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def callable_names(spark: SparkSession, names: Sequence[str]) -> dict[str, bool]:
    """Which functions SQL text of this session can call."""
    return {n: spark.catalog.functionExists(n) for n in names}
