"""Corpus upkeep: boilerplate, copies, families, skeletons, classification, redaction, retention."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_ascii, is_distinctive, is_heading, is_marker, line_key, split_lines

LEAST_DOCUMENTS = 3
TITLE_LINES, DROPPABLE = 2, 9


def family_lines(df: DataFrame, id_col: str, text: str, family: str, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(family, key, documents): exact lines that stand in at least `least` documents of a family.

    A document counts a line once, which is seen to inside its row, so the only shuffle is of counts by (family, line).
    """
    keys = F.array_distinct(F.array_compact(F.transform(split_lines(F.col(text)), lambda x: line_key(x, True))))
    each = df.select(F.col(family).alias("family"), F.explode(keys).alias("key"))
    return each.groupBy("family", "key").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least)


def repeated_lines(df: DataFrame, text: str, group: str, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(group, line, documents): trimmed lines as they are, in at least `least` documents of a group."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(F.col(group), F.explode(lines).alias("line")).groupBy(group, "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least)


def exact_copies(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, duplicate_of): the first document of the same text, for the others. A minimum joined back by hash of the text."""
    rows = df.select(F.col(id_col), F.sha2(F.col(text).cast("binary"), 256).alias("_h")).where("_h IS NOT NULL")
    first = rows.groupBy("_h").agg(F.min(id_col).alias("duplicate_of"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(first, "_h").where(F.col(id_col) != F.col("duplicate_of")).select(id_col, "duplicate_of")


#: Signs of copies, and words whose number differs between siblings (fixed values).
COPY = r"\(\s*\d+\s*\)|\bcopy\b|\bban sao\b|\bfinal\b|\bdraft\b|\bban nhap\b|\bbackup\b|\bbak\b|\bold\b|\bcu\b"
COUNTERS = ("tuan", "bai", "tiet", "buoi", "ngay", "thang", "nam", "week", "lesson", "unit", "chapter", "lop", "khoi", "so", "no", "ver", "v", "part", "phan", "stt")


def _telling(name: Column) -> Column:
    """The words of a name that siblings share: no copy signs, no numbers, no counters before a number."""
    flat = F.regexp_replace(fold_ascii(F.regexp_replace(F.lower(name), COPY, " ")), COPY, " ")
    tokens = F.regexp_extract_all(flat, F.lit(r"[a-z]+|\d+"), F.lit(0))
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda word, after: F.struct(word.alias("word"), F.coalesce(after.rlike(r"^\d"), F.lit(False)).alias("counts")))
    return F.filter(pairs, lambda p: ~p["word"].rlike(r"^\d") & ~(p["counts"] & p["word"].isin(*COUNTERS)))["word"]


def family_key(path: Column, name_words: int = 3) -> Column:
    """What the files of a family have in common, as text: the telling words of the folders, the first ones of the name, the extension."""
    steps = F.split(F.trim(path), r"[\\/]+")
    folders = F.transform(F.slice(steps, F.lit(1), F.size(steps) - 1), lambda x: F.array_join(_telling(x), " "))
    name = F.element_at(steps, -1)
    stem, ending = F.regexp_replace(name, r"(?<=.)\.[^.]{1,7}$", ""), F.regexp_extract(name, r"(?<=.)\.([^.]{1,7})$", 1)
    return F.concat_ws("|", F.array_join(F.array_remove(folders, ""), "/"), F.array_join(F.slice(_telling(stem), 1, name_words), " "), F.lower(ending))


def copy_penalty(name: Column) -> Column:
    return F.lower(name).rlike(COPY).cast("int")


def line_priorities(df: DataFrame, id_col: str, text: str, family: str, boiler: DataFrame) -> DataFrame:
    """(id, order, line, same, chars, boiler, priority): 0 title, 1 marker, 2 distinctive, 3 unique, 4 heading, 9 to drop; `same` is a hash of the line.

    Both priorities of a line, as boilerplate and not, are told before the join, so whoever doesn't read lines doesn't shuffle them.
    """
    line = F.col("line")
    each = df.select(F.col(id_col), F.col(family).alias("family"), F.posexplode(split_lines(F.col(text))).alias("order", "line"))
    first = F.when(F.col("order") < TITLE_LINES, 0).when(is_marker(line), 1)
    told = each.select(id_col, "family", "order", "line", F.xxhash64("line").alias("same"), F.length("line").alias("chars"), line_key(line, True).alias("key"), first.alias("_first"),
                       F.when(is_distinctive(line), 2).otherwise(3).alias("_own"), F.when(is_heading(line), 4).otherwise(DROPPABLE).alias("_common"))
    rows = told.join(boiler.select("family", "key", F.lit(True).alias("_b")), ["family", "key"], "left").withColumn("boiler", F.coalesce("_b", F.lit(False)))
    return rows.select(id_col, "order", "line", "same", "chars", "boiler", F.coalesce("_first", F.when(F.col("boiler"), F.col("_common")).otherwise(F.col("_own"))).alias("priority"))


def boilerplate_ratio(lines: DataFrame, id_col: str) -> DataFrame:
    return lines.groupBy(id_col).agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("boiler") & (F.col("priority") >= 4), F.col("chars")).otherwise(0)).alias("boiler_chars")).withColumn("ratio", F.try_divide(F.col("boiler_chars"), F.col("chars")))


def skeleton(lines: DataFrame, id_col: str, cap: int = 4000, share: float = 0.2) -> DataFrame:
    """(id, kept, kept_chars): lines by priority and order while they fit; a line that is too long is passed over, later ones may fit.

    Greedy passing-over is no prefix sum, so the ordered lines of a document are folded into one state. Of equal lines only the first can be kept, titles apart:
    if it didn't fit, later ones don't, as room only shrinks. Lines are dealt by document once; both groupings are within that.
    """
    title = F.col("priority") == 0
    equal = lines.repartition(id_col).groupBy(id_col, "same", "chars").agg(F.count_if(title).alias("titles"), F.count(F.lit(1)).alias("n"), F.min(F.struct("priority", "order")).alias("first"))
    walked = F.struct("first.priority", "first.order", F.col("chars").cast("long").alias("chars"), "titles")
    docs = equal.groupBy(id_col).agg(F.sum(F.col("chars") * F.col("n")).alias("_all"), F.sort_array(F.collect_list(F.when(F.col("first.priority") < DROPPABLE, walked))).alias("_lines"))
    parts = int(1 / share)
    room = F.greatest(F.lit(cap).cast("long"), F.expr(f"(_all + {parts - 1}) div {parts}"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x["titles"] > 0, x["titles"]).when(acc["used"] + x["chars"] + 1 <= F.col("_room"), 1).otherwise(0).cast("long")
        return F.struct((acc["kept"] + n).alias("kept"), (acc["used"] + n * (x["chars"] + 1)).alias("used"))

    zero = F.lit(0).cast("long")
    done = docs.withColumn("_room", room).select(id_col, F.aggregate("_lines", F.struct(zero.alias("kept"), zero.alias("used")), step).alias("_done"))
    return done.select(F.col(id_col).cast("long").alias(id_col), F.col("_done.kept").alias("kept"), F.col("_done.used").alias("kept_chars"))


def classify(text: Column, rules: Sequence[tuple[str, str]], other: str | None) -> Column:
    """The first rule whose pattern a text matches."""
    out: Column | None = None
    for pattern, name in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(other) if out is None else out.otherwise(other)


#: Signs of index issues in lower-case error text; the first that occurs names the issue (fixed values).
ISSUES = (
    (r"embedding|model (?:is |was )?(?:unavailable|failed|not)|onnx|huggingface|transformers|enotfound|econnreset|etimedout|econnrefused|fetch failed", "model"),
    (r"password|encrypted|encryption", "password"),
    (r"eacces|eperm|ebusy|permission denied|access is denied|operation not permitted|being used by another process|sharing violation|locked", "permission"),
    (r"timeout|timed out", "timeout"),
    (r"128 mb|exceeds|too large", "too-large"),
    (r"changed", "changed"),
    (r"unavailable|enoent|enotdir|not found|cannot find|no such file|moved|deleted|file is missing|missing file|unknown: unknown error|unknown error, (?:stat|open|read|scandir)", "unavailable"),
    (r"corrupt|malformed|damaged|bad zip|not a zip|zip archive|end of central directory|unexpected end|invalid (?:zip|pdf|xref|header|signature|document|file|format)|failed to parse|cannot parse", "corrupt"),
    (r"no readable text in this file", "empty"),
    (r"no readable|no text|ocr", "no-text"),
    (r"unsupported|cannot extract|not supported|invalid", "unsupported"),
)


def issue_reason(error: Column, status: Column) -> Column:
    """Why a document isn't indexed: 'waiting' while it is pending, else by the signs in its error, else 'other'. An empty status is a sign of missing text."""
    signs = F.concat_ws("\n", F.lower(error), F.when(status == "empty", "no text"))
    return F.when(status == "pending", "waiting").otherwise(classify(signs, ISSUES, "other"))


#: Paths that aren't admitted to the index, as patterns of a path whose separators are all "/"; the first that fits names the reason. Names and endings are fixed values.
REFUSALS = (
    (r"(?i)(?:^|/)(?:win-unpacked|win-unpacked\.tmp|linux-unpacked|linux-arm64-unpacked|app\.asar\.unpacked|dist_electron)(?:/|$)", "generated-build-directory"),
    (r"(?i)(?:^|/)(?:licenses\.chromium\.html|license\.electron\.txt)/*$", "generated-build-file"),
    (r"(?i)(?:^|/)~\$[^/]*/*$|[^/]*\.(?:tmp|temp|crdownload|partial|part|lock|lck|swp|bak)/*$", "temporary-file"),
)


def refusal(path: Column) -> Column:
    """Why a path isn't admitted to the index (see REFUSALS); null if it is, or if it is null."""
    return classify(F.translate(path, "\\", "/"), REFUSALS, None)


def effective_importance(override: Column, suggestion: Column) -> Column:
    return F.coalesce(override, suggestion, F.lit("normal"))


def has_terms(folded: Column, terms: Sequence[str]) -> Column:
    """Whole-word terms in folded text."""
    return F.concat(F.lit(" "), folded, F.lit(" ")).rlike(" (?:" + "|".join(terms) + ") ")


#: Folders and endings of files that nobody wrote (fixed values of this library).
JUNK_FOLDERS = ("node_modules", "windows", "program files", "appdata", "cache", "temp", "tmp", ".git", "__pycache__", "dist", "build")
JUNK_ENDINGS = r"\.(?:tmp|log|bak|dll|exe|sys|cache|lock)$"


def is_junk(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), r"[\\/]+"), lambda x: x.isin(*JUNK_FOLDERS)) | F.lower(path).rlike(JUNK_ENDINGS)


def media_admitted(width: Column, height: Column, path: Column, least: int = 64) -> Column:
    return (F.least(width, height) >= least) & ~is_junk(path)


def retention(state: Column, verified: Column, age_days: Column, running: Column, keep_days: int = 30) -> Column:
    """Four cases in order: a running move keeps, unverified keeps, young keeps, the rest may go."""
    return F.when(running, "keep-running").when(~verified, "keep-unverified").when(age_days < keep_days, "keep-recent").otherwise("delete")


def backups_kept(df: DataFrame, created: str, now: Column, verified: str, group: str, most: int = 3, tie: str | None = None) -> DataFrame:
    """Backups younger than a day, or among the newest `most` verified ones of their group; of equal times the smaller `tie` is newer."""
    w = Window.partitionBy(group, verified).orderBy(F.desc(created), *([tie] if tie else []))
    young = F.col(created).cast("timestamp") > F.timestamp_seconds(F.unix_timestamp(now) - 86400)
    return df.withColumn("kept", young | (F.col(verified) & (F.row_number().over(w) <= most)))


def placeholders(text: Column) -> Column:
    """Labels of {{label}} markers, trimmed, signs dropped."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"[^\p{L}\p{N} _-]", ""))


def redact_spans(text: Column, spans: Column, mark: str = "[WITHHELD]") -> Column:
    """Whole markers in place of spans (array of struct(s, e), ordered, ends exclusive); overlapping spans become one."""
    joined = F.aggregate(spans, F.array().cast("array<struct<s:int,e:int>>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] > x["s"]),
                         F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["s"].alias("s"), F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["e"]).alias("e")))))
                         .otherwise(F.concat(acc, F.array(F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(joined, start, lambda acc, x: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)).alias("out"), x["e"].alias("at")))
    return F.concat(done["out"], F.substr(text, done["at"] + 1))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, cells, blanks, distinct_count, numeric): one pass and one row a column, for a cleaning report."""
    from ..functions.coerce import to_number

    aggs = []
    for c in columns:
        t = F.col(c).cast("string")
        aggs += [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("cells"), F.count_if(t.isNull() | (F.trim(t) == "")).alias("blanks"), F.count_distinct(t).alias("distinct_count"), F.count(to_number(t)).alias("numeric")).alias(f"_{c}")]
    return df.agg(F.array(*(a for a in aggs)).alias("all")).select(F.inline("all"))


def chunk_texts(df: DataFrame, id_col: str, text: str, target: int = 1200, most: int = 1800) -> DataFrame:
    """(id, ordinal, chunk): paragraphs packed to about `target` characters; longer ones are cut at sentence ends, never over `most`."""
    import re

    def pieces(t: str) -> list[str]:
        units: list[str] = []
        for para in re.split(r"\n\s*\n|\n", t):
            para = para.strip()
            if len(para) <= most:
                units += [para] if para else []
                continue
            for s in re.split(r"(?<=[.!?;])\s+", para):
                units += [s[i:i + most] for i in range(0, len(s), most)]
        out, held = [], ""
        for u in units:
            if held and (len(held) + 1 + len(u) > most or len(held) >= target):
                out.append(held)
                held = u
            else:
                held = f"{held}\n{u}" if held else u
        return [*out, held] if held else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, c) for i, t in zip(pdf[id_col], pdf[text], strict=True) if t for n, c in enumerate(pieces(t))]
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "chunk"])

    return df.select(id_col, text).mapInPandas(run, f"{id_col} long, ordinal int, chunk string")


def importance(folded_name: Column, folded_text: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """The first level whose terms the name has, else the first whose terms the text has, else normal."""
    out = F.lit(None).cast("string")
    for source in (folded_text, folded_name):
        for level in reversed(list(terms)):
            out = F.when(has_terms(source, terms[level]), level).otherwise(out)
    return F.coalesce(out, F.lit("normal"))
