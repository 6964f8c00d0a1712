"""Reading files: CSV with sniffed delimiters and encodings, text by magic bytes, folders; and writing."""

from __future__ import annotations

import html as _html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings that text is extracted from.
FORMATS = ("doc", "docx", "xls", "xlsx", "xlsm", "csv", "tsv", "ppt", "pptx", "pdf", "md", "html", "txt")
#: Bytes of a file that the delimiter and encoding are told from.
HEAD = 1 << 16


def decode(raw: bytes, legacy: str = "cp1252") -> str:
    """UTF-8 or UTF-16 by BOM or by the places of zero bytes, else UTF-8, else a legacy code page. UTF-32 is refused."""
    if raw[:4] in (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff"):
        raise ValueError("UTF-32 text isn't read")
    for bom, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(bom):
            return raw[len(bom):].decode(name, "replace")
    head = raw[:4096]
    if len(head) >= 4 and len(head) % 2 == 0 or len(head) == 4096:
        even, odd = head[::2].count(0) * 2 / len(head), head[1::2].count(0) * 2 / len(head)
        if odd > 0.4 and even < 0.1:
            return raw.decode("utf-16-le", "replace")
        if even > 0.4 and odd < 0.1:
            return raw.decode("utf-16-be", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(legacy, "replace")


def sniff(text: str) -> tuple[str, int]:
    """(delimiter, lines to skip): a first line `sep=x` says it; else the most frequent of comma, semicolon and tab outside quotes.

    Ties go to the comma. A separator that isn't in most lines is punctuation of prose, which has one column.
    """
    declared = re.match(r"(?i)sep=(.)\r?\n?", text)
    if declared:
        return declared[1], 1
    bare = re.sub(r'"(?:[^"]|"")*"', "", text)
    lines = [x for x in bare.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    counts = {s: bare.count(s) for s in (",", ";", "\t")}
    best = max(counts, key=lambda s: counts[s])
    with_it = sum(best in x for x in lines)
    if not counts[best] or (with_it * 2 < len(lines)):
        return ",", 0
    return best, 0


def _table(raw: bytes) -> pd.DataFrame:
    import csv

    text = decode(raw)
    sep, skip = sniff(text[:HEAD])
    if skip:
        text = text.split("\n", 1)[1] if "\n" in text else ""
    rows = list(csv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n"), newline=""), delimiter=sep))
    while rows and not any(rows[-1]):
        rows.pop()
    return pd.DataFrame({"row": range(len(rows)), "cells": rows, "sep": sep}) if rows else pd.DataFrame({"row": [], "cells": [], "sep": []})


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells, sep) of any CSV files, whatever their delimiter and encoding: a file is one unit of work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf.path, pdf.content, strict=True):
                rows = _table(bytes(raw))
                if len(rows):
                    yield rows.assign(path=p)[["path", "row", "cells", "sep"]]

    return files.mapInPandas(run, "path string, row long, cells array<string>, sep string")


def read_split(spark: SparkSession, path: str, sep: str | None = None, most_rows: int | None = None, most_columns: int | None = None) -> DataFrame:
    """(path, row, cells, sep) of UTF-8 CSV files as `read_cells` gives them, a file in as many tasks as it has blocks.

    Spark splits files at line feeds. A line begins a row if the quotes before it are even in number, so the quotes of each block are counted, a prefix sum over
    blocks tells each block's start, and one within the block each line's. Rows are numbered by the same sums. What belongs to one row is put together
    within its block; only the pieces at the ends of blocks, one or two each, meet across blocks. Quotes have to be those of RFC 4180: around
    cells, doubled inside. Without `sep` the first lines are sniffed. CR and CRLF are line feeds, trailing empty rows go, a blank row has no cells. `most_rows` and
    `most_columns` leave out what is beyond them.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    if sep is None:
        sep, skip = sniff("\n".join(r.value for r in text.limit(200).collect()).removeprefix("\ufeff"))
    else:
        skip = 0
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("value", F.when(F.col("block") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    lines = lines.select("path", "block", "at", F.posexplode(F.split(F.regexp_replace("value", "\r$", ""), "\r")).alias("pos", "value"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    in_block = Window.partitionBy("path", "block").orderBy("at", "pos")
    lines = lines.withColumn("odd", (F.sum("quotes").over(in_block) - F.col("quotes")) % 2)
    blocks = lines.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("odd") == 0).alias("even_starts"), F.count_if(F.col("odd") == 1).alias("odd_starts"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("starts", F.when(F.col("inside") == 0, F.col("even_starts")).otherwise(F.col("odd_starts")))
    blocks = blocks.select("path", "block", "inside", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("rows_before"), "starts")
    placed = lines.join(blocks, ["path", "block"])
    nth = F.sum((F.col("odd") == F.col("inside")).cast("long")).over(in_block)
    pieces = placed.withColumn("nth", nth).groupBy("path", "block", "nth").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "pos", "value"))), lambda x: x["value"]), "\n").alias("text"), F.first("rows_before").alias("rows_before"), F.first("starts").alias("starts"))
    pieces = pieces.select("path", "block", (F.col("rows_before") + F.col("nth")).alias("row"), "text", ((F.col("nth") == 0) | (F.col("nth") == F.col("starts"))).alias("edge"))
    across = pieces.where("edge").groupBy("path", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rows = pieces.where("NOT edge").select("path", "row", "text").unionByName(across)
    s = re.escape(sep)
    fields = F.regexp_extract_all(F.concat(F.lit(sep), "text"), F.lit(rf'{s}((?:"(?:[^"]|"")*+"?)?[^{s}]*+)'), F.lit(1))
    bare = F.transform(fields, lambda f: F.when(f.startswith('"'), F.concat(F.replace(F.regexp_extract(f, r'^"((?:[^"]|"")*+)', 1), F.lit('""'), F.lit('"')), F.regexp_extract(f, r'^"(?:[^"]|"")*+"(.*)$', 1))).otherwise(f))
    rows = rows.select("path", (F.col("row") - 1 - skip).alias("row"), F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(bare).alias("cells")).where("row >= 0")
    last = rows.where(F.exists("cells", lambda c: c != "")).groupBy("path").agg(F.max("row").alias("last"))
    rows = rows.join(last, "path").where("row <= last").select("path", "row", "cells", F.lit(sep).alias("sep"))
    if most_rows is not None:
        rows = rows.where(F.col("row") < most_rows)
    return rows if most_columns is None else rows.withColumn("cells", F.slice("cells", 1, most_columns))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", most_columns: int | None = None) -> DataFrame:
    """A CSV with a header as Spark reads it, splitting large files. Without `sep`, the head of the first file is sniffed."""
    if sep is None:
        first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEAD).alias("head")).limit(1).first()
        sep = sniff(decode(bytes(first.head)))[0] if first else ","
    out = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"')
    if most_columns is not None and len(out.columns) > most_columns:
        raise ValueError(f"{len(out.columns)} columns are more than {most_columns}")
    return out


def shape(cells: DataFrame) -> DataFrame:
    """Rows, most columns, and the last column with a value, by file."""
    full = F.array_max(F.transform("cells", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return cells.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).cast("long").alias("columns"), F.max(full).cast("long").alias("used_columns"), F.first("sep").alias("sep"))


def magic(content: Column, length: int = 1024) -> Column:
    """zip, pdf (within the first 1024 bytes), ole2 or unknown."""
    head = F.substring(content, 1, length)
    starts = F.hex(F.substring(content, 1, 8))
    return F.when(starts.startswith("504B0304"), "zip").when(starts == "D0CF11E0A1B11AE1", "ole2").when(F.contains(head, F.lit(bytearray(b"%PDF"))), "pdf").otherwise("unknown")


def text_of(name: str, raw: bytes, most: int | None = None) -> tuple[str | None, str | None]:
    """(text, error) of a file by its ending; never raises."""
    ext = name.rsplit(".", 1)[-1].lower()
    try:
        if ext not in FORMATS:
            return None, f"unsupported type .{ext}"
        if ext in ("docx", "xlsx", "xlsm", "pptx"):
            if not raw.startswith(b"PK\x03\x04"):
                return None, "the content isn't what the ending says"
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                parts = [n for n in z.namelist() if re.match(r"word/document\.xml|xl/sharedStrings\.xml|xl/worksheets/.*\.xml|ppt/slides/slide\d+\.xml", n)]
                xml = "\n".join(z.read(n).decode("utf-8", "replace") for n in sorted(parts))
            text = _html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</(?:w:p|a:p|row|si)>", "\n", xml)))
        elif ext in ("doc", "xls", "ppt", "pdf"):
            return None, f"no reader for .{ext} is installed"
        else:
            if raw.startswith(b"PK\x03\x04") or raw.startswith(b"%PDF"):
                return None, "the content isn't what the ending says"
            text = decode(raw)
            if ext == "html":
                text = html_text(text)
        return text[:most] if most else text, None
    except Exception as e:  # a broken file is a row with an error, not a failed job
        return None, str(e)[:200]


def html_text(page: str) -> str:
    body = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", page)
    body = re.sub(r"(?i)<(?:br|/p|/h\d|/li|/div|/tr)\b[^>]*>", "\n", body)
    return re.sub(r"[ \t]+", " ", _html.unescape(re.sub(r"<[^>]*>", " ", body))).strip()


def html_text_column(c: Column) -> Column:
    """Text of HTML by built-in expressions: scripts, styles, comments and tags out, the common entities back."""
    body = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"<[^>]*>", " ")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def extract(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(path, mtime, size, text, error) of all files under a folder; files are read in tasks, and errors are rows."""
    files = scan(spark, path, content=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [text_of(p, bytes(c), most) for p, c in zip(pdf.path, pdf.content, strict=True)]
            yield pdf[["path", "mtime", "size"]].assign(text=[g[0] for g in got], error=[g[1] for g in got])

    return files.mapInPandas(run, "path string, mtime timestamp, size long, text string, error string")


def scan(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, mtime, size) of a folder tree; without `content` no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))


def merge_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several files as one, by column names, with the file's name; missing columns are null."""
    out: DataFrame | None = None
    for name, df in tables.items():
        named = df.withColumn("source_table", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def tsv_line(df: DataFrame) -> DataFrame:
    """One `line` a row: tab-separated, booleans TRUE/FALSE, cells with tabs, quotes or line ends quoted."""
    cells = []
    for f in df.schema.fields:
        t = F.upper(F.col(f.name).cast("string")) if f.dataType.typeName() == "boolean" else F.col(f.name).cast("string")
        t = F.coalesce(t, F.lit(""))
        cells.append(F.when(t.rlike('[\\t\\n\\r"]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t))
    return df.select(F.array_join(F.array(*cells), "\t").alias("line"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def connections(spark: SparkSession) -> DataFrame:
    """Registered tables with their kind; nothing is executed."""
    rows = [(t.name, t.tableType or "", bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")
