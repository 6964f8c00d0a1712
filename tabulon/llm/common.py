"""What the corpus operators share: reading tables, cutting lineage, the word pattern."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import settle, shared_dir  # noqa: F401

#: A word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as a run.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, whatever store `sf_dir` is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table of its own in the shared folder: cuts the lineage as `settle` does, in columns and compressed."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written`, once everything that is made of them is settled or written itself."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once for each row, however often and inside of what it is used later."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def spaced(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with column `name`: the text with each run of ASCII white space as one space, none at the ends.

    Byte-wise replaces; a regular expression runs only over texts that hold such a run. Two projections, so
    that the first is computed once.
    """
    flat = F.col(text)
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    df = df.withColumn(name, F.trim(flat))
    return df.withColumn(name, F.when(F.contains(name, F.lit("  ")), F.regexp_replace(name, " {2,}", " ")).otherwise(F.col(name)))


def words_in(flat: str) -> Column:
    """Number of words of a text made by `spaced`."""
    c = F.col(flat)
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("long")
