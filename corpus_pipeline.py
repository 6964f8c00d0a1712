"""From raw documents to token ids in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, jaccard, langid, linededup, mixture
from tabulon.llm.common import remove, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language fits, or that have no letter, go. The trees are fitted on this stage's input.

    Null and empty texts have no letter. A null lang becomes the predicted one. Repeated rows are judged alike; null doc_ids are judged
    too, but not learned from. If no row has a lang, only texts without letters go. An empty table gives no rows.
    """
    return langid.accepted(docs, langid.fit(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; a document of which nothing but white space is left goes too.

    Null texts stay. Null doc_ids come before all others, and rows that repeat doc_id and text get the same result. An empty table
    gives no rows.
    """
    left = linededup.dedup_lines(docs)
    gone = (F.col("n_lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return left.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, the smallest doc_id stays.

    Null or empty texts link with nothing and stay. Null doc_ids come first; of equal doc_ids in a component the text of the
    least hash stays, and of rows that repeat doc_id and text one. An empty table gives no rows.
    """
    return jaccard.representatives(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as the mix takes of it; at a source's cut, where a part of one document is taken, it's rounded.

    Rows of one doc_id and source (null is a value of both) count as one: together they get the mix's share of their words. Texts
    without words are never taken. An empty table gives no rows.
    """
    taken = mixture.mix(docs).groupBy("doc_id", "source").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size")).withColumnsRenamed({"doc_id": "_id", "source": "_of"})
    copies = F.when(F.col("_size") > 0, F.floor((F.col("_taken") * 2 + F.col("_size")) / (F.col("_size") * 2))).otherwise(0).cast("int")
    taken = taken.withColumn("_copies", copies).where("_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of"))
    return docs.join(taken, same).withColumn("_n", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every row, and its decoding. Null and empty texts have no ids; an empty table gives no rows."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language), ("line_dedup", remove_repeated_lines), ("near_copies", drop_near_copies),
    ("source_mix", mix_sources), ("byte_bpe", encode),
]

#: Byte context trees, token ids and hashes of both have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`. A stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
