"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, huffman, jaccard, langid, linededup, lmscore, mixture, quality, secrets, sharding, topk, vafile
from .common import scratch, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.told("base").cast("binary"), 256).alias("base_sha256"), secrets.told("found").alias("spans"), "n_entropy")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), path=scratch(spark, "slot-map"))


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), scratch(spark, "ids"))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "policy_version")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablated(table(spark, sf_dir, "documents"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_texts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "text", "n_lines_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op11_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.compress(table(spark, sf_dir, "embeddings")).drop("compared")


def op12_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_maxscore_top_k, op2_mix_sources, op3_secret_scan, op4_ngram_jaccard, op5_slot_shards, op6_huffman_ids,
             op7_ppm_language, op8_quality_ledger, quality_ablations, op9_prefix_bpe, op10_line_dedup, op11_va_file_codes, op12_attention_scores, op13_fill_in_middle, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
