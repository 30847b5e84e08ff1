"""The queries op1 to op10: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracle import ORACLE  # noqa: F401  read by the registry


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    drawn = mix(table(spark, sf_dir, "documents"), max_repeat=2.0)
    return drawn.select(F.col("r.doc_id").alias("doc_id"), "source", "n_tokens", "weight", "block", "copy", "mix_rank")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("r.doc_id").alias("doc_id"), "held_out", "score", "predicted")


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import ring_shards

    placed = ring_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    found = identify_languages(table(spark, sf_dir, "documents"))
    return found.select(F.col("r.doc_id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).select(F.col("r.vec_id").alias("vec_id"), "n_links", "component_id", "kept")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bagminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("r.doc_id").alias("doc_id"), "class_id", "kept")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_main_text, op4_harmonic_packing, op5_quality, op6_ring_shards, op7_language, op8_near_vectors, op9_exact_topk, op10_near_duplicates)}

