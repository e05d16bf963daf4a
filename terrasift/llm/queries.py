"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import exact_dedup, language, learning, minhash, mixing, pieces, preference, quality, token_store, toxicity, vector_search

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learning.remainder("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (learning.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.pairs_of(_read(spark, sf_dir, "conversations"))
    rows = preference.format_preferences(pairs)
    masks = [preference.mask_text(F.col(c)).alias(c) for c in ("chosen_mask", "rejected_mask")]
    return rows.select(F.col("key").alias("conv_id"), "status", "prompt_turns", "prompt", "chosen", masks[0], "rejected", masks[1])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels, learning.remainder("doc_id", 3) != 1)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (learning.remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = language.train(docs, learning.remainder("doc_id", 5) != 0)
    found = language.predict_language(docs, net)
    return found.select("doc_id", (learning.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    folder = token_store.write_store(docs, public_tokenizers.path(BYTE_BPE))
    read = token_store.read_store(spark, folder, token_store.keys_of(docs), must_exist=True)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    encoded = pieces.encode(docs, public_tokenizers.path(PIECE_BPE), from_files=True)
    return encoded.select(F.col("id").alias("doc_id"), "n_parts", "n_pieces", "ids_crc32", "round_trip", "v_pieces", "v_score")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_preference_format": op2_preference_format,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality": op4_quality,
        "op5_language": op5_language,
        "op6_token_store": op6_token_store,
        "op7_vector_top_k": op7_vector_top_k,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_mix_sources": op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_preference_format": preference.ORACLE_SQL,
        "op3_exact_dedup": exact_dedup.ORACLE_SQL,
        "op7_vector_top_k": vector_search.ORACLE_SQL,
        "op8_minhash_near_dedup": minhash.ORACLE_SQL,
    }
