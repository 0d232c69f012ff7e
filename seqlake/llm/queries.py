"""The thin opN queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, bpe, fingerprints, language_id, minhash, quality_divergence, retrieval_packing, suffix_dedup, token_counts, toxicity
from .common import documents, held_out


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.tokenizer_json(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.round_trip(documents(spark, sf_dir), made)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def json_tokenizer() -> str:
    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.packed(documents(spark, sf_dir), json_tokenizer())


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_divergence.judge(docs, quality_divergence.learn_references(docs))


def op5_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.matrices(documents(spark, sf_dir), json_tokenizer())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(documents(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_retrieval_packing": op3_retrieval_packing,
    "op4_quality_divergence": op4_quality_divergence,
    "op5_binary_output": op5_binary_output,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_piece_counts": op10_piece_counts,
}

#: DuckDB SQL by query; none of these operators can be stated in SQL over whole tables.
ORACLE_SQL: dict[str, str] = {}
