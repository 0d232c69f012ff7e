"""A corpus pipeline of five operators: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir).  All but the last return
the columns of documents; what one rejects does not reach the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import minhash, quality_divergence, retrieval_packing, suffix_dedup, toxicity
from seqlake.llm.common import discard, documents, held_out, release_shared, write_shared
from seqlake.llm.queries import json_tokenizer
from seqlake.session import ship


def _begin(spark: SparkSession) -> None:
    """The stage before has been written, so its working tables can go."""
    ship(spark)
    release_shared(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence rules."""
    _begin(spark)
    return quality_divergence.keep(docs, quality_divergence.learn_references(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a machine fitted to the labelled ones among them that are not held out."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return toxicity.drop(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; of rows that repeat an id the one whose text has the least hash stays.

    Rows without an id cannot be named as copies, and stay.
    """
    _begin(spark)
    gone = minhash.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    kept = docs.join(write_shared(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)
    of_text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(of_text).alias("least")).where("n > 1 and doc_id is not null")
    if not again.limit(1).count():
        return kept
    again = write_shared(again.select(F.col("doc_id").alias("of_id"), "least"), "repeated-ids")
    same_id = F.col("doc_id") == F.col("of_id")
    once = kept.join(again, same_id & (of_text == F.col("least"))).select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(again, same_id, "left_anti").select(*docs.columns).union(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; n_chars follows."""
    _begin(spark)
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    _begin(spark)
    return retrieval_packing.packed(docs, json_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packing),
]

#: SQL can state neither the fitted scores nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again before the next stage."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared(docs, f"stage-{k}", releasable=False)
            if before is not None:
                discard(before)
            before = docs
    return docs
