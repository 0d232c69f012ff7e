"""Sizes and likeness of datasets: sketches, union estimates, partition counts.

Groups of datasets that a packed filter would share are a matter of storage
that Parquet takes over; what remains useful is knowing which datasets are
alike and how large their unions are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.config import SeedConfig
from seqlake.functions.hashing import PARTITION, mixsplit, partition_of, wrapping

from .bins import by_key, first_of


def sketches(found: DataFrame, buckets: int = 128, seed: int = 69, dataset: str = "dataset_id") -> DataFrame:
    """dataset, bucket, least, keys: the smallest 32-bit hash of a dataset's distinct keys in each bucket, and how many these are; buckets is a power of two."""
    with wrapping(found.sparkSession):
        hashed = found.select(dataset, mixsplit(F.col("key"), seed).alias("h"))
    split = hashed.select(dataset, F.col("h").bitwiseAND(F.lit(buckets - 1)).alias("bucket"), F.shiftrightunsigned("h", 32).alias("low"))
    return split.groupBy(dataset, "bucket").agg(F.min("low").alias("least"), F.count("*").alias("keys"))


def sketches_of(sequences: DataFrame, config: SeedConfig, buckets: int = 128, seed: int = 69, dataset: str = "dataset_id") -> DataFrame:
    """As sketches, of the seeds of sequences."""
    import numpy as np

    from seqlake.functions import kernels as kn

    def sum_up(keys, own, n, names):
        h = kn.mixsplit(keys, seed)
        code = np.sort((own.astype(np.uint64) * np.uint64(buckets) + (h & np.uint64(buckets - 1))) << np.uint64(32) | h >> np.uint64(32))
        new, counts = first_of(code >> np.uint64(32))
        at, low = (code[new] >> np.uint64(32)).astype(np.int64), (code[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return [names.take(pa.array(at // buckets)), pa.array(at % buckets), pa.array(low), pa.array(counts)]

    kind = sequences.schema[dataset].dataType.simpleString()
    each = by_key(sequences, config, sum_up, f"{dataset} {kind}, bucket long, least long, keys long", dataset, group=F.col(dataset))
    return each.groupBy(dataset, "bucket").agg(F.min("least").alias("least"), F.sum("keys").alias("keys"))


def jaccard_pairs(sketched: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """a, b, jaccard, union_estimate for pairs of datasets that agree in a bucket.

    The estimate is (A + B) / (1 + J), held between the larger of A and B and
    their sum.
    """
    sizes = sketched.groupBy(dataset).agg(F.count("*").alias("filled"), F.sum("keys").alias("unique_kmers"))
    one = sketched.select(F.col(dataset).alias("a"), "bucket", "least")
    two = sketched.select(F.col(dataset).alias("b"), "bucket", "least")
    same = one.join(two, ["bucket", "least"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("same"))
    of = lambda side: sizes.select(F.col(dataset).alias(side), F.col("unique_kmers").alias(f"size_{side}"), F.col("filled").alias(f"filled_{side}"))
    joined = same.join(of("a"), "a").join(of("b"), "b")
    jaccard = F.col("same").cast("double") / F.greatest("filled_a", "filled_b")
    total = F.col("size_a") + F.col("size_b")
    union = F.greatest(F.greatest("size_a", "size_b").cast("double"), F.least(total.cast("double"), total / (1 + jaccard)))
    return joined.select("a", "b", jaccard.alias("jaccard"), F.round(union).cast("long").alias("union_estimate"))


def partition_counts(found: DataFrame, partitions: int, seed: int = 69, dataset: str = "dataset_id") -> DataFrame:
    """partition, postings, keys of rows (dataset, key), which may repeat; partitions is a power of two."""
    each = found.groupBy("key").agg(F.size(F.collect_set(dataset)).alias("n"))
    with wrapping(found.sparkSession):
        placed = each.select(partition_of(F.col("key"), seed, partitions).alias("partition"), "n")
    return placed.groupBy("partition").agg(F.sum("n").alias("postings"), F.count("*").alias("keys"))


def partition_counts_of(sequences: DataFrame, config: SeedConfig, partitions: int, dataset: str = "dataset_id") -> DataFrame:
    """As partition_counts, of the seeds of sequences."""
    import numpy as np

    from seqlake.functions import kernels as kn

    mark = np.uint64(config.seed ^ PARTITION)

    def sum_up(keys, own, n, names):
        placed = (kn.splitmix64(keys ^ mark) & np.uint64(partitions - 1)).astype(np.int64)
        every, distinct = np.bincount(placed, minlength=partitions), np.bincount(placed[first_of(keys)[0]], minlength=partitions)
        held = np.flatnonzero(every)
        return [pa.array(held), pa.array(every[held]), pa.array(distinct[held])]

    each = by_key(sequences, config, sum_up, "partition long, postings long, keys long", dataset)
    return each.groupBy("partition").agg(F.sum("postings").alias("postings"), F.sum("keys").alias("keys"))
