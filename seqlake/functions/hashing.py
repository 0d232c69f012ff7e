"""64-bit hashes as Column expressions, with wrapping arithmetic.

Unsigned numbers are held as the BIGINT of the same bits.  Spark's ANSI mode
raises on overflow, and the mode in force while a DataFrame is being built is
the one that counts: build such columns inside ``wrapping``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """DataFrames built inside multiply and add modulo 2^64."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def signed(n: int) -> int:
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def _lit(n: int) -> Column:
    return F.lit(signed(n)).cast("long")


def splitmix64(x: Column) -> Column:
    z = x + _lit(0x9E3779B97F4A7C15)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * _lit(0xBF58476D1CE4E5B9)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * _lit(0x94D049BB133111EB)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def mixsplit(key: Column, seed: int) -> Column:
    return splitmix64(key + _lit(seed))


def unsigned_mod(h: Column, d: int) -> Column:
    """h modulo d, h taken as unsigned."""
    if d & (d - 1) == 0:
        return h.bitwiseAND(_lit(d - 1))
    return F.pmod(F.pmod(h, F.lit(d)) + F.when(h < 0, F.lit((1 << 64) % d)).otherwise(F.lit(0)), F.lit(d))


#: What tells apart the hashes for partitions, recovery and fingerprints.
PARTITION, RECOVERY, FINGERPRINT = 0x34B61D8F29A7C053, 0xD6E8FEB86659FD93, 0x8E2D4F6A9B13C5D7


def partition_of(key: Column, seed: int, partitions: int) -> Column:
    """Partition of a key; partitions is a power of two."""
    return splitmix64(key.bitwiseXOR(_lit(seed ^ PARTITION))).bitwiseAND(_lit(partitions - 1))


def recovery_hash(key: Column, seed: int) -> Column:
    """32 bits."""
    return F.shiftrightunsigned(splitmix64(key.bitwiseXOR(_lit(seed ^ RECOVERY))), 32)


def fingerprint(key: Column, seed: int, bits: int) -> Column:
    return splitmix64(key.bitwiseXOR(_lit(seed ^ FINGERPRINT))).bitwiseAND(_lit((1 << bits) - 1))
