"""Writers of results and of minimizer sequences."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.config import SeedConfig
from seqlake.operators.seeds import seeds


def default_name(prefix: str = "myindex") -> str:
    """A folder name with the time of day in UTC."""
    return f"{prefix}-{datetime.now(UTC):%Y%m%d-%H%M%S-%f}000"


def write_tsv(found: DataFrame, path: str, order: list[str], ratio: str = "ratio") -> None:
    """Tab-separated with a header, in ``order`` (as found stands if that is empty), ratios with eight decimals and a dot for null."""
    shown = found.orderBy(*order) if order else found
    columns = [F.format_string("%.8f", c).alias(c) if c == ratio else F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c in found.columns]
    shown.select(*columns).write.csv(path, sep="\t", header=True)


def minimizer_fasta(sequences: DataFrame, config: SeedConfig, record: str = "record_id", seq: str = "seq") -> DataFrame:
    """value: a FASTA header ``>rR_pP`` and the canonical seed for each selected place, by record and place."""
    places = seeds(sequences, config, [record], seq).select(record, "pos").distinct()
    window = F.upper(F.substring(F.col(seq), (F.col("pos") + 1).cast("int"), F.lit(config.length)))
    canonical = F.least(window, F.reverse(F.translate(window, "ACGT", "TGCA")))
    named = places.join(sequences.select(record, seq), record).orderBy(record, "pos")
    return named.select(F.concat(F.lit(">r"), record, F.lit("_p"), "pos", F.lit("\n"), canonical).alias("value"))


def write_minimizer_fasta(sequences: DataFrame, config: SeedConfig, path: str, gzip: bool = False, **names: str) -> None:
    """Fails if ``path`` exists."""
    minimizer_fasta(sequences, config, **names).write.text(path, compression="gzip" if gzip else "none")


def write_minimizer_collection(sequences: DataFrame, config: SeedConfig, path: str) -> None:
    """sequences(dataset_id, record_id, seq) as one folder of FASTA text for each dataset, and minimizers.fof, which lists them."""
    spark = sequences.sparkSession
    places = seeds(sequences, config, ["dataset_id", "record_id"]).select("dataset_id", "record_id", "pos").distinct()
    window = F.upper(F.substring("seq", (F.col("pos") + 1).cast("int"), F.lit(config.length)))
    canonical = F.least(window, F.reverse(F.translate(window, "ACGT", "TGCA")))
    named = places.join(sequences, ["dataset_id", "record_id"])
    lines = named.select("dataset_id", "record_id", "pos", F.concat(F.lit(">r"), "record_id", F.lit("_p"), "pos", F.lit("\n"), canonical).alias("value"))
    lines.repartition("dataset_id").sortWithinPartitions("dataset_id", "record_id", "pos").drop("record_id", "pos").write.partitionBy("dataset_id").text(path)
    listed = sequences.select("dataset_id").distinct().orderBy("dataset_id")
    listed.select(F.concat(F.lpad(F.col("dataset_id").cast("string"), 8, "0"), F.lit(f"\t{path}/dataset_id="), "dataset_id").alias("value")).coalesce(1).write.text(f"{path}/minimizers.fof")
