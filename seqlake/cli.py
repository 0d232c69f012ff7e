"""The command line: ``python -m seqlake.cli build | query | info | fuse``.

Each command is one or a few Spark jobs; start it with spark-submit to run on
a cluster.  Results are folders, which must not exist yet.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqlake.config import MODES, SCHEMES, SeedConfig
from seqlake.operators import postings, search
from seqlake.session import ship
from seqlake.sources import files, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="seqlake", description="Indexes of which seed occurs in which sequence file.")
    commands = parser.add_subparsers(dest="command", required=True)

    build = commands.add_parser("build", help="an index of the files that a list names")
    build.add_argument("--files", required=True, help="a list of files: path, name and path, or name, tab and path on each line")
    build.add_argument("--out", help="folder of the index; by default one named by the time")
    build.add_argument("--numbered", action="store_true", help="name bare paths by their number in the list")
    build.add_argument("--mode", choices=MODES, default="kmers")
    build.add_argument("--scheme", choices=SCHEMES, default=SCHEMES[0])
    for name, default in (("k", 31), ("m", None), ("z", 10), ("divisor", 16), ("seed", 69), ("partitions", 16), ("most-bases", None)):
        build.add_argument(f"--{name}", type=int, default=default)
    build.add_argument("--homopolymer", action="store_true")
    build.add_argument("--pattern", help="a symmetric mask of # and _")
    build.add_argument("--strobes", action="store_true", help="link each seed with one downstream")

    query = commands.add_parser("query", help="which datasets hold the seeds of the records of a file")
    query.add_argument("index")
    query.add_argument("queries", help="a FASTA or FASTQ file")
    query.add_argument("--out", required=True)
    query.add_argument("--min-ratio", type=float, default=0.0)
    query.add_argument("--records", action="store_true", help="a row for each record and dataset, not for each dataset")
    query.add_argument("--compact", action="store_true", help="a row for each record, its datasets in one column")

    info = commands.add_parser("info", help="what an index holds")
    info.add_argument("index")

    fuse = commands.add_parser("fuse", help="one index of the datasets of several")
    fuse.add_argument("indexes", nargs="+")
    fuse.add_argument("--out", required=True)
    return parser


def _build(spark: SparkSession, given: argparse.Namespace) -> None:
    config = SeedConfig(given.mode, given.k, given.m, given.z, given.divisor, given.scheme, given.seed, given.homopolymer, given.pattern)
    config = config.with_strobes() if given.strobes else config
    colors, found = files.collection(spark, given.files, "number" if given.numbered else "file")
    postings.build(found, colors, config, given.out or sinks.default_name(), given.partitions, given.most_bases)


def _query(spark: SparkSession, given: argparse.Namespace) -> None:
    index = postings.load(spark, given.index)
    records = files.sequence_records(spark, given.queries).withColumnRenamed("record", "query_id")
    names = records.select("query_id", F.col("name").alias("query_name"))
    if not (given.records or given.compact):
        found = search.aggregate(index, records, index.config, index.colors.select("dataset_id", "name"), given.min_ratio)
        sinks.write_tsv(found.select("dataset_id", "name", "matches", "ratio"), given.out, ["dataset_id"])
        return
    found, totals = search.matches(index, records, index.config)
    if given.min_ratio > 0:
        kept = search._with_ratio(found.join(totals, "query_id")).where(F.col("ratio") >= given.min_ratio)
    else:
        kept = search.records(index, records, index.config, 0.0, index.colors)
    if given.compact:
        shown = search.compact(kept.where("matches > 0"), totals).join(names, "query_id")
        shown.orderBy("query_id").select("query_name", "valid_kmers", "hits").write.csv(given.out, sep="\t", header=True)
        return
    shown = search.named(search.with_no_hits(kept, totals), index.colors).join(names, "query_id").orderBy("query_id", "dataset_id")
    sinks.write_tsv(shown.select("query_name", "dataset_id", "dataset_name", "matches", "queried_seeds", "ratio"), given.out, [])


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    given = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("seqlake").getOrCreate()
    ship(spark)
    if given.command == "build":
        _build(spark, given)
    elif given.command == "query":
        _query(spark, given)
    elif given.command == "info":
        for name, table in postings.info(postings.load(spark, given.index)).items():
            print(name)
            table.show(1000, truncate=False)
    else:
        first, *others = (postings.load(spark, path) for path in given.indexes)
        postings.save(postings.fuse(first, *others), given.out)


if __name__ == "__main__":
    main()
