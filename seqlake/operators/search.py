"""Searches: how many seeds of a query occur in each dataset.

Query seeds are counted by key before anything is joined.  While the distinct
query keys are few enough (counted first), they are broadcast and datasets
drop all other seeds where these are made; beyond that, datasets' postings
and query keys meet in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.config import SeedConfig

from .postings import Index, routed
from .seeds import among, pieces, prepared, seed_arrays, seeds, sliced

#: Distinct query keys up to which they are broadcast: 16 MB.
BROADCAST_KEYS = 2_000_000


def _few_keys(keys: DataFrame, most: int = BROADCAST_KEYS) -> Broadcast | None:
    """The distinct keys, sorted, as a broadcast array, if there are at most ``most``."""
    import numpy as np

    found = keys.select("key").distinct().limit(most + 1)
    table = found.toArrow()
    if table.num_rows > most:
        return None
    sorted_keys = np.sort(table.column("key").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return keys.sparkSession.sparkContext.broadcast(sorted_keys)


def dataset_hits(datasets: DataFrame, config: SeedConfig, keys: DataFrame, dataset: str = "dataset_id", seq: str = "seq", most_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Each (dataset, key) once whose key is among ``keys``."""
    few = _few_keys(keys, most_keys)
    found = seeds(datasets, config, [dataset], seq, only=few, distinct=True).select(dataset, "key").distinct()
    return found if few is not None else found.join(keys.select("key").distinct(), "key", "left_semi")


def hits_of(target: DataFrame | Index, config: SeedConfig, keys: DataFrame, dataset: str = "dataset_id", most_keys: int = BROADCAST_KEYS) -> DataFrame:
    """As dataset_hits, of a table of sequences or of an index."""
    if isinstance(target, Index) and target.sequences is not None:
        return dataset_hits(target.sequences, config, keys, "dataset_id", most_keys=most_keys)
    if isinstance(target, Index):
        asked = routed(target, keys.select("key").distinct())
        if asked.limit(most_keys + 1).count() > most_keys:
            return target.postings.join(asked, ["partition", "key"]).select(dataset, "key")
        # a key has one partition, and a table of single numbers is looked up faster than one of pairs
        read = [r["partition"] for r in asked.select("partition").distinct().collect()]
        return target.postings.where(F.col("partition").isin(read)).join(F.broadcast(asked.select("key")), "key").select(dataset, "key")
    return dataset_hits(target, config, keys, dataset, most_keys=most_keys)


def _counted(hits: DataFrame, weighted: DataFrame, ids: list[str], dataset: str) -> DataFrame:
    return weighted.join(hits, "key").groupBy(*ids, dataset).agg(F.sum("n").alias("matches"))


def _counted_in_tasks(target: DataFrame, config: SeedConfig, weighted: DataFrame, ids: list[str], dataset: str, most_rows: int, least: float) -> DataFrame | None:
    """As _counted, without a row for each (query, dataset, key); None if there are more than ``most_rows`` of ``weighted``.

    Each dataset's query keys travel as numbers in one field a slice, and its
    counts are summed where they meet.  Pairs that stay below the share
    ``least`` of a query's seeds are left out.
    """
    import numpy as np

    table = weighted.select("key", "n", *ids).limit(most_rows + 1).toArrow().combine_chunks()
    if table.num_rows > most_rows:
        return None
    keys, number = np.unique(table.column("key").to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
    order = np.argsort(number, kind="stable")
    named = table.select(ids).append_column("n", table.column("n")).group_by(ids, use_threads=False).aggregate([("n", "sum")])
    places = {x: i for i, x in enumerate(zip(*(named.column(c).to_pylist() for c in ids), strict=True))}
    whose = np.array([places[x] for x in zip(*(table.column(c).to_pylist() for c in ids), strict=True)], np.int64)[order]
    floor = np.maximum(1, np.ceil(least * named.column("n_sum").to_numpy() - 1e-6)).astype(np.int64)
    begins = np.r_[0, np.cumsum(np.bincount(number, minlength=len(keys)))]
    who = [named.column(c).combine_chunks() for c in ids]
    shared = target.sparkSession.sparkContext.broadcast((keys, begins, whose, table.column("n").to_numpy()[order], floor, who))
    cut = pieces(prepared(target.where(F.col("seq").isNotNull()), config), config).select(dataset, "offset", "seq")
    kind = cut.schema[dataset].dataType.simpleString()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for part, data, begin, sizes in sliced(batches):
            place, _, found = seed_arrays(data, config, begin[part.column("offset").to_numpy() > 0])
            hit = among(found, known)
            row = np.repeat(np.arange(len(sizes)), sizes)[place[hit]]
            pairs = np.unique((row << 32) | np.searchsorted(known, found[hit]))
            rows, counts = np.unique(pairs >> 32, return_counts=True)
            ends = pa.array((4 * np.r_[0, np.cumsum(counts)]).astype(np.int32))
            body = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer((pairs & 0xFFFFFFFF).astype(np.int32).tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(dataset).take(pa.array(rows)), body], names=[dataset, "held"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, begins, whose, n, floor, who = shared.value

        def told(at: np.ndarray) -> tuple:
            sizes = begins[at + 1] - begins[at]
            place = np.repeat(begins[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            few = len(floor) <= 4 * len(place) + 1024
            some, back = (np.arange(len(floor)), whose[place]) if few else np.unique(whose[place], return_inverse=True)
            sums = np.bincount(back, n[place], len(some)).astype(np.int64)
            kept = np.flatnonzero(sums >= floor[some])
            return some[kept], sums[kept]

        def batch_of(out: list, kind: pa.DataType) -> pa.RecordBatch:
            which = pa.array(np.concatenate([x[1][0] for x in out]))
            own = pa.array([x[0] for x in out], kind).take(pa.array(np.repeat(np.arange(len(out)), [len(x[1][0]) for x in out])))
            return pa.RecordBatch.from_arrays([*(w.take(which) for w in who), own, pa.array(np.concatenate([x[1][1] for x in out]))], names=[*ids, dataset, "matches"])

        now, have, out, size, kind = None, None, [], 0, None
        for batch in batches:
            kind = batch.schema.field(dataset).type
            for name, body in zip(batch.column(dataset).to_pylist(), batch.column("held"), strict=True):
                at = np.frombuffer(body.as_buffer(), np.int32).astype(np.int64)
                if have is not None and name == now:
                    have = np.union1d(have, at)
                    continue
                if have is not None:
                    out.append((now, told(have)))
                    size += len(out[-1][1][0])
                now, have = name, at
                if size > 1 << 16 or len(out) > 1 << 12:
                    yield batch_of(out, kind)
                    out, size = [], 0
        if have is not None:
            yield batch_of([*out, (now, told(have))], kind)

    fields = ", ".join(f"{c} {weighted.schema[c].dataType.simpleString()}" for c in ids)
    dealt = cut.mapInArrow(held, f"{dataset} {kind}, held binary").repartition(F.col(dataset)).sortWithinPartitions(dataset)
    return dealt.mapInArrow(counted, f"{fields}, {dataset} {kind}, matches long")


def _matched(target: DataFrame | Index, config: SeedConfig, weighted: DataFrame, ids: list[str], dataset: str, most_keys: int, least: float = 0.0) -> DataFrame:
    sequences = target.sequences if isinstance(target, Index) else target
    found = None if sequences is None else _counted_in_tasks(sequences, config, weighted, ids, dataset, most_keys, least)
    return _counted(hits_of(target, config, weighted, dataset, most_keys), weighted, ids, dataset) if found is None else found


def _findere(hits: DataFrame, placed: DataFrame, config: SeedConfig, ids: list[str], dataset: str) -> DataFrame:
    """Positions where z + 1 windows in a row hit the same dataset, within a run of one record."""
    frame = Window.partitionBy(*ids, "run", dataset).orderBy("pos").rangeBetween(-config.z, 0)
    held = placed.join(hits, "key").withColumn("held", F.count("*").over(frame))
    return held.where(F.col("held") == config.z + 1).groupBy(*ids, dataset).agg(F.count("*").alias("matches"))


def matches(target: DataFrame | Index, queries: DataFrame, config: SeedConfig, query: str = "query_id", dataset: str = "dataset_id", most_keys: int = BROADCAST_KEYS, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(query, dataset, matches) of every pair with a match, and (query, queried_seeds) of every query; pairs below the share ``least`` may be left out."""
    every = queries.select(query).distinct()
    placed = seeds(queries, config, [query])
    if config.mode == "findere":
        hits = hits_of(target, config, placed, dataset, most_keys)
        found = _findere(hits, placed, config, [query], dataset)
        # a position counts once the window of k bases that ends there is whole
        ends = placed.withColumn("before", F.count("*").over(Window.partitionBy(query, "run").orderBy("pos").rangeBetween(-config.z, 0)))
        totals = ends.where(F.col("before") == config.z + 1).groupBy(query).agg(F.count("*").alias("queried_seeds"))
    elif config.strobes:
        both = placed.select(query, F.lit(0).alias("strand"), "key").union(seeds(queries, config, [query], reverse=True).select(query, F.lit(1).alias("strand"), "key"))
        weighted = both.groupBy(query, "strand", "key").agg(F.count("*").alias("n"))
        found = _matched(target, config, weighted, [query, "strand"], dataset, most_keys).groupBy(query, dataset).agg(F.max("matches").alias("matches"))
        totals = placed.groupBy(query).agg(F.count("*").alias("queried_seeds"))
    else:
        weighted = placed.groupBy(query, "key").agg(F.count("*").alias("n"))
        found = _matched(target, config, weighted, [query], dataset, most_keys, least)
        totals = weighted.groupBy(query).agg(F.sum("n").alias("queried_seeds"))
    return found, every.join(totals, query, "left").na.fill(0, ["queried_seeds"])


def _with_ratio(found: DataFrame) -> DataFrame:
    ratio = F.when(F.col("queried_seeds") > 0, F.col("matches").cast("double") / F.col("queried_seeds")).otherwise(F.lit(0.0))
    return found.withColumn("ratio", ratio)


def records(target: DataFrame | Index, queries: DataFrame, config: SeedConfig, min_ratio: float = 0.0, datasets: DataFrame | None = None, query: str = "query_id", dataset: str = "dataset_id", most_keys: int = BROADCAST_KEYS) -> DataFrame:
    """query, dataset, matches, queried_seeds, ratio of the pairs that reach ``min_ratio``.

    At 0 every query is paired with every row of ``datasets``, zero counts
    included: as many rows as the answer asks for.
    """
    found, totals = matches(target, queries, config, query, dataset, most_keys, min_ratio)
    if min_ratio > 0:
        return _with_ratio(found.join(totals, query)).where(F.col("ratio") >= min_ratio).select(query, dataset, "matches", "queried_seeds", "ratio")
    if datasets is None:
        raise ValueError("with min_ratio 0 all datasets are listed: give them")
    pairs = totals.join(datasets.select(dataset).distinct())
    return _with_ratio(pairs.join(found, [query, dataset], "left").na.fill(0, ["matches"])).select(query, dataset, "matches", "queried_seeds", "ratio")


def with_no_hits(found: DataFrame, totals: DataFrame, query: str = "query_id") -> DataFrame:
    """One row with null datasets, 0 matches and ratio 0 for each query without any."""
    return totals.join(found.drop("queried_seeds"), query, "left").na.fill(0, ["matches"]).na.fill(0.0, ["ratio"])


def named(found: DataFrame, datasets: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """found with the ``dataset_name`` of each row from datasets(dataset, name); null where a query hit none."""
    return found.join(datasets.select(dataset, F.col("name").alias("dataset_name")), dataset, "left")


def compact(found: DataFrame, totals: DataFrame, query: str = "query_id", dataset: str = "dataset_id") -> DataFrame:
    """query, valid_kmers, hits: ``id:count`` by ascending dataset, joined by commas."""
    listed = found.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(dataset, "matches"))).alias("found"))
    joined = F.array_join(F.transform("found", lambda x: F.concat(x[dataset], F.lit(":"), x["matches"])), ",")
    return totals.join(listed, query, "left").select(query, F.col("queried_seeds").alias("valid_kmers"), F.coalesce(joined, F.lit("")).alias("hits"))


def aggregate(target: DataFrame | Index, queries: DataFrame, config: SeedConfig, datasets: DataFrame, min_ratio: float = 0.0, query: str = "query_id", dataset: str = "dataset_id") -> DataFrame:
    """dataset, matches, ratio over all queries together; one row for each of ``datasets`` that reaches ``min_ratio``.

    The denominator is the number of seed occurrences; linked pairs add up
    each record's better strand.
    """
    found, totals = matches(target, queries, config, query, dataset)
    summed = found.groupBy(dataset).agg(F.sum("matches").alias("matches"))
    whole = totals.agg(F.coalesce(F.sum("queried_seeds"), F.lit(0)).alias("queried_seeds"))
    listed = datasets.join(summed, dataset, "left").na.fill(0, ["matches"]).join(F.broadcast(whole))  # one row
    return _with_ratio(listed).where(F.col("ratio") >= min_ratio).drop("queried_seeds")


def best_match(found: DataFrame, query: str = "query_id", dataset: str = "dataset_id") -> DataFrame:
    """The dataset with the most matches for each query, the first of equals (an addition)."""
    best = F.max_by(F.struct(dataset, "matches", "ratio"), F.struct("matches", -F.col(dataset)))
    return found.groupBy(query).agg(best.alias("best")).select(query, f"best.{dataset}", "best.matches", "best.ratio")
