"""Sums by bins of keys, and counts of searches in tasks, against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlake.config import SeedConfig
from seqlake.functions.hashing import partition_of, wrapping
from seqlake.functions.sequences import dna_of_text
from seqlake.operators import approximate, bins, layout, postings, search
from seqlake.operators.seeds import seeds

from .test_kernels import dna
from .test_search import DOCS, as_dict, brute, docs, kmers, queries, table


@pytest.mark.parametrize("together", [0, 1 << 22])
@pytest.mark.parametrize("k", [1, 3, 15, 16, 17, 31, 32, 40])
def test_stats_of_rows_that_repeat_a_dataset(spark, k, together, monkeypatch):
    monkeypatch.setattr(bins, "TOGETHER", together)
    config = SeedConfig(k=k)
    twice = docs(spark).union(docs(spark).where("dataset_id < 2")).union(table(spark, [b"ACGT" * 300], "dataset_id"))
    rows = [[s] for s in DOCS]
    rows[0] += [DOCS[0], b"ACGT" * 300]
    rows[1] += [DOCS[1]]
    want = {}
    for d, own in enumerate(rows):
        if x := [key for s in own for key in (kmers(s, k) if k <= 32 else [])]:
            want[d] = (len(x), len(set(x)))
    found = {r.dataset_id: (r.occurrences, r.unique_kmers) for r in postings.dataset_stats(twice, config).collect()}
    assert found == want if k <= 32 else {d: n for d, (n, _) in found.items()} == {d: sum(max(0, len(r) - k + 1) for s in own for r in s.split(b"N")) for d, own in enumerate(rows) if any(len(r) >= k for s in own for r in s.split(b"N"))}


def test_masks_words_recovery_and_partitions_agree_with_their_tables(spark):
    config, many = SeedConfig(k=15), table(spark, DOCS * 20, "dataset_id")
    found = postings.postings(docs(spark), config)
    assert sorted((r.dataset_id, r.key) for r in found.collect()) == sorted({(d, x) for d, s in enumerate(DOCS) for x in kmers(s, 15)})
    masks = {r["mask"]: r["keys"] for r in postings.mask_counts(docs(spark), config).collect()}
    assert masks == Counter(r["mask"] for r in postings.origin_masks(found).collect())
    words = sorted(map(tuple, postings.word_counts(many, config).collect()))
    wide = postings.origin_words(postings.occurrences(many, config)).groupBy("word").agg(F.count("*"), F.sum(F.bit_count("mask")))
    assert words == sorted(map(tuple, wide.collect()))
    recovered = sorted((r["hash"], r.dataset_ids) for r in postings.recovery_of(docs(spark), config).collect())
    assert recovered == sorted((r["hash"], r.dataset_ids) for r in postings.recovery(found, config).collect())
    assert sorted(map(tuple, layout.partition_counts_of(docs(spark), config, 8).collect())) == sorted(map(tuple, layout.partition_counts(found, 8).collect()))
    assert sorted(map(tuple, layout.sketches_of(docs(spark), config, 16).collect())) == sorted(map(tuple, layout.sketches(found, 16).collect()))
    with pytest.raises(Exception, match="0 to 62"):
        postings.mask_counts(many, config).collect()


def test_many_keys_of_a_bin_are_merged_on_the_way(spark):
    # more seeds of one key than are held at once
    made = spark.range(60).select(F.col("id").cast("int").alias("dataset_id"), F.expr("repeat('A', 100000)").alias("seq"))
    found = postings.dataset_stats(made.withColumn("dataset_id", F.col("dataset_id") % 3), SeedConfig(k=31)).collect()
    assert sorted(map(tuple, found)) == [(d, 20 * (100000 - 30), 1) for d in range(3)]


def test_counts_in_tasks_equal_those_of_the_join(spark):
    config, split = SeedConfig(k=8, pattern="##_##_##"), docs(spark).union(table(spark, [dna(90, 2)], "dataset_id"))
    both = [as_dict(search.records(split, queries(spark), config, 0.5, most_keys=most)) for most in (search.BROADCAST_KEYS, 0)]
    assert both[0] == both[1] != {}
    found, _ = search.matches(docs(spark), queries(spark), SeedConfig(k=31))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fused_sequences_and_cells_make_only_what_is_asked(spark):
    config = SeedConfig(k=31)

    def index(part):
        own = docs(spark).where(part)
        return postings.Index(config, 1, own.select("dataset_id", F.col("dataset_id").cast("string").alias("name")), postings.postings(own, config).withColumn("partition", F.lit(0)), own)

    fused = postings.fuse(index("dataset_id < 2"), index("dataset_id >= 2"))
    found = search.records(fused, queries(spark), config, 0.3).join(fused.colors, "dataset_id").select("query_id", F.col("name").cast("int").alias("dataset_id"), "matches", "queried_seeds", "ratio")
    assert as_dict(found) == brute(31, 0.3)
    cells = approximate.compress(postings.postings(docs(spark), config), config, 1 << 10, 8)
    slow = as_dict(approximate.records(cells, queries(spark), config, 1 << 10, 8, 0.1))
    assert as_dict(approximate.search(docs(spark), queries(spark), config, 1 << 10, 8, 0.1)) == slow
    assert as_dict(approximate.search(docs(spark), queries(spark), config, 1 << 10, 8, 0.1, most_keys=0)) == slow


@pytest.mark.parametrize("writers", [postings.WRITERS, 2])
def test_built_postings_lie_in_their_partitions_and_hold_their_counts(spark, tmp_path, monkeypatch, writers):
    monkeypatch.setattr(postings, "WRITERS", writers)  # beyond that many, rows are sorted by partition
    monkeypatch.setattr(bins, "HELD", 200)
    config, path = SeedConfig(k=9), str(tmp_path / "index")
    twice = docs(spark).union(docs(spark)).union(spark.createDataFrame([(1, None), (9, None)], "dataset_id int, seq string"))
    colors = spark.createDataFrame([(i, f"c{i}", "") for i in (*range(len(DOCS)), 9)], "dataset_id int, name string, path string")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    with postings._side_by_side(spark, 8):  # Spark goes over to sorting at that number, not beyond it
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == min(8, writers) + 1
    postings.build(twice, colors, config, path, partitions=8)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    own = {d: Counter(kmers(s, 9)) for d, s in enumerate(DOCS)}
    rows = spark.read.parquet(f"{path}/postings")
    with wrapping(spark):
        placed = rows.withColumn("own", partition_of(F.col("key"), config.seed, 8))
    assert placed.where("own <> partition").count() == 0
    assert sorted((r.dataset_id, r.key, r.n) for r in rows.collect()) == sorted((d, x, 2 * n) for d, had in own.items() for x, n in had.items())
    index = postings.load(spark, path)
    assert set(index.postings.columns) == {"partition", "key", "dataset_id"}
    stats = {r.dataset_id: (r.occurrences, r.unique_kmers) for r in index.colors.collect()}
    assert stats == {9: (0, 0), **{d: (2 * sum(had.values()), len(had)) for d, had in own.items()}}


def test_an_index_is_searched_without_a_shuffle_of_its_postings(spark, tmp_path):
    config, path = SeedConfig(k=31), str(tmp_path / "index")
    colors = spark.createDataFrame([(i, f"c{i}", "") for i in range(len(DOCS))], "dataset_id int, name string, path string")
    postings.build(docs(spark), colors, config, path, partitions=8)
    index = postings.load(spark, path)
    one = table(spark, [DOCS[2][:31]], "query_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = search.hits_of(index, config, seeds(one, config, ["query_id"]))
        assert [r.dataset_id for r in hits.collect()] == [2]
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    own = postings.routed(index, seeds(one, config, ["query_id"])).first()["partition"]
    assert re.search(rf"\(partition#\d+ = {own}\)", hits._jdf.queryExecution().optimizedPlan().toString())
    for most in (search.BROADCAST_KEYS, 0):
        assert as_dict(search.records(index, queries(spark), config, 0.3, most_keys=most)) == brute(31, 0.3)


def test_texts_become_bases_once(spark):
    made = spark.createDataFrame([(0, "The end of all things."), (1, None)], "dataset_id int, text string").select("dataset_id", dna_of_text(F.col("text")).alias("seq"))
    found = postings.postings(made, SeedConfig(k=5))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert found.where("dataset_id = 1").count() == 0 < found.count()
