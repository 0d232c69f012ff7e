"""Searches and indexes against brute force and known cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlake.config import SeedConfig
from seqlake.functions.hashing import splitmix64, unsigned_mod, wrapping
from seqlake.functions.sequences import TEXT_BASES, TEXT_LETTERS, dataset_name, dna_of_text, homopolymer_compress, reverse_complement
from seqlake.operators import approximate, layout, postings, search
from seqlake.operators.seeds import pieces, seeds

from .test_kernels import canon, dna, rc, runs, split

SHARED = dna(210, 1)
DOCS = [SHARED + dna(90, 2), rc(SHARED) + b"N" + dna(50, 3), dna(300, 4), b"ACGT", b""]
QUERIES = [SHARED, rc(SHARED), SHARED[:60] + b"N" + dna(60, 9), dna(100, 10), b"NNNN", b"ACGT", b"", DOCS[2][50:150] * 2]


def table(spark, rows, name):
    return spark.createDataFrame([(i, s.decode()) for i, s in enumerate(rows)], f"{name} int, seq string")


def docs(spark):
    return table(spark, DOCS, "dataset_id")


def queries(spark):
    return table(spark, QUERIES, "query_id")


def kmers(s, k):
    return [canon(r[i : i + k]) for _, r in runs(s) for i in range(len(r) - k + 1)]


def brute(k, ratio):
    out = {}
    for q, s in enumerate(QUERIES):
        own = kmers(s, k)
        for d, t in enumerate(DOCS):
            known = set(kmers(t, k))
            n = sum(x in known for x in own)
            share = n / len(own) if own else 0.0
            if share >= ratio and (n or not ratio):
                out[q, d] = (n, len(own), share)
    return out


def as_dict(found):
    return {(r.query_id, r.dataset_id): (r.matches, r.queried_seeds, r.ratio) for r in found.collect()}


@pytest.mark.parametrize("most_keys", [search.BROADCAST_KEYS, 0])
def test_records(spark, most_keys):
    found = search.records(docs(spark), queries(spark), SeedConfig(k=31), 0.3, most_keys=most_keys)
    assert as_dict(found) == brute(31, 0.3)


def test_zero_threshold_lists_everything(spark):
    found = search.records(docs(spark), queries(spark), SeedConfig(k=15), 0.0, docs(spark))
    assert as_dict(found) == brute(15, 0.0)
    with pytest.raises(ValueError):
        search.records(docs(spark), queries(spark), SeedConfig(k=15))


def test_aggregate_counts_occurrences(spark):
    found = {r.dataset_id: (r.matches, r.ratio) for r in search.aggregate(docs(spark), queries(spark), SeedConfig(k=31), docs(spark).select("dataset_id")).collect()}
    pairs, total = brute(31, 0.0), sum(len(kmers(q, 31)) for q in QUERIES)
    want = {d: sum(v[0] for (q, e), v in pairs.items() if e == d) for d in range(len(DOCS))}
    assert found == {d: (n, n / total) for d, n in want.items()}


def test_no_hits_and_compact(spark):
    found, totals = search.matches(docs(spark), queries(spark), SeedConfig(k=31))
    kept = search._with_ratio(found.join(totals, "query_id")).where("ratio >= 0.5")
    rows = {r.query_id: (r.dataset_id, r.matches) for r in search.with_no_hits(kept, totals).collect()}
    assert rows[4] == (None, 0) and rows[6] == (None, 0) and len({*rows}) == len(QUERIES)
    listed = {r.query_id: (r.valid_kmers, r.hits) for r in search.compact(kept, totals).collect()}
    assert listed[0] == (180, "0:180,1:180") and listed[3][1] == ""
    best = {r.query_id: r.dataset_id for r in search.best_match(search.records(docs(spark), queries(spark), SeedConfig(k=31), 0.3)).collect()}
    assert best[0] == 0 and best[7] == 2


def test_findere_hits_of_two_datasets_do_not_add_up(spark):
    target = table(spark, [b"AAATT", b"AACCC", b"ACGGG"], "dataset_id")
    found = search.records(target, table(spark, [b"AAACG"], "query_id"), SeedConfig(mode="findere", k=5, z=2), 0.0, target)
    assert sorted(as_dict(found).values()) == [(0, 1, 0.0)] * 3


def test_findere_equals_windows_in_a_row(spark):
    k, z = 21, 6
    found = as_dict(search.records(docs(spark), queries(spark), SeedConfig(mode="findere", k=k, z=z), 0.0, docs(spark)))
    for q, s in enumerate(QUERIES):
        for d, t in enumerate(DOCS):
            known = {x for _, r in runs(t) if len(r) >= k for x in kmers(r, k - z)}
            n = sum(all(x in known for x in kmers(r[i : i + k], k - z)) for _, r in runs(s) for i in range(len(r) - k + 1))
            assert found[q, d][:2] == (n, len(kmers(s, k)))


def test_strobes_take_the_better_strand_of_each_record(spark):
    config = SeedConfig(k=11).with_strobes()
    target = table(spark, [SHARED], "dataset_id")
    both = table(spark, [SHARED, rc(SHARED)], "query_id")
    found = as_dict(search.records(target, both, config, 0.0, target))
    assert found[0, 0] == found[1, 0] == (200, 200, 1.0)
    total = search.aggregate(target, both, config, target.select("dataset_id")).collect()[0]
    assert (total.matches, total.ratio) == (400, 1.0)


def test_shared_and_private_seeds(spark):
    rows = [dna(700, 17) + dna(32, 100 + i) for i in range(4)] + [dna(4000, 91)]
    asked = [dna(700, 17), dna(32, 101)]
    found = as_dict(search.records(table(spark, rows, "dataset_id"), table(spark, asked, "query_id"), SeedConfig(k=31), 0.01))
    assert {k: v[0] for k, v in found.items()} == {(0, 0): 670, (0, 1): 670, (0, 2): 670, (0, 3): 670, (1, 1): 2}


def test_stats_masks_recovery(spark):
    config = SeedConfig(k=9)
    stats = {r.dataset_id: (r.occurrences, r.unique_kmers) for r in postings.dataset_stats(docs(spark), config).collect()}
    assert stats == {d: (len(x), len(set(x))) for d, s in enumerate(DOCS) if (x := kmers(s, 9))}
    found = postings.postings(docs(spark), config)
    masks = Counter(r["mask"] for r in postings.origin_masks(found).collect())
    want: dict = {}
    for d, s in enumerate(DOCS):
        for x in set(kmers(s, 9)):
            want[x] = want.get(x, 0) | 1 << d
    assert masks == Counter(want.values())
    recovered = {r["hash"]: r.dataset_ids for r in postings.recovery(found, config).collect()}
    for x, mask in want.items():
        h = split(x ^ 69 ^ 0xD6E8FEB86659FD93) >> 32
        assert {d for d in range(5) if mask >> d & 1} <= set(recovered[h])


def test_index_round_trip_and_fusion(spark, tmp_path):
    config = SeedConfig(k=15)
    colors = spark.createDataFrame([(i, f"c{i}", f"/p/{i}") for i in range(len(DOCS))], "dataset_id int, name string, path string")
    whole = str(tmp_path / "whole")
    postings.build(docs(spark), colors, config, whole, partitions=4)
    index = postings.load(spark, whole)
    assert index.config == config
    assert as_dict(search.records(index, queries(spark), config, 0.3)) == brute(15, 0.3)
    with pytest.raises(Exception):
        postings.build(docs(spark), colors, config, whole, partitions=4)
    halves = []
    for name, part in (("a", "dataset_id < 2"), ("b", "dataset_id >= 2")):
        shift = 0 if name == "a" else 2
        move = lambda df: df.where(part).withColumn("dataset_id", F.col("dataset_id") - shift)  # noqa: B023,E731
        postings.build(move(docs(spark)), move(colors), config, str(tmp_path / name), partitions=4)
        halves.append(postings.load(spark, str(tmp_path / name)))
    fused = postings.fuse(*halves)
    assert as_dict(search.records(fused, queries(spark), config, 0.3)) == brute(15, 0.3)
    postings.save(fused, str(tmp_path / "fused"))
    again = postings.load(spark, str(tmp_path / "fused"))
    assert [r.name for r in postings.info(again)["datasets"].collect()] == [f"c{i}" for i in range(len(DOCS))]
    other = postings.Index(SeedConfig(k=9), 4, fused.colors, fused.postings)
    with pytest.raises(ValueError):
        postings.fuse(index, other)
    with pytest.raises(ValueError):
        postings.build(docs(spark), colors, config, str(tmp_path / "big"), most_bases=100)
    assert not (tmp_path / "big").exists()


def test_fingerprints_find_all_and_little_else(spark):
    config, bits = SeedConfig(k=31), 8
    found = postings.postings(table(spark, [dna(1054, 123)], "dataset_id"), config)
    slots = approximate.slots_for(1024)
    cells = approximate.compress(found, config, slots, bits)
    own = approximate.records(cells, table(spark, [dna(1054, 123)], "query_id"), config, slots, bits, 0.0).collect()
    assert own[0].matches == 1024
    n = 20_000
    absent = approximate.records(cells, table(spark, [dna(n + 30, 999)], "query_id"), config, slots, bits, 0.0).collect()
    expected = n * 2**-bits
    assert abs((absent[0].matches if absent else 0) - expected) <= 8 * expected**0.5 + 8
    with pytest.raises(ValueError):
        approximate.compress(found, config, slots, 3)


def test_sketches(spark):
    found = postings.postings(table(spark, [dna(3000, 1), dna(3000, 1), dna(3000, 1)[:1500] + dna(1500, 2)], "dataset_id"), SeedConfig(k=21))
    pairs = {(r.a, r.b): (r.jaccard, r.union_estimate) for r in layout.jaccard_pairs(layout.sketches(found)).collect()}
    assert pairs[0, 1] == (1.0, 2980)
    assert 0.15 < pairs[0, 2][0] < 0.55
    counts = layout.partition_counts(found, 8).collect()
    assert sum(r.postings for r in counts) == found.count() and len(counts) == 8


def test_long_sequences_are_cut_without_a_trace(spark):
    config = SeedConfig(k=15)
    one = docs(spark)
    cut = pieces(one, config, size=40)
    places = sorted((r.dataset_id, r.offset, len(r.seq)) for r in cut.collect())
    assert len(places) > 20
    whole = Counter((r.dataset_id, r.key) for r in seeds(one, config, ["dataset_id"]).collect())
    parts = Counter((r.dataset_id, r.key) for r in seeds(cut.drop("offset"), config, ["dataset_id"]).collect())
    assert whole == parts


@pytest.mark.parametrize("scheme", ["open-closed-mod", "hashed"])
@pytest.mark.parametrize("size", [7, 40, 111])
def test_minimizers_of_pieces_are_those_of_the_whole(spark, scheme, size):
    config = SeedConfig(mode="minimizers", k=21, m=11, scheme=scheme)
    places = lambda **how: sorted((r.dataset_id, r.pos, r.key) for r in seeds(docs(spark), config, ["dataset_id"], **how).collect())
    assert places(size=size) == places() != []


def test_words_hold_any_number_of_datasets(spark):
    rows = [(k, d) for k in range(3) for d in range(0, 100, k + 1)]
    made = spark.createDataFrame(rows + rows[:5], "key long, dataset_id int")
    found = {}
    for r in postings.origin_words(made).collect():
        found.setdefault(r.key, set()).update(63 * r.word + b for b in range(63) if r.mask >> b & 1)
    assert found == {k: set(range(0, 100, k + 1)) for k in range(3)}


def test_fusion_of_numbers_with_gaps(spark):
    config = SeedConfig(k=21)

    def index(ids):
        names = spark.createDataFrame([(i, f"n{i}") for i in ids], "dataset_id int, name string")
        found = spark.createDataFrame([(100 + i, i, 0) for i in ids], "key long, dataset_id int, partition int")
        return postings.Index(config, 1, names, found)

    fused = postings.fuse(index([1, 2]), index([0, 1]), index([5]))
    names = {r.dataset_id: r.name for r in fused.colors.collect()}
    assert len(names) == 5 and all(names[r.dataset_id] == f"n{r.key - 100}" for r in fused.postings.collect())


def test_columns(spark):
    rows = spark.createDataFrame([("aaCCgtNNTT",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(homopolymer_compress(F.col("s"))).collect()] == ["ACGTNNT", "", None]
    assert [r[0] for r in rows.select(reverse_complement(F.col("s"))).collect()] == ["AANNACGGTT", "", None]
    names = [("/a/x.fna.gz", "x"), ("y.fa", "y"), (".fa", "color"), ("z.gz.fa", "z.gz"), ("/q/w", "w")]
    found = spark.createDataFrame(names, "path string, want string").select(dataset_name(F.col("path")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in found)
    with wrapping(spark):
        hashed = spark.createDataFrame([(0,), (-5,), (1 << 40,)], "x long").select("x", splitmix64(F.col("x")).alias("h"))
        hashed = hashed.withColumn("m", unsigned_mod(F.col("h"), 7))
    for r in hashed.collect():
        assert r.h & (1 << 64) - 1 == split(r.x & (1 << 64) - 1) and r.m == (r.h & (1 << 64) - 1) % 7


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "dataset_id int, seq string")
    assert search.records(none, queries(spark), SeedConfig(k=31), 0.5).collect() == []
    nulls = spark.createDataFrame([(0, None), (1, SHARED.decode())], "query_id int, seq string")
    found, totals = search.matches(docs(spark), nulls, SeedConfig(k=31))
    assert {r.query_id: r.queried_seeds for r in totals.collect()} == {0: 0, 1: 180}


def test_masks_refuse_datasets_without_a_bit_of_their_own(spark):
    made = spark.createDataFrame([(1, 0), (1, 62), (2, 3)], "key long, dataset_id int")
    assert {r.key: r.mask for r in postings.origin_masks(made).collect()} == {1: 1 | 1 << 62, 2: 8}
    for beyond in (63, 64, -1):
        with pytest.raises(Exception, match="0 to 62"):
            postings.origin_masks(spark.createDataFrame([(1, beyond)], "key long, dataset_id int")).collect()


def test_bases_of_texts_take_no_pattern(spark):
    rows = [("aé\nÖZz\x00 1\x80ÿ€😀bKKİiß\r\n",), ("",), (None,), ("\0",), ("The end.\nN",)]
    made = spark.createDataFrame(rows, "text string").select("text", dna_of_text(F.col("text")).alias("seq"))
    table = dict(zip(TEXT_LETTERS, TEXT_BASES, strict=True))
    want = [None if t is None else "".join(table[c.lower()] for c in t if c.isascii() and (c.isalpha() or c == "\n")) for (t,) in rows]
    assert [r.seq for r in made.collect()] == want
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
