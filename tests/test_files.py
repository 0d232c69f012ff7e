"""Sequence files, lists of files, writers and the stream."""

import bz2
import gzip
import lzma

import pytest

from seqlake import cli
from seqlake.config import SeedConfig
from seqlake.operators import search
from seqlake.sources import files, sinks
from seqlake.streaming.records import search_stream

from .test_kernels import canon, dna
from .test_search import as_dict, docs, queries

FASTA = b">one first\nACGT\nacgtn\n>two\n\nGG\n"


def test_parse():
    assert list(files.parse_records(FASTA)) == [("one", "ACGTacgtn"), ("two", "GG")]
    assert list(files.parse_records(b"@r x\nAC\nGT\n+r\nII\nII\n@s\nA\n+\n@\n")) == [("r", "ACGT"), ("s", "A")]


@pytest.mark.parametrize("wrong", [b"", b"\n\n", b"ACGT\n>a\nA\n", b">\nACGT\n", b"> x\nA\n", b">a\nAC GT\n", b"@a\nACGT\n+\nIII\n", b"@a\nACGT\n", b">\xff\nA\n"])
def test_parse_errors(wrong):
    with pytest.raises(ValueError):
        list(files.parse_records(wrong))


def test_collection(spark, tmp_path):
    import zstandard

    packs = {"a.fa": lambda x: x, "b.fna.gz": gzip.compress, "c.fasta.bz2": bz2.compress, "d.fa.xz": lzma.compress, "e.fq.zst": zstandard.ZstdCompressor().compress}
    for name, pack in packs.items():
        (tmp_path / name).write_bytes(pack(FASTA))
    lines = ["# list", "", f"first one\t{tmp_path}/a.fa", f"second {tmp_path}/b.fna.gz", *(f"{tmp_path}/{n}" for n in list(packs)[2:])]
    listed = tmp_path / "all.fof"
    listed.write_text("\n".join(lines) + "\n")
    colors, found = files.collection(spark, str(listed))
    assert [(r.dataset_id, r.name) for r in colors.orderBy("dataset_id").collect()] == [(0, "first one"), (1, "second"), (2, "c"), (3, "d"), (4, "e")]
    assert sorted((r.dataset_id, r.record, r.seq) for r in found.collect()) == [(d, i, s) for d in range(5) for i, s in ((0, "ACGTacgtn"), (1, "GG"))]
    numbered = files.file_list(spark, str(listed), "number").orderBy("dataset_id").collect()
    assert numbered[4].name == "00000004"
    with pytest.raises(Exception, match="more than 3"):
        files.sequence_records(spark, [f"{tmp_path}/a.fa"], 3).collect()
    (tmp_path / "damaged.fa.gz").write_bytes(gzip.compress(FASTA)[:-6])
    with pytest.raises(Exception):
        files.sequence_records(spark, [f"{tmp_path}/damaged.fa.gz"]).collect()


def test_compression_is_told_by_content_and_bounded_while_read(spark, tmp_path):
    (tmp_path / "plain.gz").write_bytes(FASTA)
    (tmp_path / "packed.fa").write_bytes(gzip.compress(FASTA[:20]) + gzip.compress(FASTA[20:]))
    found = files.sequence_records(spark, [f"{tmp_path}/plain.gz", f"{tmp_path}/packed.fa"]).collect()
    assert sorted((r.record, r.seq) for r in found) == [(0, "ACGTacgtn")] * 2 + [(1, "GG")] * 2
    bomb = gzip.compress(b">a\n" + b"A" * 50_000_000)
    stream = files.opened("bomb", bomb, 1000)
    with pytest.raises(ValueError, match="more than 1000"):
        list(files.parse_records(stream))


def test_command_line(spark, tmp_path, capsys):
    one, two = dna(400, 21), dna(400, 22)
    for name, seq in (("one.fa", one), ("two.fa", two)):
        (tmp_path / name).write_bytes(b">r\n" + seq + b"\n")
    (tmp_path / "a.fof").write_text(f"{tmp_path}/one.fa\n")
    (tmp_path / "b.fof").write_text(f"second\t{tmp_path}/two.fa\n")
    (tmp_path / "q.fa").write_bytes(b">q1\n" + one[50:150] + b"\n>q2\n" + dna(90, 23) + b"\n")
    for name in "ab":
        cli.main(["build", "--files", f"{tmp_path}/{name}.fof", "--out", f"{tmp_path}/{name}", "--k", "21", "--partitions", "4"], spark)
    cli.main(["fuse", f"{tmp_path}/a", f"{tmp_path}/b", "--out", f"{tmp_path}/both"], spark)
    cli.main(["query", f"{tmp_path}/both", f"{tmp_path}/q.fa", "--out", f"{tmp_path}/records", "--records", "--min-ratio", "0.5"], spark)
    shown = sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/records", sep="\t", header=True).collect())
    assert shown == [("q1", "0", "one", "80", "80", "1.00000000"), ("q2", ".", ".", "0", "70", "0.00000000")]
    cli.main(["query", f"{tmp_path}/both", f"{tmp_path}/q.fa", "--out", f"{tmp_path}/all"], spark)
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/all", sep="\t", header=True).collect()) == [("0", "one", "80", "0.53333333"), ("1", "second", "0", "0.00000000")]
    cli.main(["query", f"{tmp_path}/both", f"{tmp_path}/q.fa", "--out", f"{tmp_path}/short", "--compact", "--min-ratio", "0.5"], spark)
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/short", sep="\t", header=True).collect()) == [("q1", "80", "0:80"), ("q2", "70", None)]
    cli.main(["info", f"{tmp_path}/both"], spark)
    said = capsys.readouterr().out
    assert "second" in said and "partitions" in said
    with pytest.raises(Exception):
        cli.main(["build", "--files", f"{tmp_path}/a.fof", "--out", f"{tmp_path}/a", "--k", "21"], spark)


def test_lineage(spark):
    listed = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, n int")
    lineage = spark.createDataFrame([("c", "p1", "s1"), ("a", "p2", "s0")], "name string, phylum string, species string")
    assert [r.name for r in files.by_lineage(listed, lineage, ["phylum", "species"]).collect()] == ["c", "a", "b"]


def test_minimizer_fasta(spark, tmp_path):
    seq = dna(120, 5)
    table = spark.createDataFrame([(0, seq.decode()), (1, "ACGT")], "record_id int, seq string")
    config = SeedConfig(mode="minimizers", k=15, m=7, scheme="hashed")
    rows = [r.value.split("\n") for r in sinks.minimizer_fasta(table, config).collect()]
    places = [int(h.rpartition("_p")[2]) for h, _ in rows]
    assert places == sorted(set(places)) and all(h.startswith(">r0_p") for h, _ in rows)
    for p, (_, s) in zip(places, rows, strict=True):
        assert canon(s.encode()) == canon(seq[p : p + 7])
    sinks.write_minimizer_fasta(table, config, str(tmp_path / "out"), gzip=True)
    with pytest.raises(Exception):
        sinks.write_minimizer_fasta(table, config, str(tmp_path / "out"))


def test_tsv(spark, tmp_path):
    found = spark.createDataFrame([("q\tx", None, 0, 0.0), ("a", 3, 5, 1 / 3)], "query_id string, dataset_id int, matches long, ratio double")
    sinks.write_tsv(found, str(tmp_path / "t"), ["query_id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert "a\t3\t5\t0.33333333" in text and '"q\tx"\t.\t0\t0.00000000' in text
    assert sinks.default_name("x").startswith("x-2")


def test_stream(spark, tmp_path):
    config = SeedConfig(k=31)
    want = as_dict(search.records(docs(spark), queries(spark), config, 0.3))
    queries(spark).write.parquet(str(tmp_path / "in"))
    got: dict = {}
    stream = spark.readStream.schema("query_id int, seq string").parquet(str(tmp_path / "in"))
    search_stream(stream, docs(spark), config, 0.3, lambda found, n: got.update(as_dict(found)), str(tmp_path / "state"), once=True).awaitTermination()
    assert got == want
