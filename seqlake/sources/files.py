"""Sequence files: lists of files, FASTA and FASTQ, lineage tables.

Files are read by Spark (``binaryFile``), so any store that Spark reads will
do; each file is parsed in a task, as a stream.  Compression is told by a
file's first bytes: gz, bz2 and xz by the standard library, zst by zstandard.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.functions.sequences import dataset_name


def file_list(spark: SparkSession, path: str, default_names: str = "file") -> DataFrame:
    """dataset_id, name, path of a list of files, in its order.

    Blank lines and lines that begin with # are skipped; ``name<TAB>path``,
    ``name path`` and a bare path are read.  A bare path is named after its
    file, or with ``default_names="number"`` by its eight-digit number.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    lines = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    number = (F.row_number().over(Window.orderBy("line")) - 1).cast("int")  # a list of files is small
    tabs, words = F.split("value", "\t"), F.split(F.trim("value"), r"\s+")
    tabbed, spaced = F.col("value").contains("\t"), F.size(words) >= 2
    where = F.when(tabbed, F.trim(F.get(tabs, 1))).when(spaced, F.get(words, 1)).otherwise(F.trim("value"))
    listed = lines.select(number.alias("dataset_id"), F.when(tabbed, F.trim(F.get(tabs, 0))).when(spaced, F.get(words, 0)).alias("given"), where.alias("path"))
    derived = F.lpad(F.col("dataset_id").cast("string"), 8, "0") if default_names == "number" else dataset_name(F.col("path"))
    name = F.coalesce("given", derived)
    checked = F.when(name == "", F.raise_error(F.lit("a dataset has an empty name"))).otherwise(name)
    return listed.select("dataset_id", checked.alias("name"), "path")


#: The first bytes of compressed files.
MAGIC = {b"\x1f\x8b": "gz", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zst"}
#: Bases in one batch of records.
BATCH = 4 << 20


class _Bounded(io.RawIOBase):
    """Fails once more than ``most`` bytes have been read from ``inner``."""

    def __init__(self, inner: IO[bytes], most: int | None, path: str):
        self._inner, self._most, self._path, self._read = inner, most, path, 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self._inner.read(len(buffer))
        self._read += len(data)
        if self._most is not None and self._read > self._most:
            raise ValueError(f"{self._path} holds more than {self._most} bytes")
        buffer[: len(data)] = data
        return len(data)


def opened(path: str, data: bytes, most: int | None = None) -> IO[bytes]:
    """A stream of what a file holds, decompressed as it is read; compression is told by the first bytes."""
    raw: IO[bytes] = io.BytesIO(data)
    kind = next((k for m, k in MAGIC.items() if data.startswith(m)), None)
    if kind == "gz":
        raw = gzip.GzipFile(fileobj=raw)
    elif kind == "bz2":
        raw = bz2.BZ2File(raw)
    elif kind == "xz":
        raw = lzma.LZMAFile(raw)
    elif kind == "zst":
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return io.BufferedReader(_Bounded(raw, most, path), 1 << 16)


class _Lines:
    """Lines of a stream without their ends, the next of which can be looked at."""

    def __init__(self, stream: IO[bytes]):
        self._stream = stream
        self.next: bytes | None = None
        self.take()

    def take(self) -> bytes | None:
        line, raw = self.next, self._stream.readline()
        self.next = (raw[:-2] if raw.endswith(b"\r\n") else raw.removesuffix(b"\n")) if raw else None
        return line


def parse_records(data: bytes | IO[bytes]) -> Iterator[tuple[str, str]]:
    """(name, sequence) of each FASTA or FASTQ record; sequences may span lines.

    Errors: no record, an empty name or one that is not UTF-8, a sequence
    before the first header, white space inside a sequence, a quality shorter
    or longer than its sequence.
    """
    lines, n = _Lines(io.BytesIO(data) if isinstance(data, bytes) else data), 0

    def name_of(line: bytes) -> str:
        words = line[1:].split(None, 1)
        if not words or line[1:2].isspace():
            raise ValueError(f"record {n + 1} has no name")
        return words[0].decode()

    def body(stop: bytes) -> bytes:
        parts = []
        while lines.next is not None and not lines.next.startswith(stop):
            part = lines.take().rstrip()
            if len(part.split()) > 1 or part[:1].isspace():
                raise ValueError(f"white space in the sequence of record {n + 1}")
            parts.append(part)
        return b"".join(parts)

    while (line := lines.take()) is not None:
        if not line.strip():
            continue
        if line.startswith(b">"):
            name = name_of(line)
            yield name, body(b">").decode("latin-1")
        elif line.startswith(b"@"):
            name, seq = name_of(line), body(b"+")
            if lines.take() is None:
                raise ValueError(f"record {n + 1} ends before its quality")
            quality = 0
            while lines.next is not None and quality < len(seq):
                quality += len(lines.take().rstrip())
            if quality != len(seq):
                raise ValueError(f"record {n + 1} has {len(seq)} bases and {quality} qualities")
            yield name, seq.decode("latin-1")
        else:
            raise ValueError("a sequence stands before the first header")
        n += 1
    if not n:
        raise ValueError("no sequence records")


def sequence_records(spark: SparkSession, paths: list[str] | str, most_bytes: int | None = None) -> DataFrame:
    """path, record, name, seq of each record; ``most_bytes`` is the most that a file may hold once opened.

    Files are decompressed and parsed as a stream, in batches of about
    ``BATCH`` bases; a task fails as soon as its file has given more than
    ``most_bytes``.  A file's stored bytes are one row, so 2 GB at most.
    """
    names = ["path", "record", "name", "seq"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, held = [], 0
                for number, (name, seq) in enumerate(parse_records(opened(path, content.as_py(), most_bytes))):
                    rows.append((path, number, name, seq))
                    held += len(seq)
                    if held >= BATCH:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, record long, name string, seq string")


def collection(spark: SparkSession, list_path: str, default_names: str = "file") -> tuple[DataFrame, DataFrame]:
    """(dataset_id, name, path) and (dataset_id, record, name, seq) of a list of files."""
    colors = file_list(spark, list_path, default_names)
    paths = [r["path"] for r in colors.select("path").distinct().collect()]
    if not paths:
        raise ValueError("the list names no file")
    plain = F.regexp_replace("path", "^file:(//)?", "")
    found = sequence_records(spark, paths).withColumn("path", plain)
    keyed = colors.select("dataset_id", plain.alias("path"))
    return colors, found.join(keyed, "path").select("dataset_id", "record", "name", "seq")


def lineage_order(ranks: list[str], name: str = "name") -> list:
    """By the ranks, then the name; rows without a lineage last."""
    return [F.col("has_lineage").desc(), *ranks, name]


def by_lineage(listed: DataFrame, lineage: DataFrame, ranks: list[str], name: str = "name") -> DataFrame:
    """listed in taxonomic order: by the ranks, then the name; datasets without a lineage last."""
    return with_lineage(listed, lineage, ranks, name).orderBy(*lineage_order(ranks, name)).drop("has_lineage")


def with_lineage(listed: DataFrame, lineage: DataFrame, ranks: list[str], name: str = "name") -> DataFrame:
    """listed with its ranks and ``has_lineage``; a name that has several lineages gets the first of them."""
    known = lineage.groupBy(name).agg(F.min(F.struct(*ranks)).alias("of")).select(name, "of.*", F.lit(True).alias("has_lineage"))
    return listed.join(known, name, "left").na.fill(False, ["has_lineage"])
