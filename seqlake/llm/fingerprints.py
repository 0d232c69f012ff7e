"""Context-triggered piecewise hashes of documents.

A rolling hash of the last seven bytes decides where a piece ends; each piece
gives one character of the signature.  The block size, 3 times a power of
two, grows with the length, and a fingerprint holds the signatures at its
block size and at twice that, so that texts whose sizes differ by a factor
of two can still be compared.  Likeness is 1 less the edit distance (insert,
delete) by the lengths of both signatures, 0 where block sizes are not
compatible or the signatures share no run of ``SHARED`` characters.

Defined results: null text is empty, whose fingerprint is ``3::``; equal
fingerprints are alike by 1; rows with equal ids stand in the order of their
texts' hashes and a null id comes last; the only row of a table is its own
next one; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, write_shared

LEAST_BLOCK, MOST_PIECES, WINDOW, SHARED = 3, 64, 7, 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _signature(data, rolling, block: int) -> str:
    import numpy as np

    ends = np.flatnonzero(rolling % np.uint32(block) == block - 1)[: MOST_PIECES - 1] + 1
    begins = np.r_[0, ends] if not len(ends) or ends[-1] < len(data) else np.r_[0, ends[:-1]]
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.r_[begins, len(data)]))
    each = _mix(data * np.uint32(0x01000193) + _mix(place.astype(np.uint32)))
    codes = _mix(np.add.reduceat(each, begins).astype(np.uint32)) >> np.uint32(26)
    return "".join(map(ALPHABET.__getitem__, codes.tolist()))


def fingerprint(body: bytes) -> str:
    """block:signature:signature at twice the block."""
    import numpy as np

    if not body:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(body, np.uint8).astype(np.uint32) + np.uint32(1)
    rolling = np.zeros(len(data), np.uint32)
    for k in range(min(WINDOW, len(data))):
        rolling[k:] += data[: len(data) - k] * np.uint32(pow(0x2C1B3C6D, k + 1, 1 << 32))
    rolling = _mix(rolling)
    block = LEAST_BLOCK
    while block * MOST_PIECES < len(data):
        block *= 2
    while True:
        one = _signature(data, rolling, block)
        if len(one) >= MOST_PIECES // 2 or block == LEAST_BLOCK:
            return f"{block}:{one}:{_signature(data, rolling, 2 * block)}"
        block //= 2


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = min(SHARED, len(a), len(b))
    if not n or {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2) if min(len(a2), len(b2)) >= SHARED else 0.0)
    return _alike(a1, b2) if m == 2 * n else _alike(a2, b1) if n == 2 * m else 0.0


def edited(text: str, following: str) -> str:
    """The text with its second half's code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(text: str, print_of: str, following: str, print_next: str) -> tuple:
    changed = edited(text, following).encode()
    made = fingerprint(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), print_of, made, likeness(print_of, made), likeness(print_of, print_next)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
DONE, HEAD, TAIL = 0, 1, 2


def _consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: results of all rows but the last, and the first and last text."""
    from pyspark import TaskContext

    here = TaskContext.get().partitionId()
    last = None
    for part in (p for b in batches for p in slices(b)):
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            own = (doc_id, text, fingerprint(text.encode()))
            if last is None:
                rows.append((HEAD, text, doc_id, *[None] * 6))
            else:
                rows.append((DONE, None, last[0], *_compare(last[1], last[2], text, own[2])))
            last = own
        yield _rows(here, rows)
    if last is not None:
        yield _rows(here, [(TAIL, last[1], last[0], *[None] * 6)])


def _rows(here: int, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), *_TYPES]
    return pa.RecordBatch.from_arrays([pa.array([here] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["part", "kind", "text", *_NAMES])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *_compare(t, fingerprint(t.encode()), f, fingerprint(f.encode()))) for i, t, f in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "following")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_TYPES)], names=_NAMES)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit by the next one in descending order of doc_id, after the last the first.

    One range shuffle of the texts; inside a partition rows are compared as
    they stream past, and the last of each with the first of the next.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    bodies = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = bodies.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = write_shared(dealt.mapInArrow(frugal(_consecutive), f"part int, kind int, text string, {_RESULT}"), "fingerprints")

    # the next partition that has rows: as many numbers as there are partitions
    full = sorted(r["part"] for r in made.where(F.col("kind") == HEAD).select("part").collect())
    pairs = spark.createDataFrame(list(zip(full, [*full[1:], *full[:1]], strict=True)), "part int, next_part int")
    heads = made.where(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = made.where(F.col("kind") == TAIL).select("part", "doc_id", "text").join(pairs, "part").join(heads, "next_part")
    ends = tails.select("doc_id", "text", "following").mapInArrow(frugal(_ends), _RESULT)
    return made.where(F.col("kind") == DONE).select(*_NAMES).union(ends)
