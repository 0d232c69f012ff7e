"""Token matrices by best-fit-decreasing packing with a segment tree of capacities.

Each task packs blocks of up to ``BLOCK_DOCS`` of its documents, so nothing is
shuffled.  Documents over the window are split into full windows and a rest;
pieces are placed by falling length into the sequence whose free room is the
least that suffices, found in a segment tree over capacities.  A row is one
sequence: its padded ids, cumulative segment lengths and the positions, which
start from 0 in every segment.

Defined results: null text is empty and gives the separator alone; repeated
rows are packed each; a null doc_id is carried along; equal lengths go in
input order; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import frugal, slices

WINDOW, BLOCK_DOCS, BLOCK_TOKENS = 1024, 4096, 4 << 20
#: Bytes of text that a task encodes at once; its distinct units are encoded once.
TEXT_BYTES = 8 << 20


class Capacities:
    """Counts of open sequences by free room; finds the least room that suffices in log time."""

    def __init__(self, most: int):
        self._size = 1 << most.bit_length()
        self._tree = [0] * (2 * self._size)

    def add(self, room: int, n: int = 1) -> None:
        i = room + self._size
        while i:
            self._tree[i] += n
            i >>= 1

    def least(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that some sequence has."""
        tree, i = self._tree, need + self._size
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self._size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self._size


def best_fit(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); each token of each document is in one piece."""
    pieces = [(d, s, min(window, n - s)) for d, n in enumerate(lengths) for s in range(0, n, window)]
    pieces.sort(key=lambda p: -p[2])
    free = Capacities(window)
    by_room: dict[int, list[int]] = {}
    out: list[list[tuple[int, int, int]]] = []
    for piece in pieces:
        room = free.least(piece[2])
        if room is None:
            at, room = len(out), window
            out.append([])
        else:
            at = by_room[room].pop()
            free.add(room, -1)
        out[at].append(piece)
        if room > piece[2]:
            by_room.setdefault(room - piece[2], []).append(at)
            free.add(room - piece[2])
    return out


def matrices(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int | None = 0, padding: int = 0, digests: bool = False) -> DataFrame:
    """A row for each sequence: sequence_id, doc_ids, doc_starts, cu_seqlens, n_tokens and either ids and positions (binary, little-endian 32-bit, ``window`` each) or their crc32."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = "long" if digests else "binary"
    names = ["sequence_id", "doc_ids", "doc_starts", "cu_seqlens", "n_tokens", *(("ids_crc32", "positions_crc32") if digests else ("ids", "positions"))]
    schema = f"sequence_id long, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, n_tokens long, {names[5]} {kind}, {names[6]} {kind}"
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), *[pa.int64() if digests else pa.binary()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        coder, sequence = bpe.of_worker(shared.value, by_ranks=True), TaskContext.get().partitionId() << 40

        def blocks() -> Iterator[tuple[list, list]]:
            ids: list = []
            owners: list = []
            total = 0
            for part in (p for b in batches for p in slices(b, limit=TEXT_BYTES)):
                coded, ends = coder.encode_column(part.column("text"), separator)
                for doc_id, own in zip(part.column("doc_id").to_pylist(), np.split(coded, ends[:-1]), strict=True):
                    ids.append(own)
                    owners.append(doc_id)
                    total += len(ids[-1])
                    if len(ids) >= BLOCK_DOCS or total >= BLOCK_TOKENS:
                        yield ids, owners
                        ids, owners, total = [], [], 0
            if ids:
                yield ids, owners

        for ids, owners in blocks():
            packed = best_fit([len(x) for x in ids], window)
            sizes = np.array([n for pieces in packed for _, _, n in pieces], np.int64)
            row = np.repeat(np.arange(len(packed)), [len(pieces) for pieces in packed])
            begin = np.cumsum(sizes) - sizes  # of each piece among all tokens of the block
            used = np.bincount(row, weights=sizes, minlength=len(packed)).astype(np.int64)
            place = begin - (np.cumsum(used) - used)[row]  # of each piece in its sequence
            index = np.int32 if len(packed) * window < 1 << 31 else np.int64
            every = np.arange(int(sizes.sum()), dtype=index)
            at = np.repeat((row * window + place - begin).astype(index), sizes)
            at += every
            matrix, positions = np.full(len(packed) * window, padding, "<u4"), np.zeros(len(packed) * window, "<u4")
            matrix[at] = np.concatenate([ids[d][s : s + n] for pieces in packed for d, s, n in pieces])
            every -= np.repeat(begin.astype(index), sizes)
            positions[at] = every
            del every, at
            wide = []
            for made in (matrix, positions):
                if digests:
                    wide.append(pa.array([zlib.crc32(x) for x in made.reshape(-1, window)], pa.int64()))
                else:
                    wide.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * window), len(packed), [None, pa.py_buffer(made)]).cast(pa.binary()))
            lists = [
                ([owners[d] for d, _, _ in pieces], [s for _, s, _ in pieces], np.cumsum([0, *(n for _, _, n in pieces)], dtype=np.int32))
                for pieces in packed
            ]
            numbers = pa.array(np.arange(sequence, sequence + len(packed)))
            yield pa.RecordBatch.from_arrays([numbers, *(pa.array([x[k] for x in lists], kinds[k + 1]) for k in range(3)), pa.array(used), *wide], names=names)
            sequence += len(packed)
            del matrix, positions, made, wide, lists, packed, ids, owners

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), schema)


def write_matrices(docs: DataFrame, tokenizer: str, path: str, **options) -> None:
    """Writes the packed sequences as Parquet files."""
    matrices(docs, tokenizer, **options).write.parquet(path)
