"""Packing by lexical retrieval: a sharded BM25 index finds what fills a window.

Token ids are written once as a table, with the counts of the documents that
each id stands in; Spark sums these over all documents.  The table is dealt
by ranges of a locality key: the first ``LEVELS`` distinct ids of a document
in an order drawn by squared idf.  So documents that share rare tokens meet
in one shard, and what many share is cut by further content; only documents
with all of a key in common are cut by their ids.  A shard is at most
``SHARD_DOCS`` consecutive documents; its inverted index covers every
distinct token of each, with the idf and mean length of all documents.

A window starts with a seed document.  The index ranks the unused documents
of the shard for it; those that fit whole go in by rank, and the best one
that does not is cut to fill the window and seeds the next with its rest.  So
each id lies in exactly one piece and only the last window of a partition is
not full.

Defined results: null text is empty and gives the separator alone; repeated
rows are packed each; a null doc_id is carried along; ties in rank go to the
earlier document of the shard; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import frugal, of_worker, partitions_for, slices, write_shared

WINDOW, SHARD_DOCS, SHARD_TOKENS = 1024, 512, 1 << 20
#: Bytes of text that a task encodes at once; its distinct units are encoded once.
TEXT_BYTES = 16 << 20
LEVELS = 6
_K1, _B = 1.2, 0.75


def id_kind(tokenizer: str) -> str:
    """The narrowest numpy type that holds the tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(tokenizer).get_vocab().values(), default=0) < 1 << 16 else "<u4"


def distinct(ids, sizes) -> tuple:
    """Documents, ids and counts of the distinct ids of each document, in order; ``ids`` holds ``sizes[d]`` of document d after those before it."""
    import numpy as np

    bits, of = (16, np.uint32) if len(sizes) <= 1 << 16 and ids.max(initial=0) < 1 << 16 else (32, np.uint64)
    both = np.repeat(np.arange(len(sizes), dtype=of) << of(bits), sizes) | ids.astype(of)
    both.sort()  # one sort of all is several times as fast as one for each document
    first = np.flatnonzero(np.r_[both[:1] == both[:1], both[1:] != both[:-1]])
    found = both[first]
    return (found >> of(bits)).astype(np.int64), (found & of((1 << bits) - 1)).astype(np.int64), np.diff(first, append=len(both))


def _runs(ids, edges) -> Iterator[tuple]:
    """ids and sizes, as ``distinct`` takes them, of some documents after the others: a million ids or one document at a time."""
    import numpy as np

    start = 0
    while start < len(edges) - 1:
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + (1 << 20), side="right")) - 1)
        yield ids[edges[start] : edges[stop]], np.diff(edges[start : stop + 1])
        start = stop


def tokens_table(docs: DataFrame, tokenizer: str, separator: int | None = 0) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit, 32-bit if the vocabulary needs it), counts.

    The last row of each task has no ids but counts: pairs of an id and the
    documents of the task that it stands in, after (-2, documents) and
    (-1, tokens); ``statistics`` sums them.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(tokenizer), id_kind(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = bpe.of_worker(shared.value, by_ranks=True)
        df = np.zeros(max(len(coder.pieces), (separator or 0) + 1, 1 << 16), np.int64)
        n = total = 0
        names = ["doc_id", "ids", "counts"]
        for part in (p for b in batches for p in slices(b, limit=TEXT_BYTES)):
            ids, ends = coder.encode_column(part.column("text"), separator)
            for own, sizes in _runs(ids, np.r_[0, ends]):
                df += np.bincount(distinct(own, sizes)[1], minlength=len(df))
            n, total = n + len(ends), total + len(ids)
            ids = ids.astype(kind)
            coded = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(ids.itemsize * np.r_[0, ends]), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), coded, pa.nulls(len(ends), pa.binary())], names=names)
        if n:
            found = np.flatnonzero(df)
            counts = np.array([[-2, -1, *found], [n, total, *df[found]]], "<i8").T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), "doc_id long, ids binary, counts binary")


@dataclass
class Statistics:
    """Of all documents: how many there are, their mean length, and in how many each id stands."""

    n: int
    mean: float
    df: object

    def idf(self):
        import numpy as np

        return np.log((self.n - self.df + 0.5) / (self.df + 0.5))


def statistics(tokens: DataFrame) -> Statistics:
    """Summed by Spark; what reaches the driver is bounded by the vocabulary."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("counts"):
                pairs = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])

    counts = tokens.select("counts").where("counts is not null").mapInArrow(frugal(run), "id long, n long")
    found = {r["id"]: r["n"] for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(n, total / max(n, 1), df)


class Keys:
    """The first ``LEVELS`` distinct ids of a document in an order of all ids drawn by squared idf: a weighted min-hash.

    Rare ids lead, and each further one cuts what shares those before it.
    """

    def __init__(self, stats: Statistics):
        import numpy as np

        idf = stats.idf()
        weight = np.where((stats.df > 1) & (idf > 0), np.maximum(idf, 1e-3) ** 2, 1e-9)  # others can tell nothing apart
        order = np.argsort(np.random.default_rng(11).exponential(size=len(weight)) / weight)
        self._places = np.empty(len(order), "<u4")
        self._places[order] = np.arange(len(order))

    def of(self, ids, sizes) -> list[bytes]:
        """The key of each document; ``ids`` and ``sizes`` as in ``distinct``."""
        import numpy as np

        doc, placed, _ = distinct(self._places[ids], sizes)
        edges = np.searchsorted(doc, np.arange(len(sizes) + 1))
        data, edges = placed.astype(">u4").tobytes(), (4 * edges).tolist()
        return [data[a : min(b, a + 4 * LEVELS)] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Shard:
    """BM25 over the documents of a shard; documents leave when they are used."""

    def __init__(self, ids: list, stats: Statistics | None = None):
        import numpy as np

        self.n = len(ids)
        length = np.array([len(x) for x in ids])
        doc, self._terms, tf = distinct(np.concatenate(ids), length)
        self._edges = np.searchsorted(doc, np.arange(self.n + 1))
        df = np.bincount(self._terms)
        idf = (stats or Statistics(self.n, length.mean(), df)).idf()
        mean = max(stats.mean if stats else length.mean(), 1)
        weight = idf[self._terms] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length[doc] / mean))
        order = np.argsort(self._terms, kind="stable")
        self._docs, self._weights = doc[order], weight[order]
        self._starts, self._df = np.r_[0, np.cumsum(df)][:-1], df
        self._useful = idf > 0  # as in BM25: terms of more than half of the documents say nothing
        self.used = np.zeros(self.n, bool)

    def neighbours(self, seed: int):
        """Unused documents by falling score."""
        import numpy as np

        own = self._terms[self._edges[seed] : self._edges[seed + 1]]
        own = own[self._useful[own] & (self._df[own] > 1)]
        sizes = self._df[own]
        at = np.repeat(self._starts[own] - np.r_[0, np.cumsum(sizes)][:-1], sizes) + np.arange(sizes.sum())
        scores = np.bincount(self._docs[at], weights=self._weights[at], minlength=self.n)
        left = np.flatnonzero(~self.used)
        return left[np.argsort(-scores[left], kind="stable")]


def _fill(shard: Shard, lengths: list[int], room: int, window: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(document, start, length, offset, whether the window is now full) until all documents of the shard are placed."""
    turn, rank, size = 0, None, window
    while True:
        while turn < shard.n and shard.used[turn]:
            turn += 1
        if turn == shard.n:
            return
        doc = turn if rank is None or not len(rank) else int(rank[0])
        shard.used[doc] = True
        start = 0
        while start < lengths[doc]:
            take = min(room, lengths[doc] - start)
            yield doc, start, take, size - room, take == room
            start += take
            room = room - take or size
        rank = shard.neighbours(doc)
        for other in rank.tolist() if room < size else ():
            if lengths[other] <= room:
                shard.used[other] = True
                yield other, 0, lengths[other], size - room, lengths[other] == room
                room = room - lengths[other] or size
                if room == size:
                    break
        rank = rank[~shard.used[rank]]


def pack(tokens: DataFrame, window: int = WINDOW, with_ids: bool = False, kind: str = "<u2") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece, and its ids if asked for."""
    parts = partitions_for(tokens, 32 << 20)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    stats = statistics(tokens)
    shared = tokens.sparkSession.sparkContext.broadcast((stats, Keys(stats)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys = shared.value[1]
        for b in batches:
            column = b.column("ids").cast(pa.large_binary())
            edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1] // np.dtype(kind).itemsize
            ids = np.frombuffer(column.buffers()[2] or b"", kind)
            found = [key for run in _runs(ids, edges) for key in keys.of(*run)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column("doc_id"), b.column("ids")], names=["key", "doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        of_worker("packing", lambda: None)
        sequence, room = TaskContext.get().partitionId() << 40, window
        for ids, doc_ids in _shards(batches, kind):
            lengths = [len(x) for x in ids]
            rows: list[tuple] = []
            for doc, start, length, offset, full in _fill(Shard(ids, shared.value[0]), lengths, room, window):
                piece = ids[doc][start : start + length]
                rows.append((doc_ids[doc], start, length, zlib.crc32(piece.astype("<u4").tobytes()), lengths[doc], sequence, offset, *([piece.astype(np.int32)] if with_ids else ())))
                sequence, room = sequence + full, window if full else window - offset - length
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    order = ["key", "doc_id"]
    made = tokens.where("ids is not null").select("doc_id", "ids").mapInArrow(frugal(keyed), "key binary, doc_id long, ids binary")
    dealt = made.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(frugal(run), schema)


def _shards(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, list]]:
    import numpy as np

    ids: list = []
    doc_ids: list = []
    total = 0
    for b in batches:
        for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
            own = np.frombuffer(x.as_buffer(), kind).copy()
            ids.append(own)
            doc_ids.append(doc_id)
            total += len(own)
            if len(ids) >= SHARD_DOCS or total >= SHARD_TOKENS:
                yield ids, doc_ids
                ids, doc_ids, total = [], [], 0
    if ids:
        yield ids, doc_ids


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Tokenizes, writes the tokens to the shared folder and packs them."""
    return pack(write_shared(tokens_table(docs, tokenizer), "tokens"), window, with_ids, id_kind(tokenizer))
