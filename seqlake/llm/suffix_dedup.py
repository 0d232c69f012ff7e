"""Removal of repeated passages by prefix doubling of ranks over sampled positions.

Ranks of every byte would shuffle many times the text, so they are kept for
sampled positions, chosen by content alone: of the ``gram``-byte strings in
each ``length``-byte string, the one with the least hash (the leftmost of
equals) is its anchor.  Equal strings of ``length`` bytes have equal anchors
at equal offsets, so nothing is lost.

1. Rank at ``gram`` bytes: anchors whose gram occurs once are dropped.
2. Anchors whose whole stretch of strings is equal are one class: its first
   position goes on, the others are repeats.
3. Prefix doubling, for classes that share a gram: the strings of a stretch go
   in runs of ``STEP`` offsets, and the bytes that a run shares are ranked by
   pairs of ranks at growing offsets (gram, 2 gram, ... bytes; the last pair
   overlaps).  Each round groups equal pairs, gives every pair that occurs
   twice a new rank, and drops the runs of which some part is unique.
4. Runs that agree on all their bytes are settled.  The strings of the others
   are ranked by the pair of their run's rank and their remaining bytes, which
   is past the threshold of ``length`` bytes.

Each round is an aggregation by pair, which combines before it shuffles, and a
join of two written tables, which adaptive execution can split; no rank, pair
or passage gathers in one task however often it occurs.

Defined results: matches never cross rows; null text is empty; texts shorter
than ``length`` lose nothing; very long texts are worked through in windows;
of equal strings the one with the smallest (doc_id, start) stays, of those of
one id the text with the smallest hash; rows with one doc_id and one text are
one document; rows with a null doc_id are returned as they are and compared
with nothing; an empty table gives an empty result; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, of_worker, partitions_for, slices, texts, write_shared

STEP = 10
#: Bytes of text that are looked at together, and the most string starts of a long text in one window.
RUN, WINDOW = 1 << 19, 1 << 19
_ODD = 0x9E3779B97F4A7C15
#: Low bits of a hash that give way to the position when the least of a window is sought.
_BITS = 20
_SLOTS = 1 << 17


def _bodies(docs: DataFrame, tag: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), tag.alias("tag"))


def _tag(docs: DataFrame) -> Column:
    """Tells apart the texts of a repeated id: a hash of the text, or 0 where no id repeats."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) if repeated else F.lit(0).cast("long")


def _powers():
    """Powers of an odd number and of its inverse, modulo 2^64."""
    import numpy as np

    size = 2 * WINDOW + 2
    up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any strings of some bytes: equal strings have equal hashes wherever they stand."""

    def __init__(self, data: bytes):
        import numpy as np

        up, self._down = of_worker("suffix", _powers)
        self.bytes = np.frombuffer(data, np.uint8)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[1 : len(data) + 1], dtype=np.uint64)])

    def every(self, size: int):
        """Of the strings of ``size`` bytes at all positions."""
        return _mix((self._sums[size:] - self._sums[:-size]) * self._down[: len(self._sums) - size])

    def of(self, start, end):
        return _mix((self._sums[end] - self._sums[start]) * self._down[start])


def anchors(bodies: list[bytes], length: int, gram: int):
    """document index, anchor position, first and last string start it stands for, gram hash, hash of the stretch: arrays over all texts, of at most 2^20 bytes."""
    import numpy as np

    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sizes = np.array([len(b) for b in bodies], np.int64)
    if sizes.sum() < length:
        return none
    begin = np.cumsum(sizes) - sizes
    hashes = Hashes(b"".join(bodies))
    grams = hashes.every(gram)
    # the least hash of each window of grams, with its position in the low bits: the leftmost of equals
    bits = np.uint64(_BITS)
    best = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    at = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(bodies)), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= (begin + sizes)[doc]
    starts = np.flatnonzero(inside)
    at, doc = at[inside], doc[inside]
    if not len(at):
        return none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    d, p, low, high = doc[new], at[new], starts[new], starts[last]
    whole = _mix(hashes.of(low, high + length) + ((p - low) * length + (p - high)).astype(np.uint64))
    return d, p - begin[d], low - begin[d], high - begin[d], grams[p], whole


def _windows(bodies: list[bytes], length: int, gram: int):
    """What ``anchors`` gives, of a long text in windows that end between two anchors' stretches."""
    if len(bodies) != 1 or len(bodies[0]) < WINDOW + length:
        yield anchors(bodies, length, gram)
        return
    base, body, ended = 0, bodies[0], False
    while not ended:
        ended = base + WINDOW + length - 1 >= len(body)
        d, p, low, high, h, whole = anchors([body[base : base + WINDOW + length - 1]], length, gram)
        n = len(d) if ended else len(d) - 1
        yield d[:n], p[:n] + base, low[:n] + base, high[:n] + base, h[:n], whole[:n]
        base += int(low[-1])


_ANCHOR = "h long, whole long, doc_id long, tag long, p int, most short, least short"
#: What a task's texts say of an anchor's gram: nothing; it recurs, as other rows tell; it recurs, as this row tells.
ALONE, AGAIN, FIRST = 0, 1, 2


def _known(table, h):
    """ALONE, AGAIN or FIRST for each of the grams at hand.

    ``table`` remembers grams that the task has met, by slot, and in the low
    bit whether it has told of them.  What is forgotten is told once more.
    """
    import numpy as np

    own, at, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    slot = (own >> np.uint64(1)) % np.uint64(len(table))
    met = (table[slot] | np.uint64(1)) == (own | np.uint64(1))
    told = met & ((table[slot] & np.uint64(1)) == 1)
    recurs = met | (n > 1)
    table[slot] = ((own >> np.uint64(1)) << np.uint64(1)) | recurs.astype(np.uint64)
    first = np.where(told, AGAIN, np.where(recurs, FIRST, ALONE))
    return np.where(at[back] == np.arange(len(h)), first[back], AGAIN).astype(np.int8)


def _find(length: int, gram: int):
    """Anchors, and what their own task says about them: a very common gram has but a row or two of each task that must meet the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.zeros(_SLOTS, np.uint64)
        for part in (p for b in batches for p in slices(b, limit=RUN)):
            ids, tags = (part.column(k).to_numpy() for k in ("doc_id", "tag"))
            for d, p, first, last, h, whole in _windows([t.encode() for t in texts(part)], length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[d]), pa.array(tags[d]), pa.array(p.astype(np.int32)), pa.array((p - first).astype(np.int16)), pa.array((p - last).astype(np.int16)), pa.array(_known(table, h))],
                    names=["h", "whole", "doc_id", "tag", "p", "most", "least", "known"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by h, the rows that are known to be repeated or whose h another row has."""
    import numpy as np

    before: pa.RecordBatch | None = None
    told = False  # whether ``before``, the last row so far, is repeated
    for b in batches:
        known = b.column("known").to_numpy()
        b = b.drop_columns(["known"])
        yield b.filter(pa.array(known == AGAIN))
        b, known = b.filter(pa.array(known != AGAIN)), known[known != AGAIN]
        if not b.num_rows:
            continue
        h = b.column("h").to_numpy()
        same = np.r_[before is not None and before.column("h")[0].as_py() == h[0], h[1:] == h[:-1]]
        keep = same | np.r_[same[1:], False] | (known == FIRST)
        if before is not None and (told or same[0]):
            yield before
        before, told = b.slice(b.num_rows - 1), bool(keep[-1])
        keep[-1] = False
        yield b.filter(pa.array(keep))
    if before is not None and told:
        yield before


def doublings(length: int, gram: int) -> list[int]:
    """The offsets at which ranks are paired, from ``gram`` bytes to the bytes that a run of strings shares."""
    have, full, out = gram, length - STEP + 1, []
    while have < full:
        out.append(min(have, full - have))
        have += out[-1]
    return out


def _named(offsets: list[int]) -> list[int]:
    """Where the grams stand, from the start of the shared bytes, that are paired round by round: neighbours first."""
    at = [0]
    for o in reversed(offsets):
        at = [x + y for x in at for y in (0, o)]
    return at


def runs_of(data: bytes, at, most, least, length: int, gram: int):
    """For each run of STEP offsets of each anchor: its anchor, number, lowest and highest offset, the names of its grams, and the bytes about those it shares.

    A string at offset o starts o bytes before its anchor.  Grams are told
    apart by where they lie about the anchor, since equal runs have them at
    equal places.
    """
    import numpy as np

    hashes = Hashes(data)
    n = most // STEP - least // STEP + 1
    anchor = np.repeat(np.arange(len(at)), n)
    node = least[anchor] // STEP + np.arange(len(anchor)) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.maximum(least[anchor], node * STEP), np.minimum(most[anchor], node * STEP + STEP - 1)
    core = at[anchor] - node * STEP
    names = []
    for k, x in enumerate(_named(doublings(length, gram))):
        seed = (node * 64 + k).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        names.append(_mix(hashes.of(core + x, core + x + gram) + seed))
    shared = length - STEP + 1
    places = core[:, None] + np.r_[np.arange(1 - STEP, 0), np.arange(shared, shared + STEP - 1)][None, :]
    used = (places >= (at[anchor] - high)[:, None]) & (places < (at[anchor] - low + length)[:, None])
    fringe = np.where(used, hashes.bytes[np.clip(places, 0, len(data) - 1)], 0).astype(np.uint8)
    return anchor, node, low, high, names, fringe


def _runs(length: int, gram: int):
    """Rows of ``runs_of`` for the anchors found in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["doc_id", "tag", "p", "node", "low", "high", *(f"n{k}" for k in range(1 << len(doublings(length, gram)))), "fringe"]

        def rows(data: bytes, base, p, most, least, ids, tags) -> pa.RecordBatch:
            anchor, node, low, high, grams, fringe = runs_of(data, base + p, most, least, length, gram)
            wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * STEP - 2), len(anchor), [None, pa.py_buffer(np.ascontiguousarray(fringe))]).cast(pa.binary())
            numbers = [pa.array(x.astype(np.int32)) for x in (p[anchor], node, low, high)]
            return pa.RecordBatch.from_arrays([pa.array(ids[anchor]), pa.array(tags[anchor]), *numbers, *(pa.array(g.view(np.int64)) for g in grams), wide], names=names)

        for part in (p for b in batches for p in slices(b, limit=RUN)):
            bodies = [t.encode() for t in texts(part)]
            sizes = np.array([len(b) for b in bodies], np.int64)
            found = part.column("found")
            flat, n = found.flatten(), np.asarray(found.value_lengths())
            p, most, least = (flat.field(k).to_numpy().astype(np.int64) for k in ("p", "most", "least"))
            doc = np.repeat(np.arange(len(bodies)), n)
            ids, tags = (part.column(k).to_numpy()[doc] for k in ("doc_id", "tag"))
            if len(bodies) > 1 or sizes[0] <= RUN + length:
                yield rows(b"".join(bodies), (np.cumsum(sizes) - sizes)[doc], p, most, least, ids, tags)
                continue
            order = np.argsort(p)  # one long text, in windows by its anchors
            for own in np.split(order, np.flatnonzero(np.diff(p[order] // WINDOW)) + 1):
                start, end = int((p - most)[own].min()), int((p - least)[own].max()) + length
                yield rows(bodies[0][start:end], -start, p[own], most[own], least[own], ids[own], tags[own])

    return run


def _reranked(runs: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The runs whose neighbouring ranks, ``names`` two by two, all form pairs that occur more than once, with the ranks of the pairs."""
    pairs = list(zip(names[::2], names[1::2], strict=True))
    every = runs.select(F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))).alias("x")).select("x.a", "x.b")
    ranks = every.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b", F.monotonically_increasing_id().alias("rank"))
    ranks = write_shared(ranks, "suffix-pairs")
    new = []
    for a, b in pairs:
        new.append(f"{a}{b}")
        runs = runs.join(ranks.toDF(a, b, new[-1]), [a, b]).drop(a, b)
    runs = write_shared(runs, "suffix-reranked")
    discard(ranks)
    return runs, new


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 24, tag: Column | None = None) -> DataFrame:
    """doc_id, tag, spans: the byte ranges covered by strings of ``length`` bytes that also start earlier; only documents that have some."""
    if gram > length - STEP + 1:
        raise ValueError(f"gram is {length - STEP + 1} at most")
    bodies = _bodies(docs, _tag(docs) if tag is None else tag).where("doc_id is not null")
    long_enough = bodies.where(F.octet_length("text") >= length)
    every = long_enough.mapInArrow(frugal(_find(length, gram)), _ANCHOR + ", known byte")
    # rows that are known to be repeated go anywhere
    deal = F.when(F.col("known") == AGAIN, F.xxhash64("doc_id", "p")).otherwise(F.col("h"))
    dealt = every.repartition(partitions_for(docs), deal).sortWithinPartitions("h")
    again = write_shared(dealt.mapInArrow(frugal(_repeated), _ANCHOR), "suffix-anchors")

    place = F.struct("doc_id", "tag", "p")
    classes = again.groupBy("h", "whole").agg(F.min(place).alias("first"), F.min("most").alias("most"), F.min("least").alias("least"), F.count("*").alias("n"))
    classes = write_shared(classes, "suffix-classes")
    copies = again.join(classes.where("n > 1").select("h", "whole", "first"), ["h", "whole"]).where(place != F.col("first"))
    removed = copies.select("doc_id", "tag", (F.col("p") - F.col("most")).alias("start"), (F.col("p") - F.col("least") + length).alias("end"))
    removed = write_shared(removed, "suffix-copies")
    discard(again)

    several = write_shared(classes.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1").select("h"), "suffix-several")
    chosen = classes.join(several, "h").select("first.doc_id", "first.tag", F.struct("first.p", "most", "least").alias("one"))
    chosen = write_shared(chosen.groupBy("doc_id", "tag").agg(F.collect_list("one").alias("found")), "suffix-chosen")
    discard(classes, several)
    names = [f"n{k}" for k in range(1 << len(doublings(length, gram)))]
    schema = "doc_id long, tag long, p int, node int, low int, high int, " + "".join(f"{k} long, " for k in names) + "fringe binary"
    # a row that repeats id and text makes its runs twice over, at one place: none of them is taken for a copy of the other
    runs = write_shared(long_enough.join(chosen, ["doc_id", "tag"]).mapInArrow(frugal(_runs(length, gram)), schema), "suffix-runs")
    discard(chosen)
    while len(names) > 2:
        before = runs
        runs, names = _reranked(before, names)
        discard(before)

    whole = F.struct("low", "high", "fringe")
    ranks = runs.groupBy(*names).agg(F.count("*").alias("n"), F.min(whole).alias("one"), F.max(whole).alias("other"), F.min(place).alias("first")).where("n > 1")
    ranks = write_shared(ranks.select(*names, "first", (F.col("one") == F.col("other")).alias("settled")), "suffix-ranks")
    ranked = write_shared(runs.join(ranks, names), "suffix-ranked")
    discard(runs, ranks)
    removed_runs = ranked.where(F.col("settled") & (place != F.col("first"))).select("doc_id", "tag", (F.col("p") - F.col("high")).alias("start"), (F.col("p") - F.col("low") + length).alias("end"))

    strings = ranked.where(~F.col("settled")).withColumn("offset", F.explode(F.sequence("low", "high")))
    rest = F.substring("fringe", F.lit(STEP) + F.col("node") * STEP - F.col("offset"), F.lit(STEP - 1))
    strings = write_shared(strings.select(*names, "offset", rest.alias("rest"), "doc_id", "tag", "p"), "suffix-strings")
    key = [*names, "offset", "rest"]
    firsts = write_shared(strings.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-string-firsts")
    last = strings.join(firsts, key).where(place != F.col("first"))
    removed_strings = last.select("doc_id", "tag", (F.col("p") - F.col("offset")).alias("start"), (F.col("p") - F.col("offset") + length).alias("end"))

    spans = removed.union(removed_runs).union(removed_strings).select("doc_id", "tag", F.struct("start", "end").alias("span"))
    found = write_shared(spans.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans")), "suffix-spans")
    discard(removed, ranked, strings, firsts)
    return found


def _cut(body: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of body, and the maximal runs that go."""
    import numpy as np

    if spans is None or not len(spans.values):
        return body, []
    start, end = (spans.values.field(k).to_numpy() for k in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    found = list(zip(start[new].tolist(), reach[np.r_[new[1:], len(start)] - 1].tolist(), strict=True))
    at = [0, *(x for f in found for x in f), len(body)]
    return b"".join(body[s:e] for s, e in zip(at[::2], at[1::2], strict=True)), found


def _digest(text: str, spans) -> tuple:
    body = text.encode()
    kept, found = _cut(body, spans)
    return len(body), len(body) - len(kept), len(found), hashlib.sha256(kept).hexdigest()


def removal_report(docs: DataFrame, length: int = 100, gram: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            rows = [_digest(t, s if s.is_valid else None) for t, s in zip(texts(part), part.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.string()]))], names=names)

    tag = _tag(docs)
    joined = _bodies(docs, tag).join(repeated_spans(docs, length, gram, tag), ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 100, gram: int = 24) -> DataFrame:
    """docs, with all their columns, their texts without repeated strings; parts of characters that a cut leaves are dropped."""
    own_spans = "spans"
    while own_spans in docs.columns:
        own_spans += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            left = [None if t is None else _cut(t.encode(), s)[0].decode(errors="ignore") if s.is_valid else t for t, s in zip(part.column("text").to_pylist(), part.column(own_spans), strict=True)]
            yield part.drop_columns([own_spans]).set_column(part.schema.get_field_index("text"), "text", pa.array(left, pa.string()))

    tag = _tag(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), tag.alias("tag"))
    spans = repeated_spans(docs, length, gram, tag).withColumnRenamed("doc_id", "id")
    joined = rows.join(spans, ["id", "tag"], "left").select("row.*", F.col("spans").alias(own_spans))
    return joined.mapInArrow(frugal(run), docs.schema)
