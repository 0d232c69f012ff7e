"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its five-word shingles.  Sets that are equal are one
class, named by a 128-bit digest; the rest works on classes.  The sketch
throws all shingles into ``COORDINATES`` bins in rounds of fresh hashes: in
each of the first rounds every shingle picks a bin, in each later round one
bin takes them all, so that every coordinate is filled after twice as many
rounds at most.  Bands of coordinates give buckets.

All classes of a bucket are compared, in steps that are the same for every
size of bucket.  After each, links are confirmed on full sets and components
are built; only buckets that still hold several components go on:

1. each class with the pivot of its largest bucket, the member that shares
   buckets with the most others: one row for each class;
2. classes with the pivots of their other buckets that lie in another
   component;
3. the members outside their pivot's component with all others of another
   component: they visit each block of about ``BLOCK`` members (fewer where
   sets are large), so a bucket of m members, v of them outside, takes
   m + v * m / BLOCK rows.  Pairs are compared inside the task, each in the
   first bucket that it shares, and only while its two sides are not joined.

Pairs go to full comparison if their sizes allow the threshold and their
sketches come within ``SLACK`` of it.  A pair at the threshold of 0.85 shares
no bucket (20 bands of 5) with a probability of 8e-6 and is dropped by its
sketches with one under 1e-5.

Defined results: null, empty or blank texts have no shingles, are linked with
nothing and are kept; shorter texts than five words are one shingle; a very
long text is compared by all its shingles; repeated rows are copies; rows
that share an id are one document, linked with what any of them is linked
with; rows with a null doc_id are compared like all others and kept only if
no row with an id is reachable; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, of_worker, slices, texts, write_shared
from .components import components

COORDINATES, BANDS, ROWS = 100, 20, 5
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
SHINGLE = 5
#: A sketch of a pair at the threshold falls this far below it with a probability under 1e-5.
SLACK = 0.16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        made = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = made
        return made


def shingles(text: str):
    """The sorted 64-bit hashes of a text's distinct shingles."""
    import numpy as np

    found = text.encode().lower().split()  # of bytes: only A-Z and ASCII white space
    hashes = np.fromiter(map(of_worker("minhash", _WordHashes).__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, len(hashes))
    if not size:
        return hashes
    made = hashes[: len(hashes) - size + 1].copy()
    for k in range(1, size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k]
    return np.unique(_mix(made + np.uint64(size)))


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(sets: list):
    """One row of COORDINATES hashes for each set; zeros for empty sets."""
    import numpy as np

    t, empty = COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), empty)
    sizes = np.array([len(s) for s in sets], np.int64)
    out[sizes == 0] = 0
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        open_rows = (out == empty).any(axis=1)
        if not open_rows.any():
            break
        if i and not open_rows[row].all():
            keep = open_rows[row]
            every, row = every[keep], row[keep]
        h = _mix(every + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(1)
        place = (_mix(h + np.uint64(i)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        found = np.full(out.size, empty)
        np.minimum.at(found, row * t + place, h)
        found = found.reshape(out.shape)
        out = np.where(out == empty, found, out)
    return out


def _digest(shingles) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for part in (p for b in batches for p in slices(b, limit=1 << 20)):
        sets = [shingles(t) for t in texts(part)]
        made = sketch(sets)
        keys = np.zeros((len(sets), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(sets), band + 1, np.uint64)
            for k in range(ROWS):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + made[:, band * ROWS + k])
            keys[:, band] = key
        small = (_mix(made) >> np.uint64(56)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("body"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([x.tobytes() for x in small], pa.binary()),
                pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
            ],
            names=["doc_id", "body", "n_shingles", "digest", "sketch", "bands"],
        )


def _bodies(docs: DataFrame) -> DataFrame:
    """body: a hash of the text, which tells apart the texts of a repeated id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("body"))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, body, n_shingles, digest of the whole set, sketch (a byte for each coordinate), bands (bucket keys)."""
    return _bodies(docs).mapInArrow(frugal(_describe), "doc_id long, body long, n_shingles long, digest binary, sketch binary, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for b in batches for p in slices(b, limit=1 << 20)):
        sets = [shingles(t) for t in texts(part)]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])


def _stacked(column: pa.Array):
    """A matrix of the bytes of equally long sketches."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _may_reach(threshold: float, n_a, n_b, sketch_a, sketch_b):
    """Whether sizes and sketches allow the threshold; arguments broadcast against each other."""
    import numpy as np

    return (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)) & ((sketch_a == sketch_b).mean(axis=-1) >= threshold - SLACK)


def _near_pivot(threshold: float):
    """Of rows of a member and its pivot, those that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = _may_reach(threshold, *(b.column(k).to_numpy() for k in ("n_a", "n_b")), *(_stacked(b.column(k)) for k in ("sketch_a", "sketch_b"))) if b.num_rows else []
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _reach(s, t, percent: int) -> bool:
    """Whether two sorted sets of hashes are linked."""
    import numpy as np

    if len(s) > len(t):
        s, t = t, s
    if not len(s) or 100 * len(s) < percent * len(t):
        return False
    same = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return same > 0 and 100 * same >= percent * (len(s) + len(t) - same)


class _Block:
    """The members of one block of a bucket, which visitors are compared with."""

    def __init__(self, rows: pa.Table):
        import numpy as np

        rows = rows.combine_chunks()
        self.component = np.array(rows.column("component").to_pylist(), object)
        self.digest = rows.column("digest").to_pylist()
        self.n, self.sketch, self.bands = rows.column("n_shingles").to_numpy(), _stacked(rows.column("sketch").combine_chunks()), _bands_of(rows.column("bands").combine_chunks())
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles").combine_chunks()]
        self._joined: dict[bytes, bytes] = {}

    def _root(self, c: bytes) -> bytes:
        while (up := self._joined.get(c, c)) != c:
            c = up
        return c

    def links(self, bucket: int, component: bytes, n: int, sketch, bands, own, threshold: float, percent: int) -> Iterator[bytes]:
        """The digests of members that join a visitor's component with one that it is not yet joined with."""
        import numpy as np

        may = np.flatnonzero((self.component != component) & _may_reach(threshold, self.n, n, self.sketch, sketch[None, :]))
        shared = self.bands[may] == bands[None, :]
        may = may[bands[shared.argmax(axis=1)] == bucket] if len(may) else may
        for k in may[np.argsort(-(self.sketch[may] == sketch[None, :]).sum(axis=1), kind="stable")].tolist():
            one, two = self._root(component), self._root(self.component[k])
            if one != two and _reach(own, self.sets[k], percent):
                self._joined[max(one, two)] = min(one, two)
                yield self.digest[k]


def _bands_of(column: pa.Array):
    return column.flatten().to_numpy().reshape(len(column), -1)


def _visit(threshold: float, percent: int):
    """Of rows sorted by bucket, block and visit, the links of visitors with members of the block that join two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, home, block = None, [], None  # the block at hand and its own members, which come before the visitors
        for b in (p for x in batches for p in slices(x, "shingles")):
            places = list(zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True))
            edges = [0, *(k for k in range(1, len(places)) if places[k] != places[k - 1]), len(places)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if places[start] != now:
                    now, home, block = places[start], [], None
                g = b.slice(start, end - start)
                visits = g.column("visit").to_numpy(zero_copy_only=False)
                own, guests = g.filter(pa.array(~visits)), g.filter(pa.array(visits))
                if own.num_rows:
                    home.append(own)
                if not guests.num_rows or not home:
                    continue
                block = block or _Block(pa.Table.from_batches(home))
                found = []
                columns = (guests.column("digest").to_pylist(), guests.column("component").to_pylist(), guests.column("n_shingles").to_pylist(), _stacked(guests.column("sketch")), _bands_of(guests.column("bands")), guests.column("shingles"))
                for d, c, n, sketch, bands, shingled in zip(*columns, strict=True):
                    found += [(d, x) for x in block.links(now[0], c, n, sketch, bands, np.frombuffer(shingled.as_buffer(), np.uint64), threshold, percent)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in (p for b in batches for p in slices(b, "set_a")):
            good = [_reach(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), percent) for s, t in zip(x.column("set_a"), x.column("set_b"), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of digests whose full sets reach the threshold."""
    set_a, set_b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    return near.join(set_a, "a").join(set_b, "b").select("a", "b", "set_a", "set_b").mapInArrow(frugal(_verify(percent)), "a binary, b binary")


def _more(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what ``found`` joins and of further links; its labels stand for its own."""
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Links are pairs with 100 * intersection >= percent * union of their full
    sets; component_id is the smallest doc_id reachable.
    """
    threshold = percent / 100
    described = write_shared(describe(docs), "minhash")
    full = described.where("n_shingles > 0")
    first = {k: F.first(k).alias(k) for k in ("n_shingles", "sketch", "bands")}
    classes = write_shared(full.groupBy("digest").agg(F.min(F.struct("doc_id", "body")).alias("one"), F.min("doc_id").alias("least_id"), *first.values()), "minhash-classes")
    placed = classes.select("digest", F.explode("bands").alias("bucket"))
    shared = write_shared(placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "minhash-buckets")
    members = write_shared(placed.join(shared, "bucket"), "minhash-members")
    met = members.groupBy("digest").agg(F.sum("members").alias("met"))
    pivots = members.join(met, "digest").groupBy("bucket").agg(F.max(F.struct("met", "digest")).alias("of")).select("bucket", F.col("of.digest").alias("pivot"))
    members = write_shared(members.join(pivots, "bucket"), "minhash-pivots")
    known = classes.select("digest", "n_shingles", "sketch")

    active = members.select("digest").distinct().join(classes.select("digest", "one"), "digest").select(F.col("one.doc_id").alias("of_id"), F.col("one.body").alias("of_body"))
    bodies = _bodies(docs)
    chosen = bodies.join(active.hint("shuffle_hash"), bodies.doc_id.eqNullSafe(active.of_id) & (bodies.body == active.of_body), "left_semi")
    sets = write_shared(chosen.select("text").mapInArrow(frugal(_sets), "digest binary, shingles binary").dropDuplicates(["digest"]), "minhash-sets")

    # rows that share an id are one document
    named = full.where("doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("last")).where("a <> last").select("doc_id", "a")
    same_id = write_shared(named.join(several, "doc_id").where("a <> digest").select("a", F.col("digest").alias("b")).distinct(), "minhash-same-id")

    def compared(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of a class and a pivot."""
        pairs = pairs.join(known.toDF("a", "n_a", "sketch_a"), "a").join(known.toDF("b", "n_b", "sketch_b"), "b")
        near = write_shared(pairs.mapInArrow(frugal(_near_pivot(threshold)), "a binary, b binary"), "minhash-near")
        return write_shared(_links(near, sets, percent), "minhash-links")

    def still_open(found: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with their own and their pivot's."""
        labels = found.withColumnRenamed("node", "digest")
        grouped = write_shared(members.join(labels, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "minhash-grouped")
        ends = grouped.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.when(F.col("digest") == F.col("pivot"), F.col("component"))).alias("main"))
        return write_shared(grouped.where("digest <> pivot").join(ends.where("least <> most").select("bucket", "main"), "bucket"), "minhash-open")

    others = members.where("digest <> pivot")
    largest = others.groupBy("digest").agg(F.max(F.struct("members", "pivot")).alias("of")).select(F.col("digest").alias("a"), F.col("of.pivot").alias("b"))
    found = components(compared(largest).union(same_id))
    left = still_open(found)
    found = _more(found, compared(left.where("component <> main").select(F.col("digest").alias("a"), F.col("pivot").alias("b")).distinct()))
    left = still_open(found)
    left = write_shared(left.join(classes.select("digest", "n_shingles", "sketch", "bands"), "digest"), "minhash-left")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    left = left.join(left.groupBy("bucket").agg(blocks.alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    left = write_shared(left.join(sets, "digest"), "minhash-blocks")
    row = ["bucket", "block", "visit", "digest", "component", "n_shingles", "sketch", "bands", "shingles"]
    visitors = left.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visit", F.lit(True))
    dealt = left.withColumn("visit", F.lit(False)).select(row).union(visitors.select(row)).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "visit")
    found = _more(found, write_shared(dealt.mapInArrow(frugal(_visit(threshold, percent)), "a binary, b binary"), "minhash-links"))

    labelled = classes.select("digest", "least_id").join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classed = write_shared(labelled.join(least, "component").select("digest", "component_id"), "minhash-classed")
    out = described.select("doc_id", "n_shingles", "digest").join(classed, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
