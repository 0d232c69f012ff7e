"""Equal keys of a table brought together without a row for each: packed, dealt by bins, summed up bin by bin.

Windows of up to 32 bases travel as stretches of their sequence, two bits a
base: windows in a row whose least hashed part falls into the same bin share
one stretch, and a window and its reverse complement have the same parts.
Other keys travel as numbers.  A task reads its bins one after the other, so
what it holds does not grow with its share of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.config import SeedConfig

from .seeds import PIECE, among, pieces, prepared, seed_arrays, sliced

#: Bins; keys that a task sums up at once; bases unpacked at once; bases of a group up to which it stays in one bin; rows told at once.
BINS, HELD, UNPACKED, TOGETHER, SENT = 1 << 12, 1 << 21, 1 << 18, 1 << 22, 1 << 16


def _part(k: int) -> int:
    """Bases of the parts of a window of which the least decides its bin."""
    return max(1, min(13, 2 * k // 3))


def _stretches(data, config: SeedConfig, salt, sizes, together: bool):
    """bin, start and length in bases of each stretch, by bin."""
    import numpy as np

    from seqlake.functions import kernels as kn

    codes, k = kn.codes_of(data), config.length
    ok = kn.whole(codes, k)
    salts = np.repeat(salt, sizes)[: len(ok)]
    if not together and len(ok):
        salts = salts ^ kn.least_in(kn.mixsplit(kn.canonical(codes, _part(k)), config.seed), k - _part(k) + 1)
    bins = (kn.splitmix64(salts) & np.uint64(BINS - 1)).astype(np.int32)
    first, last = ok.copy(), ok.copy()
    same = (bins[1:] == bins[:-1]) & ok[1:] & ok[:-1]
    first[1:] &= ~same
    last[:-1] &= ~same
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + k
    order = np.argsort(bins[start], kind="stable")
    return codes, bins[start][order], start[order], (stop - start)[order]


def _rows(bins, datasets: pa.Array, lengths, sizes, body: bytes) -> pa.RecordBatch:
    """A row for each bin of the segments, which come by bin; sizes are bytes of body."""
    import numpy as np

    new = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    ends = np.r_[new, len(bins)].astype(np.int32)
    at = np.r_[0, np.cumsum(sizes)][ends].astype(np.int32)
    binary = lambda offsets, content: pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(content)])
    columns = [pa.array(bins[new].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), datasets), binary(4 * ends, lengths.astype(np.int32).tobytes()), binary(at, body)]
    return pa.RecordBatch.from_arrays(columns, names=["bin", "datasets", "lengths", "body"])


def _unpacked(lengths, body, k: int) -> Iterator:
    """Keys of the windows of stretches and the number of the stretch of each, some stretches at a time."""
    import numpy as np

    from seqlake.functions import kernels as kn

    whole = (lengths + 3) // 4
    ends = np.r_[0, np.cumsum(whole)]
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + UNPACKED // 4, side="right")) - 1)
        windows = lengths[i:j] - k + 1
        before = np.cumsum(windows) - windows
        place = np.repeat(4 * (ends[i:j] - ends[i]) - before, windows) + np.arange(windows.sum())
        yield kn.canonical_packed(body[ends[i] : ends[j]], place, k), np.repeat(np.arange(i, j), windows)
        i = j


def _merged(keys, datasets, counts):
    """Each (key, dataset) once, by both, with the sum of its counts (None: one each)."""
    import numpy as np

    order = np.argsort(keys)
    keys, datasets = keys[order], datasets[order]
    counts = None if counts is None else counts[order]
    first = np.r_[np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]
    again = np.flatnonzero(~first | ~np.r_[first[1:], np.ones(min(len(keys), 1), bool)])  # rows of keys that stand more than once
    if len(again):
        pair = (np.cumsum(first[again]) << 32) | datasets[again]
        order = np.argsort(pair)
        datasets[again] = datasets[again][order]
        if counts is not None:
            counts[again] = counts[again][order]
        first[1:] |= datasets[1:] != datasets[:-1]
        new = np.flatnonzero(first)
        counts = np.diff(np.r_[new, len(keys)]) if counts is None else np.add.reduceat(counts, new)
        keys, datasets = keys[new], datasets[new]
    return keys, datasets, np.ones(len(keys), np.int64) if counts is None else counts


def by_key(sequences: DataFrame, config: SeedConfig, sum_up: Callable, schema: str, dataset: str = "dataset_id", seq: str = "seq", group: Column | None = None, value: Callable | None = None, only: Broadcast | None = None) -> DataFrame:
    """What ``sum_up(keys, datasets, counts, names)`` makes of the seeds of a table, some whole keys at a time.

    keys are unsigned numbers, ascending, each (key, dataset) once with its
    count of seeds; datasets are numbers of ``names``, an Arrow array.  It
    returns arrays for ``schema``, and is called many times: what it counts
    by anything but the key is to be summed up again.  Equal keys are sure to
    meet only within a ``group``, if one is given.  ``value`` makes other
    32-bit numbers of the keys, and equal ones of these meet; of these ``only``
    keeps those in a broadcast sorted array.
    """
    import numpy as np

    together = False
    if group is not None:  # groups of a few bases stay whole, which takes fewer stretches
        sized = sequences.groupBy(group.alias("group")).agg(F.sum(F.length(seq)).alias("bases")).agg(F.max("bases")).first()[0]
        together = (sized or 0) <= TOGETHER
    salt = F.lit(0).cast("long") if group is None else F.xxhash64(group)
    # null sequences go along, as a filter of them would make every sequence twice
    cut = pieces(prepared(sequences.withColumn("salt", salt), config, seq), config, seq, PIECE).select(F.col(dataset).alias("dataset"), "salt", "offset", F.col(seq).alias("seq"))
    stretched = value is None and config.mode == "kmers" and not config.strobes and not config.pattern and config.length <= 32
    k, kind = config.length, cut.schema["dataset"].dataType.simpleString()

    narrow = value is not None or config.mode in ("kmers", "modimizers", "findere") and not config.strobes and len(config.kept) <= 16
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from seqlake.functions import kernels as kn

        for part, data, begin, sizes in sliced(batches):
            salt = part.column("salt").to_numpy().view(np.uint64)
            if stretched:
                codes, bins, start, lengths = _stretches(data, config, salt, sizes, together)
                if not len(start):
                    continue
                held = (lengths + 3) // 4
                place = np.repeat(start - 4 * (np.cumsum(held) - held), 4 * held) + np.arange(4 * held.sum())
                bases = (np.r_[codes, np.zeros(3, np.uint8)][place] & 3).reshape(-1, 4)
                body = bases[:, 0] | bases[:, 1] << 2 | bases[:, 2] << 4 | bases[:, 3] << 6
                row = np.searchsorted(begin, start, side="right") - 1
            else:
                place, _, keys = seed_arrays(data, config, begin[part.column("offset").to_numpy() > 0])
                if not len(keys):
                    continue
                row = np.repeat(np.arange(len(sizes)), sizes)[place]
                keys = keys if value is None else value(keys)
                if only is not None:
                    hit = among(keys, only.value)
                    row, keys = row[hit], keys[hit]
                    if not len(keys):
                        continue
                bins = (kn.splitmix64(salt[row] if together else salt[row] ^ kn.splitmix64(keys)) & np.uint64(BINS - 1)).astype(np.int64)
                order = np.argsort(bins * len(sizes) + row, kind="stable")
                bins, row, keys = bins[order], row[order], keys[order]
                new = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])])
                lengths = np.diff(np.r_[new, len(keys)])
                bins, row, body = bins[new], row[new], keys.astype(np.uint32 if narrow else np.uint64)
                held = lengths * body.itemsize
            yield _rows(bins, part.column("dataset").take(pa.array(row)), lengths, held, body.tobytes())

    packed = cut.mapInArrow(pack, f"bin int, datasets array<{kind}>, lengths binary, body binary")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint32 if narrow else np.uint64
        codes: dict = {}
        held: list = []

        def taken(rows: pa.RecordBatch) -> None:
            flat = rows.column("datasets").flatten().dictionary_encode(null_encoding="encode")
            known = np.array([codes.setdefault(x, len(codes)) for x in flat.dictionary.to_pylist()], np.int64)
            own = known[flat.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
            lengths = np.frombuffer(b"".join(x.as_py() for x in rows.column("lengths")), np.int32).astype(np.int64)
            body = b"".join(x.as_py() for x in rows.column("body"))
            if stretched:
                for keys, stretch in _unpacked(lengths, np.frombuffer(body, np.uint8), k):
                    held.append((keys, own[stretch], None))
            else:
                held.append((np.frombuffer(body, bits), np.repeat(own, lengths), None))

        def merge() -> None:
            if len(held) > 1 or held and held[0][2] is None:
                counts = None if all(x[2] is None for x in held) else np.concatenate([np.ones(len(x[0]), np.int64) if x[2] is None else x[2] for x in held])
                held[:] = [_merged(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), counts)]

        def told() -> Iterator[pa.RecordBatch]:
            merge()
            if held and len(held[0][0]):
                rows = pa.RecordBatch.from_arrays(sum_up(*held[0], pa.array(list(codes), part_type)), names=names)
                for at in range(0, rows.num_rows, SENT):
                    yield rows.slice(at, SENT)
            held.clear()
            codes.clear()

        size, bin_now, part_type = 0, None, None
        for batch in batches:
            part_type = batch.schema.field("datasets").type.value_type
            bins = batch.column("bin").to_numpy()
            # rows by bin, some at a time; sizes in bytes are near enough to numbers of keys
            bytes_of = np.array([x.as_buffer().size for x in batch.column("body")], np.int64) * 4 // (1 if stretched else 4 * bits().itemsize)
            i = 0
            while i < len(bins):
                j = max(i + 1, int(np.searchsorted(np.cumsum(bytes_of[i:]), HELD - size % HELD, side="right")) + i)
                if size >= HELD:  # the bin at hand is seen to its end before its keys are told
                    end = i + int(np.searchsorted(bins[i:], bin_now, side="right"))
                    if end == i:
                        yield from told()
                        size = 0
                        continue
                    j = min(j, end)
                taken(batch.slice(i, j - i))
                size += int(bytes_of[i:j].sum())
                bin_now, i = int(bins[j - 1]), j
                if sum(len(x[0]) for x in held if x[2] is None) >= HELD:
                    merge()
        yield from told()

    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: a few packed bytes are many keys
    return packed.repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(unpack, schema)


def first_of(values) -> tuple:
    """Where each run of equal values begins, and its length."""
    import numpy as np

    new = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return new, np.diff(np.r_[new, len(values)])
