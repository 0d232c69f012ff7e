"""Seeds of the sequences of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.config import SeedConfig
from seqlake.functions.sequences import homopolymer_compress, reverse_complement

#: Bases that a Python task handles at once, and the length from which a sequence is cut into overlapping pieces.
SLICE, PIECE = 1 << 19, 1 << 20


def seed_arrays(data, config: SeedConfig, told=()):
    """place, run and key of each seed of a byte array; a run is named by the number of breaks before it.

    ``told``: starts of windows whose minimizers another piece of their sequence tells.
    """
    import numpy as np

    from seqlake.functions import kernels as kn

    codes = kn.codes_of(data)
    width = config.length
    runs = np.cumsum(codes == 4)
    if config.mode == "minimizers":
        find = kn.open_closed if config.scheme == "open-closed-mod" else kn.hashed_minimizers
        if config.k == config.m:
            place = np.flatnonzero(kn.whole(codes, width))
        else:
            starts, place = find(codes, config.k, config.m, config.seed)
            # a place that the window before has chosen is not told again
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            place = place[new & ~np.isin(starts, told)]
        if config.strobes:
            place = np.unique(place)
    else:
        ok = kn.whole(codes, width)
        if config.mode == "findere":  # only from runs that hold a whole k-mer
            sizes = np.bincount(runs[codes != 4], minlength=int(runs[-1]) + 1 if len(runs) else 0)
            ok &= sizes[runs[: len(ok)]] >= config.k
        place = np.flatnonzero(ok)
    if config.pattern:
        keys = kn.masked(codes, width, config.kept)
    else:
        keys = kn.canonical(codes, width) if width <= 32 else kn.long_keys(codes, width)
    keys = keys[place] if len(keys) else np.zeros(0, np.uint64)
    if config.mode == "modimizers":
        chosen = kn.mixsplit(keys, config.seed) % np.uint64(config.divisor) == 0
        place, keys = place[chosen], keys[chosen]
    run = runs[place]
    if config.strobes:
        keys = kn.linked(place, run, kn.xxh64_of_number(keys), *config.strobes)
    return place, run, keys


def prepared(sequences: DataFrame, config: SeedConfig, seq: str = "seq", reverse: bool = False) -> DataFrame:
    """sequences as the configuration reads them."""
    column = F.col(seq)
    if config.homopolymer:
        column = homopolymer_compress(column)
    return sequences.withColumn(seq, reverse_complement(column) if reverse else column)


def pieces(sequences: DataFrame, config: SeedConfig, seq: str = "seq", size: int = PIECE) -> DataFrame:
    """Cuts long sequences into overlapping pieces, column ``offset``, so that no row is one task's whole work.

    Single windows need their width less one of overlap; minimizers also the
    window before, whose choice the piece before has told.  Linked pairs and
    findere's seeds depend on what lies further away and are not cut.
    """
    if config.strobes or config.mode == "findere":
        return sequences.withColumn("offset", F.lit(0).cast("long"))
    width, lead = (config.k, 1) if config.mode == "minimizers" else (config.length, 0)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length(seq) - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    cut = sequences.withColumn("offset", F.explode(starts)).withColumn("offset", F.greatest(F.col("offset") - lead, F.lit(0).cast("long")))
    return cut.withColumn(seq, F.substring(F.col(seq), (F.col("offset") + 1).cast("int"), F.when(F.col("offset") > 0, size + width - 1 + lead).otherwise(size + width - 1)))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of about SLICE bases at a time, their sequences as one byte array, where each begins, and its length with the break after it."""
    import numpy as np

    for batch in batches:
        lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("seq")], np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(np.cumsum(lengths[start:]), SLICE, side="right")) + start)
            part = batch.slice(start, stop - start)
            sizes = lengths[start:stop] + 1
            yield part, np.frombuffer(b"\n".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("seq")), np.uint8), np.cumsum(sizes) - sizes, sizes
            start = stop


def among(keys, known):
    """Which of keys stand in a sorted array."""
    import numpy as np

    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def seeds(sequences: DataFrame, config: SeedConfig, ids: list[str], seq: str = "seq", reverse: bool = False, only: Broadcast | None = None, distinct: bool = False, size: int = PIECE, value: Callable | None = None) -> DataFrame:
    """ids, run, pos, key for each seed; with ``distinct`` each (ids, key) of a batch once, with its count n in place of places.

    ``only`` is a broadcast sorted array of keys: other seeds are dropped where
    they are made.  ``value`` makes other numbers of the keys first.  Null
    sequences have no seeds.
    """
    ready = prepared(sequences.where(F.col(seq).isNotNull()), config, seq, reverse)
    cut = pieces(ready, config, seq, size).select(*ids, "offset", F.col(seq).alias("seq"))
    kinds = [cut.schema[c] for c in ids]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + (", key long, n long" if distinct else ", run long, pos long, key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for part, data, begin, sizes in sliced(batches):
            place, runs, keys = seed_arrays(data, config, begin[part.column("offset").to_numpy() > 0])
            row = np.repeat(np.arange(len(sizes)), sizes)[place]
            keys = keys if value is None else value(keys)
            if only is not None:
                hit = among(keys, only.value)
                place, runs, keys, row = place[hit], runs[hit], keys[hit], row[hit]
            if distinct:
                order = np.lexsort((keys, row))
                row, keys = row[order], keys[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
                row, keys, n = row[new], keys[new], np.diff(np.r_[np.flatnonzero(new), len(new)])
            pick = pa.array(row)
            columns = [part.column(c).take(pick) for c in ids]
            if distinct:
                counts = [pa.array(n.astype(np.int64))]
            else:
                counts = []
                offset = part.column("offset").to_numpy()[row]
                breaks = np.cumsum(data == 10)  # runs are counted within a row, across its pieces by place
                columns += [pa.array((runs - np.r_[0, breaks][begin[row]]).astype(np.int64)), pa.array(place - begin[row] + offset)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys.view(np.int64)), *counts], names=[*ids, *(["key", "n"] if distinct else ["run", "pos", "key"])])

    return cut.mapInArrow(run, schema)
