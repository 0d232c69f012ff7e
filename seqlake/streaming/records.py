"""Searching a stream of query records (an addition): stateless, against an index or a table of postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqlake.config import SeedConfig
from seqlake.operators.postings import Index
from seqlake.operators.search import records


def search_stream(stream: DataFrame, target: DataFrame | Index, config: SeedConfig, min_ratio: float, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Searches each micro-batch of stream(query_id, seq) and hands (results, batch number) to ``sink``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(records(target, batch, config, min_ratio), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
