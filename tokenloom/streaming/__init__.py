"""Search over a stream of queries: each micro-batch is looked up in a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import FuzzyIndex, points
from ..operators.search import SearchParams, nearest


def search_stream(index: FuzzyIndex, stream: DataFrame, params: SearchParams, sink: Callable[[DataFrame, int], None], *, label: str = "word", checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query that gives ``sink`` each micro-batch's nearest neighbours."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(nearest(index, points(rows.select(label), index.featurizer, label=label), params), number)

    writer = stream.writeStream.foreachBatch(batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
