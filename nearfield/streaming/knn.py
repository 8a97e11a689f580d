"""Nearest neighbours of a stream of queries against a static base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import knn


def search_stream(queries: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, metric: str = "euclidean") -> StreamingQuery:
    """Searches each micro-batch of queries (qid, qvec) and hands the result and the batch's number to ``sink``.

    The number is the same when a batch is run again, so a sink that overwrites
    by it has each result once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(knn(batch, base, k, metric), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
