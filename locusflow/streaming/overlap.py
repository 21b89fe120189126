"""Interval operators on a stream of rows against a table that stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import interval


def overlap_stream(stream: DataFrame, table: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, operator: str = "overlap", trigger: dict | None = None, **options) -> StreamingQuery:
    """Run an operator of two sides (``overlap``, ``nearest``, ``count_overlaps``, ``coverage`` or ``subtract``) on every
    micro-batch of ``stream`` against ``table``, and hand each result to ``sink(result, batch number)``.

    Every row of the stream is answered by itself, so no state is kept between batches; what was written of a batch
    that is run again after a failure has the same number. ``options`` are those of the operator, ``trigger`` those of
    the stream writer (for example ``{"availableNow": True}``)."""
    if operator not in ("overlap", "nearest", "count_overlaps", "coverage", "subtract"):
        raise ValueError(f"no operator of two sides named {operator!r}")
    run = getattr(interval, operator)
    writer = stream.writeStream.foreachBatch(lambda batch, number: sink(run(batch, table, **options), number)).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
