"""Topology of clouds that arrive as a stream of points.

Pitch and median are order statistics of whole clouds, so each micro-batch re-extracts the clouds it completes; a
batch must hold whole clouds (one file or trigger a cloud), as ``foreachBatch`` delivers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.pipeline import Topology, extract


def extract_stream(points: DataFrame, sink: Callable[[Topology, int], None], checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Start a query that hands each micro-batch's topology to ``sink(topology, batch_id)``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            sink(extract(df, config), batch_id)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
