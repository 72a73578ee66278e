"""Windowed monitoring over a stream; an extension beyond the batch operators.

The rule executor is stateless per row, so it runs on a stream unchanged; ``state_mix`` counts any category per
event-time window, with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_mix(rows: DataFrame, ts: str, state: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, state, n); append-mode safe on a stream, plain aggregation on a batch."""
    src = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return src.groupBy(F.window(ts, window).alias("w"), F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "state", "n"
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into Parquet and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
