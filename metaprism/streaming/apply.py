"""Apply fitted phases to a streaming DataFrame.

Fitted phases are column expressions, filters, or joins with small fitted
tables (stream-static joins), so the same ``Fitted.transform`` works on a
``readStream`` DataFrame unchanged.  Row deduplication (P1) keeps the first
row per feature tuple, which on an unbounded stream needs state: it is done
with ``dropDuplicatesWithinWatermark`` over an event-time column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..frame import Frame


def apply_phases(stream: DataFrame, template: Frame, fitted: list) -> DataFrame:
    """Run every fitted phase over ``stream`` (same columns as the train
    Frame ``template``); returns the transformed streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    fr = template.with_df(stream)
    for f in fitted:
        if f.phase == "dedup":
            raise ValueError("use dedup_stream for duplicates on a stream")
        fr = f.transform(fr)
    return fr.df


def dedup_stream(stream: DataFrame, template: Frame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """P1 on a stream: one row per feature tuple within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(template.attrs))


def write_available(stream: DataFrame, path: str, checkpoint: str):
    """Process everything available now into parquet, then stop."""
    q = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
