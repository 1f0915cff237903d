"""Event-time operators; each takes a static or a streaming DataFrame.

On a stream, ``late`` sets the watermark: state older than that is dropped, and rows that come later are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def windowed(events: DataFrame, keys: list[str], aggregates: dict[str, Column], *, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Aggregates of tumbling windows, or of sliding ones with ``slide``; window start and end are columns."""
    grouped = _watermarked(events, time, late).groupBy(F.window(time, size, slide or size).alias("w"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(events: DataFrame, keys: list[str], aggregates: dict[str, Column], *, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Aggregates of sessions, which end when nothing comes for ``gap``."""
    grouped = _watermarked(events, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def deduplicated(events: DataFrame, keys: list[str], *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row for each key; on a stream among those that come within the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def read_stream(spark: SparkSession, path: str, schema: Any, format: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there now, one batch after the other, then stop; ``sink`` may see a batch again after a failure."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest(spark: SparkSession, path: str, name: str, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Insert a stream's batches into a relation of the catalog at ``path``, each as a checked version of its own.

    A version is written under its batch's number, and each batch starts from the newest whole version.  So a restart goes on where the last whole batch ended, a batch that is run again after a failure changes
    nothing, and a plan never holds more than one batch.  One stream and its checkpoint belong to one catalog.
    """
    from ..operators.constraints import insert
    from ..sources.catalog import commit, current

    def sink(batch: DataFrame, number: int) -> None:
        database, last = current(spark, path)
        if last is None or last < number:
            commit(insert(database, name, batch), path, number)

    return run_available(stream, sink, checkpoint)
