"""Streaming form of the resumable append: each batch writes only the keys the sink lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_pending


def stream_pending(source: DataFrame, path: str, key: str, make, checkpoint_dir: str) -> StreamingQuery:
    """Starts an available-now stream whose batches append ``make(new rows)`` to Parquet at ``path``.

    Keys that repeat, in a batch or from an earlier one, are written once; after a
    failure the stream goes on from its checkpoint and the anti-join skips what was
    written before it.
    """

    def batch(rows: DataFrame, number: int) -> None:
        from ..sources.sinks import exists

        spark = rows.sparkSession
        fresh = rows.dropDuplicates([key])
        if exists(spark, path):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        make(fresh).write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, *keys: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean value per window, with a watermark for late rows; for streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), *keys, "n", "mean_value")


__all__ = ["append_pending", "stream_pending", "windowed_counts"]
