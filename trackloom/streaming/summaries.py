"""Grouped summaries of tracks that arrive over time, with Structured Streaming: the same sums as in batches, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def track_stream(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of track rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_summary(rows: DataFrame, feature: str, by: str = "experiment", time: str = "ds", width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """n, mean and standard error (ddof 0) of a feature by group and time window. Rows later than `late` behind the newest are left out.

    Works on streams and batches alike.
    """
    watched = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = watched.groupBy(F.window(time, width).alias("w"), by).agg(F.count(feature).alias("n"), F.avg(feature).alias("mean"), (F.stddev_pop(feature) / F.sqrt(F.count(feature))).alias("sem"))
    return out.select(by, F.col("w.start").alias("start"), "n", "mean", "sem")


def run_to_folder(summary: DataFrame, folder: str, checkpoint: str) -> None:
    """Write what has arrived so far as Parquet, once each window is closed; continues from the checkpoint the next time."""
    summary.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
