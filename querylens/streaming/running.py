"""Scores while results arrive: a streaming roll-up with the same measures as the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.operators.scores import _metrics


def running_scores(results: DataFrame, key: str = "run_id") -> DataFrame:
    """Streaming results to streaming scores by key; the state is one row a key, whatever arrives."""
    return results.groupBy(key).agg(*_metrics())


def windowed_scores(results: DataFrame, time: str = "evaluated_at", late: str = "60 days", window: str = "30 days") -> DataFrame:
    """Scores by window of evaluation time; results later than the watermark are left out and old windows leave the state."""
    return results.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(*_metrics()).select(F.col("w.start").alias("window_start"), "n", "n_valid", "n_match", "va", "ex", "sim")


def drain(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and give its last result."""
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
