"""Streaming queries over files that arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from querylens.operators.shared import shared_dir
from querylens.plans.scores import ORACLE as SCORES
from querylens.sources.tables import table
from querylens.streaming.running import drain, running_scores


def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by run from a stream of result files, read to its end."""
    schema = table(spark, d, "sample_results").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1000).parquet(f"{d}/sample_results.parquet*")
    name = f"scores_{uuid.uuid4().hex}"
    return drain(spark, running_scores(stream), name, f"{shared_dir(spark)}/{name}")


QUERIES = {"stream_scores": stream_scores}
ORACLE = {"stream_scores": SCORES["score_by_run"]}
