"""Parquet tables of a folder as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings samples sample_results report_lines traces db_registry schema_columns eval_items mix_targets".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Make temporary views, so that SQL text can name the tables."""
    for name in names or NAMES:
        table(spark, folder, name).createOrReplaceTempView(name)
