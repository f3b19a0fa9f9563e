"""Roll-ups of evaluated samples, and measures of checks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.labels import coarse_reasoning, python_round


def _rate(x: Column, scale: int = 1) -> Column:
    """The mean to four places, from a sum of whole numbers where the input allows, 0 for no rows."""
    return F.coalesce(python_round(F.try_divide(F.sum(x), F.count("*") * scale), 4), F.lit(0.0))


def _metrics() -> list[Column]:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    # similarities have four places, so whole ten-thousandths add up to the same sum in any order
    parts = F.round(F.coalesce(F.col("similarity"), F.lit(0.0)) * 10_000).cast("long")
    return [
        F.count("*").alias("n"), F.sum(flag("valid")).alias("n_valid"), F.sum(flag("match")).alias("n_match"),
        _rate(flag("valid")).alias("va"), _rate(flag("match")).alias("ex"), _rate(parts, 10_000).alias("sim"),
    ]


def summary(results: DataFrame) -> DataFrame:
    """One row (n, n_valid, n_match, va, ex, sim); null verdicts count as false, null similarities as 0; 0 if there are no rows."""
    return results.agg(*_metrics()).na.fill(0)


def by(results: DataFrame, key: Column, name: str) -> DataFrame:
    """The same for each value of key, sorted by it; null is a value of its own."""
    return results.groupBy(key.alias(name)).agg(*_metrics()).orderBy(name)


def rollup(results: DataFrame) -> DataFrame:
    """All of it in one pass: (level, key, n, ...), level being all, db or reasoning.

    Each row is read once; grouping sets give the three levels, and map-side combining leaves one row a key and task.
    """
    rows = results.select("db_id", coarse_reasoning(F.col("reasoning_type")).alias("rtype"), "valid", "match", "similarity")
    level = F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "db").otherwise("reasoning")
    found = rows.groupingSets([[], [F.col("db_id")], [F.col("rtype")]], F.col("db_id"), F.col("rtype")).agg(level.alias("level"), *_metrics())
    key = F.when(F.col("level") == "db", F.col("db_id")).when(F.col("level") == "reasoning", F.col("rtype"))
    return found.select("level", key.alias("key"), "n", "n_valid", "n_match", "va", "ex", "sim")


def check_precision(hits: DataFrame, results: DataFrame, ident: str) -> DataFrame:
    """Rows (check, triggered, useful, harmful): how often a check spoke about samples that were wrong or right.

    hits has (ident, check), counted once a sample; results has (ident, match), one row each. Hits without a result and
    null checks are left out; a null match counts as wrong.
    """
    right = F.coalesce(F.col("match"), F.lit(False))
    return (
        hits.where("check is not null").select(ident, "check").distinct().join(results.select(ident, "match"), ident)
        .groupBy("check").agg(F.count("*").alias("triggered"), F.count_if(~right).alias("useful"), F.count_if(right).alias("harmful"))
    )
