"""Majority votes over candidates by their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_keys(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """Rows (sample_id, side, ok, key): key is equal for results with as many columns and the same multiset of rows. The order of
    rows doesn't count, that of columns does. side names the candidate."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "cell"))), lambda x: x["cell"]).alias("values")
    rows = cells.groupBy("sample_id", "side", "row_pos").agg(values).groupBy("sample_id", "side", "values").agg(F.count("*").alias("times"))
    hashed = rows.groupBy("sample_id", "side").agg(F.bit_xor(F.xxhash64("values", "times")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(17), "values", "times")).alias("h2"))
    zero = F.lit(0).cast("long")
    return shape.join(hashed, ["sample_id", "side"], "left").select("sample_id", "side", "ok", F.concat_ws(":", F.coalesce("n_cols", F.lit(0)), F.coalesce("h1", zero), F.coalesce("h2", zero)).alias("key"))


def winners(candidates: DataFrame, question: str, index: str, ok: str, key: str) -> DataFrame:
    """Rows (question, winner, votes, n_candidates): the index of the candidate that wins.

    Candidates that ran vote by result; the largest group wins, among equals the one seen first, and in it the earliest
    candidate. If none ran, the last candidate wins with no votes. A null key is a result like any other, a null ok is false, null
    indexes are left out. Groups are counted with map-side combining, so a question may have any number of candidates.
    """
    ran = F.coalesce(F.col(ok), F.lit(False))
    groups = candidates.where(F.col(index).isNotNull()).groupBy(question, F.when(ran, F.struct(F.col(key).alias("key"))).alias("_result")).agg(F.count("*").alias("_n"), F.min(index).alias("_first"), F.max(index).alias("_last"))
    voted = F.when(F.col("_result").isNotNull(), F.struct(F.col("_n").alias("votes"), (-F.col("_first")).alias("minus_first")))
    best = groups.groupBy(question).agg(F.max(voted).alias("_best"), F.max("_last").alias("_last"), F.sum("_n").alias("n_candidates"))
    return best.select(question, F.coalesce(-F.col("_best.minus_first"), F.col("_last")).alias("winner"), F.coalesce("_best.votes", F.lit(0)).alias("votes"), "n_candidates")
