"""Evaluation of predicted against gold queries: run, compare, roll up."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.sqltext import has_outermost_order_by
from querylens.operators.compare import compare
from querylens.operators.execution import TIMEOUT_S, Database, stage_queries
from querylens.operators.shared import cut
from querylens.operators.vote import result_keys, winners

QUERY = ["db_id", "sql", "ordered"]
BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*$"


def _numbered(rows: DataFrame, turn: int = 0) -> DataFrame:
    """Each different query (q, db_id, sql, ordered) once, as a written table; numbers of different turns differ."""
    q = F.monotonically_increasing_id() * 2 + turn
    return cut(rows.select(*QUERY).distinct().withColumn("q", q))


def _listed(queries: DataFrame) -> Iterator[tuple[int, str, str, bool]]:
    for r in queries.toLocalIterator():
        yield r["q"], r["db_id"], r["sql"], r["ordered"]


def _with(rows: DataFrame, queries: DataFrame, sql: str, into: str) -> DataFrame:
    return rows.join(queries.select("db_id", F.col("sql").alias(sql), "ordered", F.col("q").alias(into)), ["db_id", sql, "ordered"], "left")


def evaluate(spark: SparkSession, samples: DataFrame, predictions: DataFrame, databases: dict[str, Database], timeout_s: float = TIMEOUT_S) -> DataFrame:
    """One sample result per sample. samples (idx, db_id, question, reasoning_type, query), predictions (idx, pred_sql).

    The two must have the same positions, else ValueError. A blank prediction is invalid and isn't run; the gold query isn't run
    if the prediction fails; a missing database raises KeyError. Each different query of a database runs once, and each
    different pair of results is compared once. As each query is a plan of its own the driver sees the different queries, one
    after the other; samples, results and scores stay on the executors.
    """
    rows = samples.select("idx", "db_id", "question", F.coalesce("reasoning_type", F.lit("")).alias("reasoning_type"), F.col("query").alias("gold_sql"), has_outermost_order_by(F.col("query")).alias("ordered"))
    joined = cut(rows.join(predictions.select("idx", F.coalesce("pred_sql", F.lit("")).alias("pred_sql")), "idx"))
    n, m, both = samples.count(), predictions.count(), joined.count()
    if not n == m == both:
        raise ValueError(f"{n} samples but {m} predictions, {both} at the same position")
    for r in joined.select("db_id").distinct().toLocalIterator():
        databases[r["db_id"]]
    blank = F.rlike("pred_sql", F.lit(BLANK))
    pred = _numbered(joined.where(~blank).withColumn("sql", F.col("pred_sql")))
    cells, shape = stage_queries(spark, databases, _listed(pred), timeout_s)
    placed = _with(joined, pred, "pred_sql", "pred_q")
    ran = shape.where("ok").select(F.col("sample_id").alias("pred_q"))
    runs = placed.join(ran, "pred_q", "left_semi").withColumn("sql", F.col("gold_sql"))
    gold = _numbered(runs.select(*QUERY).join(pred, QUERY, "left_anti"), 1)
    cells2, shape2 = stage_queries(spark, databases, _listed(gold), timeout_s)
    cells, shape = cells.unionByName(cells2), cut(shape.unionByName(shape2))
    golden = _with(runs.drop("sql"), cut(pred.unionByName(gold)), "gold_sql", "gold_q").select("idx", "gold_q")
    placed = cut(placed.join(golden, "idx", "left"))
    pairs = cut(placed.groupBy("pred_q", "gold_q", "ordered").agg(F.min("idx").alias("sample_id")))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_q").alias("q")) for s in ("pred", "gold"))))
    uses = pairs.select(F.col("sample_id").alias("pair"), sides.alias("of")).select("pair", "of.*").where("q is not null")
    used = lambda df: df.drop("side").join(uses, df.sample_id == uses.q).drop("sample_id", "q").withColumnRenamed("pair", "sample_id")
    scored = compare(used(cells), used(shape), pairs.select("sample_id", "ordered"))
    whole = pairs.join(scored, "sample_id")
    for s in ("pred", "gold"):
        one = shape.select(F.col("sample_id").alias(f"{s}_q"), F.struct("ok", F.array(F.col("n_rows").cast("int"), "n_cols").alias("shape"), "error").alias(s))
        whole = whole.join(one, f"{s}_q", "left")
    same = [placed[c].eqNullSafe(whole[c]) for c in ("pred_q", "gold_q", "ordered")]
    return (
        placed.join(whole, same[0] & same[1] & same[2])
        .select(
            F.col("idx").alias("index"), "db_id", "question", "reasoning_type", "gold_sql", "pred_sql",
            F.coalesce("pred.ok", F.lit(False)).alias("valid"), "match", "similarity", "sim_row", "sim_col",
            F.when(F.col("pred.ok"), F.col("pred.shape")).alias("pred_shape"), F.when(F.col("gold.ok"), F.col("gold.shape")).alias("gold_shape"),
            F.when(blank, "empty prediction").otherwise(F.col("pred.error")).alias("pred_error"), F.col("gold.error").alias("gold_error"),
        )
    )


CANDIDATES = "question long, candidate long, db_id string, sql string"


def voted(spark: SparkSession, candidates: DataFrame, databases: dict[str, Database], timeout_s: float = TIMEOUT_S) -> tuple[DataFrame, DataFrame]:
    """(winners, outcomes) of candidates (question, candidate, db_id, sql), run and voted by result: rows (question, winner, votes,
    n_candidates) and (question, candidate, ok, n_rows, error).

    An empty text counts as a query that ran without result, as candidates have no guard for it. Each different query of a
    database runs once.
    """
    each = cut(candidates.select("question", "candidate", "db_id", F.coalesce("sql", F.lit("")).alias("sql"), F.lit(False).alias("ordered")))
    queries = _numbered(each)
    cells, shape = stage_queries(spark, databases, _listed(queries), timeout_s)
    keys = result_keys(cells, shape).select("sample_id", "key")
    outcomes = cut(_with(each, queries, "sql", "sample_id").join(shape.select("sample_id", "ok", "n_rows", "error"), "sample_id").join(keys, "sample_id"))
    return winners(outcomes, "question", "candidate", "ok", "key"), outcomes.select("question", "candidate", "ok", "n_rows", "error")


def vote(spark: SparkSession, candidates: DataFrame | list[tuple[int, int, str, str]], databases: dict[str, Database], timeout_s: float = TIMEOUT_S) -> DataFrame:
    """The winners of voted(); candidates may be a list."""
    rows = spark.createDataFrame(candidates, CANDIDATES) if isinstance(candidates, list) else candidates
    return voted(spark, rows, databases, timeout_s)[0]
