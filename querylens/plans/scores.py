"""Queries over evaluated samples: roll-ups, votes, worth of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.labels import coarse_reasoning
from querylens.operators import measure, nested, scores, vote
from querylens.operators.shared import cut, small
from querylens.plans.traces import ORACLE as TRACE_SQL
from querylens.sources.tables import table


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_results")


def score_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scores.rollup(_results(spark, d))


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return scores.summary(_results(spark, d))


def score_by_db(spark: SparkSession, d: str) -> DataFrame:
    return scores.by(_results(spark, d), F.col("db_id"), "db_id")


def score_by_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return scores.by(_results(spark, d), coarse_reasoning(F.col("reasoning_type")), "reasoning")


def score_by_run(spark: SparkSession, d: str) -> DataFrame:
    return scores.by(_results(spark, d), F.col("run_id"), "run_id")


def prediction_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Results and samples aligned by position: how many results of a run stand at the position of their own sample."""
    results = _results(spark, d).select("run_id", "sample_idx", "sample_id")
    samples = table(spark, d, "samples").select(F.col("idx").alias("sample_idx"), F.col("sample_id").alias("placed_id"))
    return results.join(samples, "sample_idx", "left").groupBy("run_id").agg(F.count("*").alias("n"), F.count("placed_id").alias("n_placed"), F.count_if(F.col("placed_id") == F.col("sample_id")).alias("n_same"))


def vote_winner(spark: SparkSession, d: str) -> DataFrame:
    """Events as candidates: user_id is the question, event_id the place, event_type the result; errors didn't run."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type").withColumn("ok", F.col("event_type") != "error")
    return vote.winners(events, "user_id", "event_id", "ok", "event_type")


def vote_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of traces voted by the number of rows of their results."""
    found = nested.candidates(table(spark, d, "traces")).withColumn("ok", F.col("ok") == "true")
    return vote.winners(found, "record", "candidate_no", "ok", "n_rows").withColumnRenamed("record", "trace_id")


def check_precision_length(spark: SparkSession, d: str) -> DataFrame:
    """How often two simple rules on the text of a prediction speak about wrong and right ones."""
    rows = _results(spark, d).select("result_id", "pred_sql", "match")
    rules = F.array(F.when(F.length("pred_sql") > 250, "long"), F.when(F.rlike("pred_sql", F.lit("(?i) join ")), "join"))
    return scores.check_precision(rows.select("result_id", F.explode(rules).alias("check")), rows, "result_id")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    traces, samples = table(spark, d, "traces"), table(spark, d, "samples").select("sample_id", "db_id", "question")
    final = measure.final_sql(traces).join(measure.last_declarations(traces), ["record", "version"], "left")
    return final.join(traces.select(F.col("trace_id").alias("record"), "sample_id").distinct(), "record").join(samples, "sample_id").select(F.col("record").alias("id"), "sample_id", "db_id", "question", F.col("final_sql").alias("sql"), "declarations")


def check_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which measured checks speak about the final query of a trace."""
    return measure.hits(_measured(spark, d), table(spark, d, "schema_columns")).select(F.col("id").alias("trace_id"), "check")


def check_precision(spark: SparkSession, d: str) -> DataFrame:
    """The worth of each check on the traces of all runs; a trace is right if its query has a matching result in the table."""
    rows = cut(_measured(spark, d))
    right = _results(spark, d).where("match").select("sample_id", F.col("pred_sql").alias("sql")).distinct().withColumn("match", F.lit(True))
    verdicts = rows.select("id", "sample_id", "sql").join(right, ["sample_id", "sql"], "left").select("id", F.coalesce("match", F.lit(False)).alias("match"))
    return scores.check_precision(measure.hits(rows, table(spark, d, "schema_columns")), verdicts, "id")


def dataset_inventory(spark: SparkSession, d: str) -> DataFrame:
    from querylens.sources.datasets import inventory

    return inventory(table(spark, d, "samples").select("db_id"), table(spark, d, "db_registry").select("db_id", "n_tables"))


def missing_literal_exact(spark: SparkSession, d: str) -> DataFrame:
    """Literals compared with a column that doesn't hold them: the vendors of gold queries against the brands of parts."""
    literals = _results(spark, d).select("result_id", F.regexp_extract("gold_sql", r"(?i)vendor\W{0,3}=\s*'([^']*)'", 1).alias("value")).where("value != ''")
    return literals.join(small(table(spark, d, "part").select(F.col("p_brand").alias("value")).distinct()), "value", "left_anti").groupBy("value").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (score_rollup, score_summary, score_by_db, score_by_reasoning, score_by_run, prediction_alignment, vote_winner, vote_candidates, check_precision_length, check_hits, check_precision, dataset_inventory, missing_literal_exact)}

_METRICS = """count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE match) AS n_match,
  format('{:.4f}', count(*) FILTER (WHERE valid) / count(*))::DOUBLE AS va, format('{:.4f}', count(*) FILTER (WHERE match) / count(*))::DOUBLE AS ex,
  format('{:.4f}', sum(round(coalesce(similarity, 0) * 10000)::BIGINT)::BIGINT / (count(*) * 10000))::DOUBLE AS sim"""
_COARSE = "CASE WHEN reasoning_type IS NULL OR reasoning_type = '' THEN 'unknown' ELSE 'A' || CASE WHEN contains(reasoning_type, 'C') THEN '+C' ELSE '' END || CASE WHEN contains(reasoning_type, 'H') THEN '+H' ELSE '' END END"


def _votes(source: str, question: str, index: str, ok: str, key: str) -> str:
    return f"""WITH g AS (SELECT {question}, {key} AS k, {ok} AS ran, count(*) AS n, min({index}) AS first, max({index}) AS last FROM {source} GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY {question} ORDER BY n DESC, first) AS place FROM g WHERE ran),
      q AS (SELECT {question}, max(last) AS last, sum(n)::BIGINT AS n_candidates FROM g GROUP BY {question})
      SELECT q.{question}, coalesce(r.first, q.last) AS winner, coalesce(n, 0)::BIGINT AS votes, n_candidates FROM q LEFT JOIN r ON r.place = 1 AND q.{question} IS NOT DISTINCT FROM r.{question}"""


ORACLE = {
    "score_rollup": f"""SELECT 'all' AS level, NULL AS key, {_METRICS} FROM sample_results UNION ALL SELECT 'db', db_id, {_METRICS} FROM sample_results GROUP BY db_id
      UNION ALL SELECT 'reasoning', {_COARSE}, {_METRICS} FROM sample_results GROUP BY {_COARSE}""",
    "score_summary": f"SELECT {_METRICS} FROM sample_results",
    "score_by_db": f"SELECT db_id, {_METRICS} FROM sample_results GROUP BY db_id",
    "score_by_reasoning": f"SELECT {_COARSE} AS reasoning, {_METRICS} FROM sample_results GROUP BY 1",
    "score_by_run": f"SELECT run_id, {_METRICS} FROM sample_results GROUP BY run_id",
    "prediction_alignment": "SELECT run_id, count(*) AS n, count(s.sample_id) AS n_placed, count(*) FILTER (WHERE s.sample_id = r.sample_id) AS n_same FROM sample_results r LEFT JOIN samples s ON r.sample_idx = s.idx GROUP BY run_id",
    "vote_winner": _votes("events", "user_id", "event_id", "event_type <> 'error'", "CASE WHEN event_type <> 'error' THEN event_type END"),
    "vote_candidates": _votes(f"({TRACE_SQL['p4_candidates']})", "trace_id", "candidate_no", "coalesce(ok = 'true', false)", "CASE WHEN ok = 'true' THEN coalesce(n_rows, '-') END"),
    "check_precision_length": """WITH h AS (SELECT result_id, 'long' AS "check", match FROM sample_results WHERE length(pred_sql) > 250 UNION ALL SELECT result_id, 'join', match FROM sample_results WHERE regexp_matches(pred_sql, '(?i) join '))
      SELECT "check", count(*) AS triggered, count(*) FILTER (WHERE NOT coalesce(match, false)) AS useful, count(*) FILTER (WHERE match) AS harmful FROM h GROUP BY 1""",
    "dataset_inventory": """SELECT coalesce(s.db_id, r.db_id) AS db_id, CASE WHEN s.n IS NULL THEN 'unreferenced' WHEN coalesce(n_tables, 0) = 0 THEN 'missing' ELSE 'ok' END AS status, coalesce(s.n, 0) AS n_samples, coalesce(n_tables, 0)::INT AS n_tables
      FROM (SELECT db_id, count(*) AS n FROM samples WHERE db_id IS NOT NULL GROUP BY 1) s FULL JOIN db_registry r ON s.db_id = r.db_id""",
    "missing_literal_exact": r"""WITH l AS (SELECT regexp_extract(gold_sql, '(?i)vendor\W{0,3}=\s*''([^'']*)''', 1) AS value FROM sample_results) SELECT value, count(*) AS n FROM l WHERE value <> '' AND value NOT IN (SELECT p_brand FROM part) GROUP BY value""",
}
