"""Queries over the texts of questions and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions import labels, sqltext
from querylens.operators.checks import equality_literals, validate
from querylens.operators.declarations import declared_sheet
from querylens.operators.measure import last_declarations
from querylens.plans.scores import _measured
from querylens.sources.tables import table


def extract_sql(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_results").select("result_id", sqltext.extract_sql(F.col("pred_sql")).alias("sql"))


def outer_order_by(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_results").select("result_id", sqltext.has_outermost_order_by(F.col("gold_sql")).alias("ordered"))


def sql_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every prediction, counted by what they are; each different text is parsed once."""
    facts = sqltext.facts(table(spark, d, "sample_results").groupBy("pred_sql").agg(F.count("*").alias("times")), "pred_sql")
    items = F.size("facts.kinds")
    return facts.groupBy(F.col("facts.error").isNull().alias("parsed"), F.coalesce(items, F.lit(-1)).alias("n_items"), F.col("facts.has_div").alias("has_div"), F.col("facts.has_abs").alias("has_abs"), F.col("facts.select_has_sub").alias("has_sub"), F.col("facts.has_now").alias("has_now")).agg(F.sum("times").alias("n"))


def reasoning_labels(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("reasoning_type")
    return table(spark, d, "samples").select("sample_id", labels.coarse_reasoning(r).alias("coarse"), labels.describe_reasoning(r).alias("described"))


FLAGS = {"given_percentage": labels.GIVEN_PERCENTAGE, "ratio": labels.RATIO, "difference": labels.DIFFERENCE, "displaced": labels.DISPLACED, "current": labels.CURRENT}


def question_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("sample_id", *(labels.says(F.col("question"), p).alias(name) for name, p in FLAGS.items()))


def now_literals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_results").groupBy(labels.says(F.col("pred_sql"), labels.NOW_LITERAL).alias("has_now")).agg(F.count("*").alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).agg(F.count("*").alias("n"))


def declaration_parse(spark: SparkSession, d: str) -> DataFrame:
    """The last sheet of every trace and how it reads."""
    found = last_declarations(table(spark, d, "traces")).select("record", declared_sheet("declarations").alias("s"))
    return found.select(F.col("record").alias("trace_id"), "s.error", "s.displaced", F.size("s.outputs").alias("n_outputs"), F.size("s.assumptions").alias("n_assumptions"), F.size("s.considered").alias("n_considered"))


def check_issues(spark: SparkSession, d: str) -> DataFrame:
    """All checks on the final query and last sheet of every trace, but C3n: the databases of the traces have no stored values here, and C5a, as there are no counts to prove profile items by."""
    rows = _measured(spark, d).where("declarations is not null")
    rows = rows.withColumn("facts", sqltext.sql_facts("sql")).withColumn("sheet", declared_sheet("declarations")).withColumn("profile_items", F.expr("cast(array() as array<string>)"))
    return validate(rows, table(spark, d, "schema_columns"), extra=True, convention=True).select(F.col("id").alias("trace_id"), "check", "ord", "issue")


def compared_literals(spark: SparkSession, d: str) -> DataFrame:
    """Text literals of gold queries and the one table of the database that has the column compared."""
    rows = table(spark, d, "samples").select(F.col("sample_id").alias("id"), "db_id", "query")
    return equality_literals(sqltext.facts(rows, "query"), table(spark, d, "schema_columns")).groupBy("table_name", "column_name").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (extract_sql, outer_order_by, sql_facts, reasoning_labels, question_flags, now_literals, json_props, declaration_parse, check_issues, compared_literals)}

_NO_TEXT = "regexp_replace(gold_sql, '''([^'']|'''')*''|\"([^\"]|\"\")*\"|`([^`]|``)*`', ' ', 'g')"
_FLAT = _NO_TEXT
for _ in range(4):
    _FLAT = f"regexp_replace({_FLAT}, '\\([^()]*\\)', ' ', 'g')"
# an unclosed bracket keeps what follows inside
_FLAT = f"regexp_replace({_FLAT}, '[()].*', '', 's')"
_PART = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.REASONING.items()) + " END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = {
    "extract_sql": r"""SELECT result_id, regexp_replace(CASE WHEN regexp_matches(pred_sql, '(?is)```(?:sql)?\s*(.*?)```') THEN regexp_extract(pred_sql, '(?is)```(?:sql)?\s*(.*?)```', 1) ELSE pred_sql END, '^\s+|\s+$', '', 'g') AS sql FROM sample_results""",
    "outer_order_by": rf"SELECT result_id, coalesce(regexp_matches(lower({_FLAT}), '\border\W+by\b'), false) AS ordered FROM sample_results",
    "reasoning_labels": f"""WITH p AS (SELECT sample_id, reasoning_type, list_filter(list_transform(regexp_split_to_array(coalesce(reasoning_type, ''), '\\s+'), lambda x: {_PART}), lambda x: x IS NOT NULL) AS w FROM samples)
      SELECT sample_id, CASE WHEN coalesce(reasoning_type, '') = '' THEN 'unknown' ELSE 'A' || CASE WHEN contains(reasoning_type, 'C') THEN '+C' ELSE '' END || CASE WHEN contains(reasoning_type, 'H') THEN '+H' ELSE '' END END AS coarse,
        CASE len(w) WHEN 0 THEN '' WHEN 1 THEN w[1] ELSE array_to_string(w[1 : len(w) - 1], ', ') || ', and ' || w[len(w)] END AS described FROM p""",
    "question_flags": "SELECT sample_id, " + ", ".join(f"coalesce(regexp_matches(question, {_q(p)}), false) AS {n}" for n, p in FLAGS.items()) + " FROM samples",
    "now_literals": f"SELECT coalesce(regexp_matches(pred_sql, {_q(labels.NOW_LITERAL)}), false) AS has_now, count(*) AS n FROM sample_results GROUP BY 1",
    "json_props": "SELECT (props ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
}
