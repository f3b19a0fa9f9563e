"""Queries over nested traces (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.operators import nested
from querylens.sources.tables import table


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("record", "trace_id").drop("version")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _flat(nested.outputs(table(spark, d, "traces"))).select(F.col("trace_id").cast("long").alias("trace_id"), "candidate_no", "round_no", "output_no")


def p4_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _flat(nested.candidates(table(spark, d, "traces")))


def p4_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _flat(nested.rounds(table(spark, d, "traces")))


def p4_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(nested.outputs(table(spark, d, "traces")))


def p4_assumptions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(nested.assumptions(table(spark, d, "traces")))


def p4_considered(spark: SparkSession, d: str) -> DataFrame:
    return _flat(nested.considered(table(spark, d, "traces")))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The repeated ancestors that the payloads hold, found from their arrays."""
    return nested.repeated_paths(table(spark, d, "traces"), "payload")


QUERIES = {f.__name__: f for f in (p4_paths, p4_found, p4_candidates, p4_rounds, p4_outputs, p4_assumptions, p4_considered)}


def _object(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'OBJECT' THEN {x} WHEN 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') AND json_type({x} ->> '$') = 'OBJECT' THEN ({x} ->> '$')::JSON END END"


def _array(x: str) -> str:
    as_text = f"CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END"
    one = f"CASE json_type({x}) WHEN 'VARCHAR' THEN {as_text} ELSE {x} END"
    return f"CASE json_type({one}) WHEN 'ARRAY' THEN ({one})::JSON[] WHEN 'OBJECT' THEN [{one}] ELSE []::JSON[] END"


def _elements(source: str, keys: str, array: str, number: str, name: str) -> str:
    return f"(SELECT {keys}, {number}, {_object('e')} AS {name} FROM (SELECT {keys}, unnest(a) AS e, (generate_subscripts(a, 1) - 1)::INT AS {number} FROM (SELECT {keys}, {_array(array)} AS a FROM {source})))"


_CAND = f"""
  t AS (SELECT trace_id, payload::JSON AS j FROM traces WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  c AS (SELECT * FROM {_elements('t', 'trace_id', "j -> 'candidates'", 'candidate_no', 'cand')} WHERE cand IS NOT NULL),
  k AS (SELECT trace_id, candidate_no, {_object("cand -> 'checks'")} AS chk FROM c),
  r AS (SELECT * FROM {_elements('k', 'trace_id, candidate_no', "chk -> 'rounds'", 'round_no', 'rnd')} WHERE rnd IS NOT NULL),
  decl AS (SELECT trace_id, candidate_no, round_no, {_object("rnd -> 'declarations'")} AS d FROM r UNION ALL SELECT trace_id, candidate_no, -1, {_object("chk -> 'declarations'")} FROM k)"""


def _declared_sql(what: str, number: str, leaves: tuple[str, ...]) -> str:
    found = _elements("decl", "trace_id, candidate_no, round_no", f"d -> '{what}'", number, "o")
    columns = "".join(f", o ->> '{c}' AS \"{c}\"" for c in leaves)
    return f"WITH {_CAND} SELECT trace_id, candidate_no, round_no, {number}{columns} FROM {found} WHERE o IS NOT NULL"


ORACLE: dict[str, str] = {
    "p4_found": _declared_sql("outputs", "output_no", ()),
    "p4_outputs": _declared_sql("outputs", "output_no", ("name", "source", "column", "expr")),
    "p4_considered": _declared_sql("considered", "considered_no", ("item", "used", "note")),
    "p4_assumptions": _declared_sql("assumptions", "assumption_no", ("target", "where", "value")),
    "p4_candidates": f"WITH {_CAND} SELECT trace_id, candidate_no, cand ->> 'plan' AS plan, cand ->> 'sql' AS sql, cand ->> 'ok' AS ok, cand ->> 'error' AS error, cand ->> 'n_rows' AS n_rows, chk ->> 'passed' AS passed FROM c JOIN k USING (trace_id, candidate_no)",
    "p4_rounds": f"""WITH {_CAND} SELECT trace_id, candidate_no, round_no, rnd ->> 'sql' AS sql, {_object("d -> 'time_context'")} ->> 'displaced' AS displaced, {_object("d -> 'time_context'")} ->> 'reference' AS reference FROM r JOIN decl USING (trace_id, candidate_no, round_no)""",
}

ORACLE["p4_paths"] = r"""SELECT regexp_replace(replace(j.fullkey, '"', ''), '\[[0-9]+\]', '[]', 'g')[3:] AS path, count(*) AS n_arrays, sum(json_array_length(j.value))::BIGINT AS n_elements
  FROM (SELECT payload FROM traces WHERE json_valid(payload)) t, json_tree(t.payload) j WHERE j.type = 'ARRAY' GROUP BY 1"""
