"""What the checks of a run were worth, from its traces and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.functions.sqltext import sql_facts
from querylens.operators import nested
from querylens.operators.checks import CONVENTION, EXTRA, _expressions, with_catalog
from querylens.operators.declarations import declared_sheet
from querylens.operators.scores import check_precision
from querylens.operators.shared import cut

#: The checks whose worth is in question; the others hold by construction.
MEASURED = {k: v for k, v in (EXTRA | CONVENTION).items()}
#: Those of them that need a sheet.
OF_SHEET = ("C5b", "C7-dodge")


def last_declarations(traces: DataFrame) -> DataFrame:
    """Rows (record, version, declarations): of the last candidate with checks, the declarations of the last round that has any, else
    those directly under checks. Candidates count by position; records without any have no row."""
    path = "candidates"
    shape = {"candidates": [{"checks": {"rounds": [{}]}}]}
    found = cut(nested.triples(traces, "trace_id", "payload", shape, [path, "candidates.checks.rounds"]))
    checks = found.where((F.col("path") == path) & F.col("leaf").startswith("checks.")).groupBy("record", "version").agg(F.max(F.col("ordinals")[0]).alias("last"))
    rounds = found.where("path = 'candidates.checks.rounds'").groupBy("record", "version").agg(F.max(F.col("ordinals")[0]).alias("last_round"))
    last = checks.join(rounds, ["record", "version"], "full").select("record", "version", F.greatest("last", "last_round").alias("last"))
    held = found.where("leaf in ('declarations', 'checks.declarations') and value is not null and value not in ('', '{}')").select("record", "version", F.col("ordinals")[0].alias("last"), F.coalesce(F.try_element_at("ordinals", F.lit(2)), F.lit(-1)).alias("round_no"), "value")
    return held.join(last, ["record", "version", "last"]).groupBy("record", "version").agg(F.max_by("value", "round_no").alias("declarations"))


def final_sql(traces: DataFrame) -> DataFrame:
    """Rows (record, version, final_sql)."""
    found = nested.triples(traces, "trace_id", "payload", {}, [""])
    return found.where("leaf = 'final_sql'").select("record", "version", F.col("value").alias("final_sql"))


def hits(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (id, check) for rows (id, db_id, question, sql, declarations) on which a measured check speaks.

    Queries that can't be parsed are passed over; without a readable sheet only the checks that need none speak.
    """
    ready = _expressions(with_catalog(rows.withColumn("facts", sql_facts("sql")).withColumn("sheet", declared_sheet("declarations")).where("facts.error is null"), catalog))
    spoke = F.array(*(F.when((F.size(rule()) > 0) & (F.col("sheet.error").isNull() if name in OF_SHEET else F.lit(True)), F.lit(name)) for name, rule in MEASURED.items()))
    return ready.select("id", F.explode(F.filter(spoke, lambda x: x.isNotNull())).alias("check"))


def precision_of_run(data: DataFrame, predictions: DataFrame, traces: DataFrame, results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of scores.check_precision for the files of one run, matched by position: data (idx, db_id, question), predictions (idx,
    pred_sql), traces (idx, payload), results (idx, match). Files of other lengths than the data raise ValueError."""
    sizes = {name: df.count() for name, df in (("data", data), ("predictions", predictions), ("traces", traces))}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"files of different lengths: {sizes}")
    last = last_declarations(traces.select(F.col("idx").alias("trace_id"), "payload")).select(F.col("record").alias("idx"), "declarations")
    rows = data.select("idx", "db_id", "question").join(predictions, "idx").join(last, "idx", "left")
    return check_precision(hits(rows.select(F.col("idx").alias("id"), "db_id", "question", F.col("pred_sql").alias("sql"), "declarations"), catalog), results.select(F.col("idx").alias("id"), "match"), "id")
