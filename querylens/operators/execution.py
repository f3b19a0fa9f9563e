"""Running foreign queries: read-only, with a deadline, each on its own, results staged as cells.

Every query has another schema and may fail, so they can't be one plan: a bounded pool of driver threads hands them to the
cluster, and each result goes to the shared folder as cells. Nothing of a result comes to the driver.
"""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import inheritable_thread_target

from querylens.functions.dialect import to_spark
from querylens.operators.cells import CELLS, SHAPE, stage
from querylens.operators.shared import _made, cut, shared_dir

log = logging.getLogger("querylens")
TIMEOUT_S = 30.0
THREADS = 8


class Refused(ValueError):
    pass


class Database:
    """Named tables in a session of their own, with ANSI mode off; names of two databases don't clash."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | str]):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: set[str] = set()
        for name, table in tables.items():
            if isinstance(table, str):
                df = self.spark.read.parquet(table)
            else:  # another session can't see a plan of this one, but it can read a written table
                written = table if hasattr(table, "_querylens_at") else cut(table)
                df = self.spark.read.schema(table.schema).parquet(written._querylens_at)
            df.createOrReplaceTempView(name)
            self.names |= {name.lower(), *(c.lower() for c in df.columns)}

    def schema_info(self) -> dict[str, set[str]]:
        """Table names with their column names, all in lower case."""
        return {t.name.lower(): {c.lower() for c in self.spark.table(t.name).columns} for t in self.spark.catalog.listTables() if t.isTemporary}


def stored_values(spark: SparkSession, databases: dict[str, Database]):
    """A function from rows (db_id, table_name, column_name) to the different values of these columns, (db_id, table_name,
    column_name, value, number); number is null but for columns of numbers. Unknown databases, tables and columns have none."""
    schema = "db_id string, table_name string, column_name string, value string, number double"

    def values(wanted: DataFrame) -> DataFrame:
        found = spark.createDataFrame([], schema)
        tables: dict[tuple[str, str], list[str]] = {}
        for r in wanted.select("db_id", "table_name", "column_name").distinct().collect():
            tables.setdefault((r["db_id"], r["table_name"]), []).append(r["column_name"])
        for (db_id, name), columns in tables.items():
            own = databases[db_id].spark if db_id in databases else None
            if own is None or name.lower() not in databases[db_id].schema_info():
                continue
            df = own.table("`" + name.replace("`", "``") + "`")
            kinds = {f.name.lower(): f for f in df.schema.fields}
            cells = []
            for c in columns:
                if c.lower() in kinds:
                    f = kinds[c.lower()]
                    cell = F.col("`" + f.name.replace("`", "``") + "`")
                    cells.append(F.struct(F.lit(c).alias("column_name"), cell.cast("string").alias("value"), (cell.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")).alias("number")))
            if cells:
                rows = df.select(F.explode(F.array(*cells)).alias("of")).select("of.*").where("value is not null").distinct()
                written = cut(rows.select(F.lit(db_id).alias("db_id"), F.lit(name).alias("table_name"), "column_name", "value", "number"))
                found = found.unionByName(spark.read.schema(schema).parquet(written._querylens_at))
        return found

    return values


def refuse_writes(spark: SparkSession, sql: str) -> None:
    """Raise Refused if the text holds anywhere what isn't a query: commands and parsed statements, also below WITH."""
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    stack = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while stack:
        node = stack.pop()
        if any(k.isInstance(node) for k in kinds):
            raise Refused(f"not a query: {node.nodeName()}")
        for seq in (node.children(), node.innerChildren()):
            stack.extend(x for x in (seq.apply(i) for i in range(seq.size())) if hasattr(x, "innerChildren"))


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _integer_division(spark: SparkSession, sql: str) -> str:
    """Whole numbers divide to whole numbers: divisions of two integral values become DIV, found on the analysed plan by type
    and put into the text by their place in it, one after the other."""
    if "/" not in sql:
        return sql
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    for _ in range(sql.count("/")):
        found, stack = None, [("plan", spark.sql(sql)._jdf.queryExecution().analyzed())]
        while stack and found is None:
            kind, node = stack.pop()
            if kind == "plan":
                stack += [("plan", x) for x in seq(node.children())] + [("plan", x) for x in seq(node.subqueries())]
                stack += [("expr", x) for x in seq(node.expressions())]
                continue
            stack += [("expr", x) for x in seq(node.children())]
            if node.getClass().getSimpleName() == "Divide":
                sides = seq(node.children())
                if all(s.getClass().getSimpleName() == "Cast" and s.child().dataType().simpleString() in INTEGRAL for s in sides):
                    places = [node.origin()] + [s.child().origin() for s in sides]
                    at = [(o.startIndex().get(), o.stopIndex().get()) for o in places if o.startIndex().isDefined()]
                    if len(at) == 3:
                        found = at
        if found is None:
            return sql
        (lo, hi), (_, left), (right, _) = found
        gap = sql[left + 1 : right]
        sql = sql[: left + 1] + gap.replace("/", " DIV ", 1) + sql[right:]
    return sql


@dataclass
class Outcome:
    ok: bool
    n_cols: int = 0
    error: str | None = None


def prepared(database: Database, sql: str) -> DataFrame:
    """The query as a DataFrame, not run yet. Raises if it is no query, can't be read or names what isn't there."""
    text = to_spark(sql, frozenset(database.names))
    refuse_writes(database.spark, text)
    return database.spark.sql(_integer_division(database.spark, text))


def run(database: Database, sql: str, query_id: int, side: str, into: str, ordered: bool, timeout_s: float = TIMEOUT_S) -> Outcome:
    """Stage the cells of one query; whatever goes wrong is in the outcome. A text without statement is a query without
    result. The deadline cancels the query's jobs, and no others."""
    spark = database.spark
    tag = f"q-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    timer.daemon = True
    spark.sparkContext.addJobTag(tag)
    try:
        if not to_spark(sql):
            return Outcome(True)
        timer.start()
        df = prepared(database, sql)
        cells = stage(df.withColumn("_m", F.monotonically_increasing_id()), query_id, side, [f"c{len(df.columns)}"]).where(F.col("col_idx") < len(df.columns)) if ordered else stage(df, query_id, side)
        cells.write.parquet(f"{into}/query={query_id}")  # a folder each, as writers in one folder disturb each other
        return Outcome(True, len(df.columns))
    except Exception as e:  # any failure is the query's result
        kind = "Timeout" if late.is_set() else type(e).__name__
        return Outcome(False, error=f"{kind}: {(str(e).strip().splitlines() or [''])[0][:300]}" if not late.is_set() else f"Timeout: more than {timeout_s:g} s")
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def stage_queries(spark: SparkSession, databases: dict[str, Database], queries: Iterable[tuple[int, str, str, bool]], timeout_s: float = TIMEOUT_S, threads: int = THREADS) -> tuple[DataFrame, DataFrame]:
    """(cells, shape) of many queries (id, db_id, sql, ordered); sample_id is the id, side is empty.

    An unknown db_id raises KeyError. Queries are taken from the iterator as threads get free, and only their outcomes are
    kept. Row counts come from one job over all cells.
    """
    into = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    _made.add(into)
    facts: list[tuple[int, bool, int, str | None]] = []
    with ThreadPoolExecutor(threads) as pool:
        work = inheritable_thread_target(spark)(lambda q: (q[0], run(databases[q[1]], q[2], q[0], "", into, q[3], timeout_s)))
        while some := list(islice(queries := iter(queries), 20 * threads)):
            for _, db, _, _ in some:
                databases[db]
            facts += [(i, o.ok, o.n_cols, o.error) for i, o in pool.map(work, some)]
            log.info("%d queries run", len(facts))
    staged = any(ok and n_cols for _, ok, n_cols, _ in facts)
    cells = spark.read.schema(CELLS).parquet(into).drop("query") if staged else spark.createDataFrame([], CELLS)
    counts = cells.where("col_idx = 0").groupBy("sample_id").agg(F.count("*").alias("n_rows"))
    outcomes = spark.createDataFrame(facts, "sample_id long, ok boolean, n_cols int, error string")
    n = F.when(F.col("ok"), F.coalesce("n_rows", F.lit(0)))
    shape = outcomes.join(counts, "sample_id", "left").select("sample_id", F.lit("").alias("side"), "ok", n.alias("n_rows"), "n_cols", "error")
    assert [f.name for f in shape.schema] == [c.split()[0] for c in SHAPE.split(", ")]
    return cells, shape
