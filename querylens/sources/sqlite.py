"""SQLite files as databases: located by name, opened read-only, read as tables with the types their values have.

Python's sqlite3 reads the files where they are, in ranges of rows, so a large table is read by many tasks; the folder
must be one that all executors see.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylens.operators.execution import Database
from querylens.operators.shared import cut

ROWS = 200_000


def find(folder: str, db_id: str) -> str:
    """<folder>/<db_id>/<db_id>.sqlite, else .db; empty files don't count. FileNotFoundError if there is none."""
    for ending in ("sqlite", "db"):
        path = os.path.join(folder, db_id, f"{db_id}.{ending}")
        if os.path.isfile(path) and os.path.getsize(path) > 0:
            return path
    raise FileNotFoundError(f"no database {db_id!r} in {folder}")


def connect(path: str) -> sqlite3.Connection:
    """Read-only; text that isn't UTF-8 is read with replacement characters."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_names(con: sqlite3.Connection) -> list[str]:
    """Tables in the order they were made, without those of SQLite itself."""
    return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY rowid")]


def catalog(spark: SparkSession, databases: dict[str, str]) -> DataFrame:
    """Catalog rows of files {db_id: path}: (db_id, table_name, column_name, ord, decl_type, is_pk, fk_table, table_ord)."""
    rows = []
    for db_id, path in databases.items():
        con = connect(path)
        try:
            for n, t in enumerate(table_names(con)):
                parents = {r[3].lower(): r[2] for r in con.execute(f"PRAGMA foreign_key_list({_q(t)})")}
                rows += [(db_id, t, r[1], r[0], r[2], bool(r[5]), parents.get(r[1].lower()), n) for r in con.execute(f"PRAGMA table_info({_q(t)})")]
        finally:
            con.close()
    return spark.createDataFrame(rows, "db_id string, table_name string, column_name string, ord int, decl_type string, is_pk boolean, fk_table string, table_ord int")


def _type(kinds: set[str]) -> T.DataType:
    """The type that all values of a column have; text if they differ."""
    kinds = kinds - {"null"}
    if kinds <= {"integer"}:
        return T.LongType()
    if kinds <= {"integer", "real"}:
        return T.DoubleType()
    return T.BinaryType() if kinds == {"blob"} else T.StringType()


def read_table(spark: SparkSession, path: str, name: str, rows: int = ROWS) -> DataFrame:
    """One table. A column of whole numbers is bigint, of numbers double, of blobs binary, any other is text."""
    con = connect(path)
    try:
        columns = [r[1] for r in con.execute(f"PRAGMA table_info({_q(name)})")]
        found = [{r[0] for r in con.execute(f"SELECT DISTINCT typeof({_q(c)}) FROM {_q(name)}")} for c in columns]
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_q(name)}").fetchone()
            ranges = [(a, min(a + rows - 1, high)) for a in range(low, high + 1, rows)] if low is not None else []
        except sqlite3.OperationalError:  # a table without row ids is read at once
            ranges = [(None, None)]
    finally:
        con.close()
    schema = T.StructType([T.StructField(c, _type(k)) for c, k in zip(columns, found)])
    wanted = ", ".join(f"CAST({_q(c)} AS TEXT)" if isinstance(f.dataType, T.StringType) else _q(c) for c, f in zip(columns, schema.fields))
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in schema.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = connect(path)
                try:
                    cursor = own.execute(f"SELECT {wanted} FROM {_q(name)}" + (" WHERE rowid BETWEEN ? AND ?" if lo is not None else ""), (lo, hi) if lo is not None else ())
                    while part := cursor.fetchmany(20_000):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], columns)
                finally:
                    own.close()

    asked = spark.createDataFrame(ranges, "lo long, hi long")
    return asked.repartition(max(1, len(ranges)), "lo").mapInArrow(read, schema)


def load(spark: SparkSession, path: str) -> Database:
    """The file as a database for evaluation: its tables are written to the shared folder once, as columns."""
    con = connect(path)
    try:
        names = table_names(con)
    finally:
        con.close()
    return Database(spark, {t: cut(read_table(spark, path, t)) for t in names})


def first_tables(spark: SparkSession, databases: dict[str, str]) -> dict[str, str]:
    """The first table of each file, for the baseline generator."""
    rows = catalog(spark, databases).where("table_ord = 0").groupBy("db_id").agg(F.first("table_name").alias("t")).collect()
    return {r["db_id"]: r["t"] for r in rows}
