"""Result sets of any schema as rows of one schema, one per cell, so that many results are compared in one job.

cells(sample_id long, side string, row_pos long, col_idx int, cell string)
shape(sample_id long, side string, ok boolean, n_rows long, n_cols int, error string)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylens.functions.labels import python_round
from querylens.operators.shared import with_position

CELLS = "sample_id long, side string, row_pos long, col_idx int, cell string"
SHAPE = "sample_id long, side string, ok boolean, n_rows long, n_cols int, error string"
DIGITS = 6


def cell_text(x: Column, kind: T.DataType) -> Column:
    """Text that is equal exactly where values count as equal: numbers by value whatever their type, fractions to six
    places, text as it is, null like null. NaN counts as null, as SQLite stores it."""
    if isinstance(kind, T.BooleanType):
        text = F.concat(F.lit("n"), x.cast("int").cast("string"))
    elif isinstance(kind, T.IntegralType):
        text = F.concat(F.lit("n"), x.cast("string"))
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        value = x.cast("double")
        near = python_round(value, DIGITS)
        plain = F.when((near == F.floor(near)) & (F.abs(near) < 2.0**63), near.cast("long").cast("string")).otherwise(near.cast("string"))
        text = F.when(F.isnan(value), F.lit("z")).when(value == float("inf"), F.lit("n+inf")).when(value == float("-inf"), F.lit("n-inf")).otherwise(F.concat(F.lit("n"), plain))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("b"), F.hex(x))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.concat(F.lit("s"), F.to_json(x))
    elif isinstance(kind, T.NullType):
        text = F.lit("z")
    else:
        text = F.concat(F.lit("s"), x.cast("string"))
    return F.coalesce(text, F.lit("z"))


def stage(result: DataFrame, sample_id: int | Column, side: str, order: list[str] | None = None) -> DataFrame:
    """The cells of a result. Columns go by position, so names may repeat or clash.

    Row positions are any distinct numbers, unless order names the columns (c0, c1, ...) by which rows are counted from 0.
    """
    names = [f"c{i}" for i in range(len(result.columns))]
    plain = result.toDF(*names)
    plain = with_position(plain, order, "_row") if order else plain.withColumn("_row", F.monotonically_increasing_id())
    at = F.posexplode(F.array(*(cell_text(F.col(f"`{c}`"), f.dataType) for c, f in zip(names, result.schema.fields)))).alias("col_idx", "cell")
    ident = F.lit(sample_id).cast("long") if not isinstance(sample_id, Column) else sample_id
    return plain.select(ident.alias("sample_id"), F.lit(side).alias("side"), F.col("_row").alias("row_pos"), at)
