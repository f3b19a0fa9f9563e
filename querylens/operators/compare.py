"""Comparison of result sets as multisets: signatures, Jaccard similarity, execution match.

All samples go through one job. A signature says which values a row or a column holds and how often, whatever their
order; the set of (value, count) pairs is hashed to 128 bits by exclusive-or of pair hashes, so a column of any length is
aggregated with map-side combining and never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.labels import python_round

SIDES = ("pred", "gold")


def _hashed(*of: Column) -> list[Column]:
    return [F.bit_xor(F.xxhash64(*of)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(17), *of)).alias("h2")]


def row_signatures(cells: DataFrame) -> DataFrame:
    """Rows (sample_id, side, h1, h2, n): how many rows of a result have a signature."""
    values = F.array_sort(F.collect_list("cell")).alias("values")
    rows = cells.groupBy("sample_id", "side", "row_pos").agg(values).select("sample_id", "side", F.xxhash64("values").alias("h1"), F.xxhash64(F.lit(17), "values").alias("h2"))
    return rows.groupBy("sample_id", "side", "h1", "h2").agg(F.count("*").alias("n"))


def column_signatures(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """The same for columns. Columns of a result without rows have no cells, so they are added from the shape."""
    counted = cells.groupBy("sample_id", "side", "col_idx", "cell").agg(F.count("*").alias("times"))
    columns = counted.groupBy("sample_id", "side", "col_idx").agg(*_hashed(F.col("cell"), F.col("times"))).groupBy("sample_id", "side", "h1", "h2").agg(F.count("*").alias("n"))
    return columns.unionByName(_empty(shape))


def ordered_columns(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """Columns as they are, value by row position: equal only where the order of rows is the same."""
    columns = cells.groupBy("sample_id", "side", "col_idx").agg(*_hashed(F.col("row_pos"), F.col("cell"))).groupBy("sample_id", "side", "h1", "h2").agg(F.count("*").alias("n"))
    return columns.unionByName(_empty(shape))


def _empty(shape: DataFrame) -> DataFrame:
    return shape.where("ok and n_rows = 0 and n_cols > 0").select("sample_id", "side", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.col("n_cols").cast("long").alias("n"))


def jaccard(signatures: DataFrame) -> DataFrame:
    """Rows (sample_id, common, total) of pred and gold signatures: the sizes of intersection and union of the multisets.

    One aggregation brings the sides together, so no outer join is needed."""
    sides = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in SIDES]
    return (
        signatures.groupBy("sample_id", "h1", "h2").agg(*sides)
        .groupBy("sample_id").agg(F.sum(F.least(*SIDES)).alias("common"), F.sum(F.greatest(*SIDES)).alias("total"))
    )


def similarity(common: Column, total: Column) -> Column:
    """Common over total, to four places; 1 if both are empty."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(1.0)).otherwise(python_round(common / total, 4))


def compare(cells: DataFrame, shape: DataFrame, ordered: DataFrame) -> DataFrame:
    """Rows (sample_id, match, sim_row, sim_col, similarity) for every sample in ordered (sample_id, ordered boolean).

    match: both sides ran, shapes are equal, and rows and columns have equal signatures; if the gold query orders its rows,
    the multiset of exact columns decides instead. Similarity is the mean of the row and column Jaccard, never looks at
    order, and is 0 if a side failed or is missing. Equality is decided on whole numbers, not on rounded scores.
    row_pos has to count rows from 0 in order on both sides where ordered holds; elsewhere any distinct numbers do.
    """
    def sized(found: DataFrame, name: str) -> DataFrame:
        return found.select("sample_id", F.col("common").alias(f"{name}_common"), F.col("total").alias(f"{name}_total"))

    rows, columns = sized(jaccard(row_signatures(cells)), "row"), sized(jaccard(column_signatures(cells, shape)), "col")
    wanted = ordered.where("ordered").select("sample_id")
    exact = sized(jaccard(ordered_columns(cells.join(wanted, "sample_id", "left_semi"), shape.join(wanted, "sample_id", "left_semi"))), "exact")
    sides = [F.max(F.when(F.col("side") == s, F.struct("ok", "n_rows", "n_cols"))).alias(s) for s in SIDES]
    shapes = shape.groupBy("sample_id").agg(*sides)
    both = ordered.join(shapes, "sample_id", "left").join(rows, "sample_id", "left").join(columns, "sample_id", "left").join(exact, "sample_id", "left")
    ran = F.coalesce(F.col("pred.ok") & F.col("gold.ok"), F.lit(False))
    same_shape = (F.col("pred.n_rows") == F.col("gold.n_rows")) & (F.col("pred.n_cols") == F.col("gold.n_cols"))

    def same(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_common"), F.lit(0)) == F.coalesce(F.col(f"{name}_total"), F.lit(0))

    alike = F.when(F.coalesce("ordered", F.lit(False)), same("exact")).otherwise(same("row") & same("col"))
    row, col = (F.when(ran, similarity(F.col(f"{x}_common"), F.col(f"{x}_total"))).otherwise(0.0) for x in ("row", "col"))
    return both.select("sample_id", F.coalesce(ran & same_shape & alike, F.lit(False)).alias("match"), row.alias("sim_row"), col.alias("sim_col")).withColumn("similarity", python_round((F.col("sim_row") + F.col("sim_col")) / 2, 4))
