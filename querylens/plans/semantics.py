"""The rulebook of query semantics on the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.sources.tables import table

#: The day that stands for now, so that results don't depend on when a query runs.
AS_OF = "2026-01-01"


def whole_years(start: Column, end: Column) -> Column:
    """Whole years between two days: a year less before the month and day are reached."""
    return F.year(end) - F.year(start) - (F.date_format(end, "MM-dd") < F.date_format(start, "MM-dd")).cast("int")


def k1_as_of_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy((F.year(F.lit(AS_OF).cast("date")) - F.year("o_orderdate")).alias("years_back")).agg(F.count("*").alias("n"))


def k2_whole_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(whole_years(F.col("o_orderdate"), F.lit(AS_OF).cast("date")).alias("age")).agg(F.count("*").alias("n"))


def k3_unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return rows.select("l_returnflag", F.round(F.col("q") * F.lit(0.45), 3).alias("kilograms"), (F.col("q") * 25).alias("millimetres"), F.round(F.col("q") * F.lit(1.609344), 3).alias("kilometres"))


def k4_abs_difference(spark: SparkSession, d: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum(cents("c_acctbal")).alias("c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum(cents("s_acctbal")).alias("s"))
    return table(spark, d, "nation").select("n_nationkey", "n_name").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.abs(F.coalesce("c", F.lit(0)) - F.coalesce("s", F.lit(0))).alias("difference_cents"))


def k5_truncated_year(spark: SparkSession, d: str) -> DataFrame:
    year = (F.year("o_orderdate") + F.month("o_orderdate") / 12.0).cast("int")
    return table(spark, d, "orders").groupBy(year.alias("year")).agg(F.count("*").alias("n"))


def k6_hypothetical_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """If parts of size 10 cost 5 more: rewritten rows and the untouched rest, nulls included."""
    part = table(spark, d, "part").select("p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    hit = F.col("p_size") == 10
    changed = part.where(hit).withColumn("cents", F.col("cents") + 500)
    rest = part.where(~F.coalesce(hit, F.lit(False)))
    return changed.unionByName(rest).groupBy("p_brand").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))


def k7_history_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("highest"))


def k8_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("part"))
    return rows.select("l_returnflag", F.round(100.0 * F.col("part") / F.col("n"), 4).alias("share"))


def k10_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("cents"), F.lit(0)) / F.count("*") / 100, 4).alias("price_per_customer"))


def k11_wide_superlatives(spark: SparkSession, d: str) -> DataFrame:
    """One row with a column each; ties go to the smaller key."""
    part = table(spark, d, "part")
    low, high = F.struct("p_retailprice", "p_partkey"), F.struct("p_retailprice", -F.col("p_partkey"))
    return part.agg(F.min_by("p_name", low).alias("cheapest"), F.max_by("p_name", high).alias("dearest"), F.max_by("p_name", F.struct("p_size", -F.col("p_partkey"))).alias("largest"), F.min_by("p_name", F.struct("p_size", "p_partkey")).alias("smallest"))


QUERIES = {f.__name__: f for f in (k1_as_of_year, k2_whole_years, k3_unit_conversion, k4_abs_difference, k5_truncated_year, k6_hypothetical_rewrite, k7_history_max, k8_share, k10_ratio_of_sums, k11_wide_superlatives)}
ORACLE = {
    "k1_as_of_year": f"SELECT (year(DATE '{AS_OF}') - year(o_orderdate))::INT AS years_back, count(*) AS n FROM orders GROUP BY 1",
    "k2_whole_years": f"SELECT (year(DATE '{AS_OF}') - year(o_orderdate) - (strftime(DATE '{AS_OF}', '%m-%d') < strftime(o_orderdate, '%m-%d'))::INT)::INT AS age, count(*) AS n FROM orders GROUP BY 1",
    "k3_unit_conversion": "SELECT l_returnflag, round(sum(l_quantity::BIGINT)::DOUBLE * 0.45::DOUBLE, 3) AS kilograms, (sum(l_quantity::BIGINT) * 25)::BIGINT AS millimetres, round(sum(l_quantity::BIGINT)::DOUBLE * 1.609344::DOUBLE, 3) AS kilometres FROM lineitem GROUP BY 1",
    "k4_abs_difference": """SELECT n_name, abs(coalesce((SELECT sum(round(c_acctbal * 100)::BIGINT) FROM customer WHERE c_nationkey = n_nationkey), 0) - coalesce((SELECT sum(round(s_acctbal * 100)::BIGINT) FROM supplier WHERE s_nationkey = n_nationkey), 0))::BIGINT AS difference_cents FROM nation""",
    "k5_truncated_year": "SELECT trunc(year(o_orderdate) + month(o_orderdate) / 12.0)::INT AS year, count(*) AS n FROM orders GROUP BY 1",
    "k6_hypothetical_rewrite": "SELECT p_brand, sum(round(p_retailprice * 100)::BIGINT + CASE WHEN p_size = 10 THEN 500 ELSE 0 END)::BIGINT AS cents, count(*) AS n FROM part GROUP BY 1",
    "k7_history_max": "SELECT o_custkey, max(o_totalprice) AS highest FROM orders GROUP BY 1",
    "k8_share": "SELECT l_returnflag, round(100.0::DOUBLE * count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 4) AS share FROM lineitem GROUP BY 1",
    "k10_ratio_of_sums": """WITH o AS (SELECT o_custkey, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT) AS cents FROM orders GROUP BY 1)
      SELECT c_nationkey, count(*) AS customers, coalesce(sum(n), 0)::BIGINT AS orders, round(coalesce(sum(cents), 0)::DOUBLE / count(*) / 100, 4) AS price_per_customer FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1""",
    "k11_wide_superlatives": """SELECT (SELECT p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 1) AS cheapest, (SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) AS dearest,
      (SELECT p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 1) AS largest, (SELECT p_name FROM part ORDER BY p_size, p_partkey LIMIT 1) AS smallest""",
}
