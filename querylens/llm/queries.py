"""The queries of the llm operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm import families, formats, leaks, mixing, near, overlap, passages, spans, splits
from querylens.llm.oracle import ORACLE  # noqa: F401
from querylens.operators.shared import cut, join_counted
from querylens.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = near.near_groups(table(spark, d, "samples"), "sample_id", "question", "query")
    return groups.where("group_id != id").select("group_id", F.col("id").alias("sample_id"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with its group and the group's size; a sample without alike ones is its own group."""
    samples = table(spark, d, "samples")
    groups = cut(near.near_groups(samples, "sample_id", "question", "query"))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("group_size"))
    placed = join_counted(groups, cut(sizes), ["group_id"], "group_size").withColumnRenamed("id", "sample_id")
    return samples.select("sample_id").join(placed, "sample_id", "left").select("sample_id", F.coalesce("group_id", "sample_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.resolved(table(spark, d, "samples"), table(spark, d, "db_registry"), "sample_id", "db_id")
    return rows.where("root_db is not null and written != root_db").select(F.col("id").alias("sample_id"), "root_db")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.split_families(table(spark, d, "samples"), table(spark, d, "db_registry"), "sample_id", "db_id")
    return rows.select(F.col("id").alias("sample_id"), "family", "split")


def p2_families(spark: SparkSession, d: str) -> DataFrame:
    """Every family with its rows and the number of splits that they are in."""
    rows = splits.split_families(table(spark, d, "samples"), table(spark, d, "db_registry"), "sample_id", "db_id")
    return rows.groupBy("family").agg(F.count("*").alias("n_rows"), F.count_distinct("split").alias("n_splits"))


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """All rows, those of the largest family, and how many splits are off their share by more than that."""
    rows = cut(splits.split_families(table(spark, d, "samples"), table(spark, d, "db_registry"), "sample_id", "db_id"))
    largest, n_rows = rows.groupBy("family").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    want = spark.createDataFrame(list(splits.SHARES.items()), "split string, share double").join(F.broadcast(rows.groupBy("split").agg(F.count("*").alias("n"))), "split", "left")
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * n_rows) > largest
    return want.agg(F.lit(n_rows).cast("long").alias("n_rows"), F.lit(largest).cast("long").alias("largest"), F.count_if(off).alias("n_off"))


def p2_forest(spark: SparkSession, d: str) -> DataFrame:
    """The spanning forest of families, by keys of names; an edge weighs the days between the two registrations."""
    return families.roots(table(spark, d, "db_registry"))[1]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return formats.records(table(spark, d, "sample_results"), table(spark, d, "report_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formats.found(_records(spark, d), "result_id", ["gold_sql", "pred_sql"])


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formats.collapse(_records(spark, d), "result_id", ["gold_sql", "pred_sql"])[1].select("first_id", "copies")


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    """Records, different records, and 128-bit hashes that stand for several different texts."""
    groups = cut(formats.collapse(_records(spark, d), "result_id", ["gold_sql", "pred_sql"])[1])
    n = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_records"), F.count("*").alias("n_different"))
    return n.withColumn("n_collisions", F.lit(formats.collisions(groups).count()))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "samples"), table(spark, d, "db_registry")).select("first_id", "second_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "samples"), table(spark, d, "db_registry"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage(table(spark, d, "samples"), table(spark, d, "db_registry"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that hold some of it."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return table(spark, d, "eval_items").select("item_id", "suite", "kind").join(found, "item_id", "left").fillna({"n_docs": 0})


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=1, uneven=True)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Every target source with its documents that have text, the documents chosen more often than max_repeats allows, and whether its
    share of all tokens is off the aim by more than nine of its longest documents, one for each target; sources without documents aim at nothing."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    chosen, shares = mixing.mix(documents, targets)
    wanted = targets.select(mixing.source_key(F.col("source")).alias("source"), "max_repeats", "target_share")
    per = chosen.groupBy("source").agg(F.max("copies").alias("most"), F.max("tokens").alias("longest"))
    over = chosen.join(F.broadcast(wanted), "source").where("copies > max_repeats").groupBy("source").agg(F.count("*").alias("over"))
    have = documents.where("doc_id is not null and text != ''").groupBy(mixing.source_key(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"))
    total, share = F.sum("chosen_tokens").over(Window.partitionBy()), F.sum(F.when(F.col("source_tokens") > 0, F.col("target_share"))).over(Window.partitionBy())
    aims = shares.select("source", "chosen_tokens", "source_tokens", "target_share", total.alias("total"), share.alias("share"))
    aim = F.when(F.col("source_tokens") > 0, F.col("total") * F.col("target_share") / F.col("share")).otherwise(0.0)
    return (
        aims.join(per, "source", "left").join(over, "source", "left").join(have, "source", "left").join(F.broadcast(wanted.select("source", "max_repeats")), "source")
        .select("source", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("over", F.lit(0)).alias("n_over"), (F.abs(F.col("chosen_tokens") - aim) > 9 * F.coalesce("longest", F.lit(0)) + 1).alias("off"))
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return passages.all_passages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_splits, p2_families, p2_balance, p2_forest, p3_found, p3_collapsed, p3_summary, p5_found, p5_report, p5_coverage, p6_found, p6_items, p6_near, p7_mix, p7_shares, p7_limits, p8_found, p8_shares, p8_passages)}
