"""Written database names: which registered database is meant, and from which root it was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.llm.graph import boruvka
from querylens.operators.shared import cut


def name_key(name: Column) -> Column:
    """Letters and digits of a written name in lower case; of a path, those of its last part without .sqlite or .db.

    Null and names without letters and digits give null.
    """
    last = F.regexp_extract(F.trim(name), r"([^/\\]*)[/\\]*$", 1)
    plain = F.regexp_replace(F.lower(F.regexp_replace(last, r"(?i)\.(sqlite|db)\s*$", "")), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(plain) > 0, plain)


def roots(registry: DataFrame, into: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, db_id, root_db) for every registered database, and the spanning forest (a, b, weight) of their families.

    An edge leads from a database to the one it was made from and weighs the days between their registrations, where both are
    known: of databases that are made from each other in a circle the longest edge stays out. into names a folder in which
    the forest is kept.

    derived_from is read like a written name. A database whose derived_from is null, itself or unknown is a root. Every
    family has one root, unless its databases are derived from each other in a circle: then the smallest db_id of the
    circle's family is taken. If two db_ids have the same letters and digits, the smaller one is meant by other spellings.
    """
    day = F.unix_date(F.to_date("registered_at")) if "registered_at" in registry.columns else F.lit(None).cast("int")
    nodes = cut(
        registry.where(F.col("db_id").isNotNull()).select(name_key(F.col("db_id")).alias("key"), "db_id", name_key(F.col("derived_from")).alias("from_key"), day.alias("day"))
        .groupBy("key").agg(F.min_by(F.struct("db_id", "from_key", "day"), "db_id").alias("of")).select("key", "of.*").where("key is not null")
    )
    known = nodes.select(F.col("key").alias("from_key"), F.col("day").alias("from_day"))
    weight = F.coalesce(F.abs(F.col("day") - F.col("from_day")), F.lit(0)).cast("double")
    links = nodes.where("from_key != key").join(known, "from_key").select(F.col("key").alias("a"), F.col("from_key").alias("b"), weight.alias("w"))
    forest, labels = boruvka(links, weight="w")
    if into is not None:
        forest.write.mode("overwrite").parquet(into)
    tops = nodes.join(links, nodes.key == links.a, "left_anti").select(F.col("key").alias("top_key"), F.col("db_id").alias("top"))
    family = nodes.join(labels, nodes.key == labels.node, "left").select("key", "db_id", F.coalesce("component", "key").alias("component"))
    root = (
        family.join(tops, family.key == tops.top_key, "left")
        .groupBy("component").agg(F.coalesce(F.min("top"), F.min("db_id")).alias("root_db"))
    )
    return cut(family.join(root, "component").select("key", "db_id", "root_db")), forest
