"""Queries over catalogs: profiles of tables, schemas, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.prompts import question_prompt, schema_with_rows
from querylens.operators import checks, profile
from querylens.sources.datasets import schema_map as _schema_map
from querylens.sources.tables import table

#: Keys of the order tables, which files don't hold.
KEYS = {"orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "customer": ["c_nationkey"], "supplier": ["s_nationkey"], "nation": ["n_regionkey"]}
#: Orders and customers as a snapshot table and its entity, a stored age and two versions of a balance.
CATALOG = [
    ("shop", "person", "person_id", 0, "INTEGER", True, None), ("shop", "person", "age", 1, "INT", False, None),
    ("shop", "person", "balance", 2, "REAL", False, None), ("shop", "person", "balance_old", 3, "REAL", False, None),
    ("shop", "purchase", "purchase_id", 0, "INTEGER", True, None), ("shop", "purchase", "person_id", 1, "INTEGER", False, "person"),
    ("shop", "purchase", "order_date", 2, "TEXT", False, None), ("shop", "nothing", "x", 0, "TEXT", False, None),
]
CATALOG_SCHEMA = "db_id string, table_name string, column_name string, ord int, decl_type string, is_pk boolean, fk_table string"


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "schema_columns")


def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.counted(spark, {t: table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}, KEYS)


def profile_numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_columns(_columns(spark, d)).select("db_id", "table_name", "column_name")


def profile_stock_age(spark: SparkSession, d: str) -> DataFrame:
    """Over the catalog, with a stored age added to every third table, as the catalog itself has none."""
    more = _columns(spark, d).where("ord = 0").select("db_id", "table_name", F.when(F.length("table_name") % 3 == 0, "player_age").otherwise("Average").alias("column_name"), F.lit(99).alias("ord"), F.lit("INTEGER").alias("decl_type"), F.lit(False).alias("is_pk"), F.lit(None).cast("string").alias("fk_table"))
    return profile.stock_ages(_columns(spark, d).unionByName(more)).select("db_id", "table_name", "column_name")


def profile_old_new(spark: SparkSession, d: str) -> DataFrame:
    return profile.old_new_pairs(_columns(spark, d)).select("db_id", "table_name", "column_name", "base_column")


def profile_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return profile.snapshot_candidates(_columns(spark, d)).select("db_id", "table_name", "date_column", F.array_join("key_columns", ",").alias("key_columns"))


def profile_facts(spark: SparkSession, d: str) -> DataFrame:
    """All four facts on customers and orders under other names."""
    catalog = spark.createDataFrame(CATALOG, CATALOG_SCHEMA)
    person = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"))
    purchase = table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"))
    counts = profile.counted(spark, {"person": person, "purchase": purchase, "nothing": person.where("false")}, {"purchase": ["person_id"]}).withColumn("db_id", F.lit("shop"))
    return profile.facts(catalog, counts)


def schema_map(spark: SparkSession, d: str) -> DataFrame:
    return _schema_map(_columns(spark, d)).withColumn("columns", F.array_join("columns", ","))


def schema_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return schema_with_rows(table(spark, d, "nation"), "nation", ["n_nationkey"]).unionByName(schema_with_rows(table(spark, d, "region"), "region", ["r_regionkey"]))


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    return s.select("sample_id", question_prompt(F.lit("CREATE TABLE t (x INT)"), F.col("question"), F.col("commonsense_knowledge")).alias("prompt"))


def literal_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt nation names and what the table has instead."""
    values = table(spark, d, "nation").select(F.lit("nation").alias("table_name"), F.lit("n_name").alias("column_name"), F.col("n_name").alias("value"))
    typos = spark.createDataFrame([(1, "NATION_1"), (2, "NATON_7"), (3, "nothing alike"), (4, "NATION 12"), (5, None)], "id long, value string").withColumn("table_name", F.lit("nation")).withColumn("column_name", F.lit("n_name"))
    return checks.neighbours(typos, values).withColumn("close", F.array_join("close", ","))


QUERIES = {f.__name__: f for f in (profile_counts, profile_numeric_columns, profile_stock_age, profile_old_new, profile_snapshot, profile_facts, schema_map, schema_sample_rows, prompt_render, literal_neighbours)}


def _counts() -> str:
    parts = []
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        parts.append(f"SELECT '{t}' AS table_name, NULL AS column_name, count(*) AS n_rows, count(*) AS n_keys FROM {t}")
        parts += [f"SELECT '{t}', '{k}', count(*), count(DISTINCT {k}) FROM {t}" for k in KEYS.get(t, [])]
    return " UNION ALL ".join(parts)


_NUMERIC = "regexp_matches(upper(coalesce(decl_type, '')), 'INT|REAL|NUM|DOUB|FLOA|DEC')"
_DATED = "regexp_matches(column_name, '(?i)^(date|time|timestamp|.*_date|.*_time)$')"
ORACLE = {
    "profile_counts": _counts(),
    "profile_numeric_columns": f"SELECT db_id, table_name, column_name FROM schema_columns WHERE {_NUMERIC} AND NOT coalesce(is_pk, false) AND NOT regexp_matches(column_name, '(?i)(^|_)id$')",
    "profile_stock_age": f"""WITH c AS (SELECT db_id, table_name, column_name, decl_type FROM schema_columns UNION ALL SELECT db_id, table_name, CASE WHEN length(table_name) % 3 = 0 THEN 'player_age' ELSE 'Average' END, 'INTEGER' FROM schema_columns WHERE ord = 0)
      SELECT db_id, table_name, column_name FROM c WHERE regexp_matches(column_name, '(?i)(^|_)ages?($|_)') AND {_NUMERIC} AND NOT EXISTS (SELECT 1 FROM c b WHERE b.db_id = c.db_id AND b.table_name = c.table_name AND regexp_matches(b.column_name, '(?i)dob|birth'))""",
    "literal_neighbours": "SELECT * FROM (VALUES (2::BIGINT, 'nation', 'n_name', 'NATON_7', 'NATION_7,NATION_17,NATION_9'), (4, 'nation', 'n_name', 'NATION 12', 'NATION_12,NATION_2,NATION_1')) v(id, table_name, column_name, value, close)",
    "profile_old_new": "SELECT DISTINCT a.db_id, a.table_name, a.column_name, b.column_name AS base_column FROM schema_columns a JOIN schema_columns b USING (db_id, table_name), (VALUES ('old'), ('prev'), ('last'), ('_old'), ('_prev')) s(x) WHERE lower(a.column_name) = lower(b.column_name) || x",
    "profile_snapshot": f"""WITH t AS (SELECT db_id, table_name, arg_min(column_name, ord) FILTER (WHERE {_DATED}) AS date_column, count(DISTINCT fk_table) AS parents, coalesce(string_agg(column_name, ',' ORDER BY ord) FILTER (WHERE fk_table IS NOT NULL AND NOT coalesce(is_pk, false)), '') AS key_columns FROM schema_columns GROUP BY 1, 2)
      SELECT db_id, table_name, date_column, key_columns FROM t WHERE parents = 1 AND date_column IS NOT NULL AND NOT EXISTS (SELECT 1 FROM schema_columns f WHERE f.db_id = t.db_id AND lower(f.fk_table) = lower(t.table_name))""",
    "profile_facts": """SELECT * FROM (VALUES ('shop', 'P1', 'empty', 'nothing', 'Table nothing has no rows.'),
      ('shop', 'P2', 'stock_age', 'person', 'person.age stores an age, and person has no column with a birth date: the data do not tell at which date it was true.'),
      ('shop', 'P3', 'old_new', 'person', 'person.balance_old is an earlier value of the quantity in person.balance.'),
      ('shop', 'P4', 'snapshot', 'purchase', 'Table purchase has about ' || (SELECT round_even(count(*) / count(DISTINCT o_custkey), 0)::BIGINT FROM orders) || ' rows for each person_id, told apart by order_date.')) v(db_id, item, kind, table_name, fact)""",
    "schema_map": "SELECT db_id, lower(table_name) AS table_name, string_agg(DISTINCT lower(column_name), ',' ORDER BY lower(column_name)) AS columns FROM schema_columns GROUP BY 1, 2",
    "schema_sample_rows": r"""SELECT 'nation' AS table_name, 'CREATE TABLE "nation" (' || chr(10) || '  "n_nationkey" INT,' || chr(10) || '  "n_name" STRING,' || chr(10) || '  "n_regionkey" INT' || chr(10) || ')' || chr(10) || '/*' || chr(10) || concat_ws(chr(9), 'n_nationkey', 'n_name', 'n_regionkey') || chr(10) || (SELECT string_agg(concat_ws(chr(9), n_nationkey, n_name, n_regionkey), chr(10) ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3)) || chr(10) || '*/' AS text
      UNION ALL SELECT 'region', 'CREATE TABLE "region" (' || chr(10) || '  "r_regionkey" INT,' || chr(10) || '  "r_name" STRING' || chr(10) || ')' || chr(10) || '/*' || chr(10) || concat_ws(chr(9), 'r_regionkey', 'r_name') || chr(10) || (SELECT string_agg(concat_ws(chr(9), r_regionkey, r_name), chr(10) ORDER BY r_regionkey) FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)) || chr(10) || '*/'""",
    "prompt_render": """SELECT sample_id, 'CREATE TABLE t (x INT)' || chr(10) || chr(10) || '-- Answer the question with one SQLite query on the tables above.' || chr(10) || CASE WHEN coalesce(commonsense_knowledge, '') <> '' THEN '-- Known: ' || commonsense_knowledge || chr(10) ELSE '' END || '-- Question: ' || coalesce(question, '') || chr(10) || 'SELECT' AS prompt FROM samples""",
}
