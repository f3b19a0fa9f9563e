"""Facts about tables that mislead writers of queries, from the catalog and from counts.

catalog: (db_id, table_name, column_name, ord, decl_type, is_pk, fk_table), one row per column; counts: see counted().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What names and declared types say.
AGE = r"(?i)(^|_)ages?($|_)"
BIRTH = r"(?i)dob|birth"
SNAPSHOT_DATE = r"(?i)^(date|time|timestamp|.*_date|.*_time)$"
ID = r"(?i)(^|_)id$"
OLD_SUFFIXES = ["old", "prev", "last", "_old", "_prev"]
NUMERIC_TYPES = ["INT", "REAL", "NUM", "DOUB", "FLOA", "DEC"]


def is_numeric(decl_type: Column) -> Column:
    upper = F.upper(F.coalesce(decl_type, F.lit("")))
    found = upper.contains(NUMERIC_TYPES[0])
    for t in NUMERIC_TYPES[1:]:
        found = found | upper.contains(t)
    return found


def numeric_columns(catalog: DataFrame) -> DataFrame:
    """The catalog rows of numeric columns that are neither a primary key nor named like an id."""
    return catalog.where(is_numeric(F.col("decl_type")) & ~F.coalesce(F.col("is_pk"), F.lit(False)) & ~F.col("column_name").rlike(ID))


def stock_ages(catalog: DataFrame) -> DataFrame:
    """Numeric columns that hold an age, in tables without a birth date: (db_id, table_name, column_name)."""
    born = catalog.where(F.col("column_name").rlike(BIRTH)).select("db_id", "table_name").distinct()
    return catalog.where(F.col("column_name").rlike(AGE) & is_numeric(F.col("decl_type"))).join(born, ["db_id", "table_name"], "left_anti").select("db_id", "table_name", "column_name", "ord")


def old_new_pairs(catalog: DataFrame) -> DataFrame:
    """Columns whose name is another one's of the table with a suffix for old: (db_id, table_name, column_name, base_column)."""
    suffixed = catalog.select("db_id", "table_name", "column_name", "ord", F.explode(F.array(*map(F.lit, OLD_SUFFIXES))).alias("suffix")).where(F.lower("column_name").endswith(F.col("suffix")))
    base = F.expr("lower(substring(column_name, 1, length(column_name) - length(suffix)))")
    others = catalog.select("db_id", "table_name", F.lower("column_name").alias("base"), F.col("column_name").alias("base_column"))
    return suffixed.withColumn("base", base).join(others, ["db_id", "table_name", "base"]).select("db_id", "table_name", "column_name", "base_column", "ord").distinct()


def snapshot_candidates(catalog: DataFrame) -> DataFrame:
    """Tables that may hold versions of one entity: referenced by no table, with a date column and references to exactly one table.

    Rows (db_id, table_name, date_column, key_columns): the first date column, and the referring columns that are no
    primary key, in order. The counts decide the rest."""
    referenced = catalog.where("fk_table is not null").select("db_id", F.lower("fk_table").alias("low")).distinct()
    tables = catalog.groupBy("db_id", "table_name").agg(
        F.min_by(F.when(F.col("column_name").rlike(SNAPSHOT_DATE), F.col("column_name")), F.when(F.col("column_name").rlike(SNAPSHOT_DATE), F.col("ord"))).alias("date_column"),
        F.count_distinct("fk_table").alias("parents"),
        F.array_sort(F.collect_list(F.when(F.col("fk_table").isNotNull() & ~F.coalesce(F.col("is_pk"), F.lit(False)), F.struct("ord", "column_name")))).alias("keys"),
    )
    free = tables.where("parents = 1 and date_column is not null").withColumn("low", F.lower("table_name")).join(referenced, ["db_id", "low"], "left_anti")
    return free.select("db_id", "table_name", "date_column", F.col("keys.column_name").alias("key_columns"))


def counted(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Rows (table_name, column_name, n_rows, n_keys): one aggregation per table, with exact distinct counts of its keys;
    column_name is null in the row of the table itself."""
    found = None
    for name, df in tables.items():
        wanted = keys.get(name, [])
        one = df.agg(F.count("*").alias("n"), *(F.count_distinct(F.col(f"`{k}`")).alias(f"k{i}") for i, k in enumerate(wanted)))
        rows = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("column_name"), F.col("n").alias("n_keys")), *(F.struct(F.lit(k).alias("column_name"), F.col(f"k{i}").alias("n_keys")) for i, k in enumerate(wanted))))
        one = one.select(F.lit(name).alias("table_name"), F.col("n").alias("n_rows"), rows.alias("of")).select("table_name", "of.column_name", "n_rows", "of.n_keys")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "table_name string, column_name string, n_rows long, n_keys long")


def facts(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (db_id, item, kind, table_name, fact), numbered P1, P2, ... by database in catalog order.

    counts: (db_id, table_name, column_name, n_rows, n_keys). Four facts, and nothing said about what to do: a table is
    empty (then nothing else is said of it), a stored age lacks its date, two columns hold one quantity at two times, a
    table holds several dated rows per key. A fact appears only where the catalog and the counts prove it. A database
    without facts has no rows.
    """
    place = catalog.groupBy("db_id", "table_name").agg(F.min("ord").alias("first_ord"))
    if "table_ord" in catalog.columns:
        place = catalog.groupBy("db_id", "table_name").agg(F.min("table_ord").alias("first_ord"))
    size = counts.where("column_name is null").select("db_id", "table_name", "n_rows")
    filled = catalog.join(size.where("n_rows = 0").select("db_id", "table_name"), ["db_id", "table_name"], "left_anti")
    none = F.lit(0)
    empty = size.where("n_rows = 0").select("db_id", "table_name", F.lit(0).alias("kind_ord"), none.alias("ord"), F.lit("empty").alias("kind"), F.format_string("Table %s has no rows.", "table_name").alias("fact"))
    ages = stock_ages(filled).select("db_id", "table_name", F.lit(1).alias("kind_ord"), "ord", F.lit("stock_age").alias("kind"), F.format_string("%s.%s stores an age, and %s has no column with a birth date: the data do not tell at which date it was true.", "table_name", "column_name", "table_name").alias("fact"))
    pairs = old_new_pairs(filled).select("db_id", "table_name", F.lit(2).alias("kind_ord"), "ord", F.lit("old_new").alias("kind"), F.format_string("%s.%s is an earlier value of the quantity in %s.%s.", "table_name", "column_name", "table_name", "base_column").alias("fact"))
    keyed = snapshot_candidates(filled).select("db_id", "table_name", "date_column", F.posexplode("key_columns").alias("ord", "column_name"))
    dense = keyed.join(counts.where("n_keys > 0 and n_rows >= 2 * n_keys"), ["db_id", "table_name", "column_name"])
    first = dense.withColumn("_r", F.row_number().over(Window.partitionBy("db_id", "table_name").orderBy("ord"))).where("_r = 1")
    snapshots = first.select("db_id", "table_name", F.lit(3).alias("kind_ord"), "ord", F.lit("snapshot").alias("kind"), F.format_string("Table %s has about %s rows for each %s, told apart by %s.", F.col("table_name"), F.call_function("format_number", F.col("n_rows") / F.col("n_keys"), F.lit("0")), F.col("column_name"), F.col("date_column")).alias("fact"))
    found = empty.unionByName(ages).unionByName(pairs).unionByName(snapshots).join(place, ["db_id", "table_name"], "left")
    number = F.row_number().over(Window.partitionBy("db_id").orderBy("first_ord", "table_name", "kind_ord", "ord", "fact"))
    return found.select("db_id", F.concat(F.lit("P"), number).alias("item"), "kind", "table_name", "fact")


def rendered(found: DataFrame, databases: DataFrame, block: bool = False) -> DataFrame:
    """Rows (db_id, text): the numbered facts of each database. Without facts the text says so, or is empty for a block."""
    number = F.substring("item", 2, 9).cast("int")
    lines = found.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("i"), F.concat("item", F.lit(". "), "fact").alias("line")))), lambda x: x["line"]).alias("lines"))
    text = F.array_join("lines", "\n")
    if block:
        text = F.concat(F.lit("\nKnown from the data of this database:\n\n"), text, F.lit("\n"))
    return databases.select("db_id").distinct().join(lines, "db_id", "left").select("db_id", F.coalesce(text, F.lit("" if block else "(no facts known)")).alias("text"))
