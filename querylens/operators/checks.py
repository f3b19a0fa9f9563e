"""Rules that hold a query against its declaration sheet, as Column expressions over facts, sheet and catalog.

Input rows: (id, db_id, question, sql, facts, sheet, profile_items) with facts of sqltext, sheet of declarations and the
numbered facts of the database as array<string>. Each rule gives array<string> of issues, in order; validate() joins them
to rows (id, check, ord, issue). Issues are codes with the names concerned.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.labels import CURRENT, DIFFERENCE, DISPLACED, GIVEN_PERCENTAGE, RATIO, says
from querylens.functions.sqltext import expression_columns
from querylens.functions.vectorised import vectorised
from querylens.operators.profile import numeric_columns
from querylens.operators.shared import cut, small

# Conversion constants that the rulebook replaces, and the rule that says so.
OFF_CONSTANTS = {"0.453592": "K3", "2.20462": "K3", "25.4": "K3", "1.60934": "K3", "365.25": "K2"}
#: How many stored values a misspelt one is compared with, how like they must be, and how many are named.
POOL, CUTOFF, BEST = 2000, 0.6, 3

NONE = "cast(array() as array<string>)"
C = F.col


def _when(condition: Column, *issues: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(*issues)).otherwise(F.expr(NONE))


def _all(x: Column) -> Column:
    """An array of issues without nulls."""
    return F.coalesce(F.filter(x, lambda i: i.isNotNull()), F.expr(NONE))


def _issue(code: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(code), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _last(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def c1_alignment() -> Column:
    """Items of the query and declared outputs match one to one, columns with plain columns."""
    kinds, outputs = C("facts.kinds"), C("sheet.outputs")
    pair = F.transform(
        outputs,
        lambda o, i: F.when((o["source"] == "column") & (F.get(kinds, i) == "derived"), _issue("C1.not_a_column", o["name"]))
        .when((o["source"] == "derived") & (F.get(kinds, i) == "column"), _issue("C1.not_derived", o["name"])),
    )
    return (
        F.when(kinds.isNull() | (F.size(kinds) == 0), F.expr(NONE))
        .when(F.array_contains(kinds, "star"), F.array(_issue("C1.star")))
        .when(F.size(kinds) != F.size(outputs), F.array(_issue("C1.count", F.size(kinds).cast("string"), F.size(outputs).cast("string"))))
        .otherwise(_all(pair))
    )


def c2_consistency() -> Column:
    """A displaced time needs a derived output; an assumed value is part of the computation and no filter."""
    lone = _when(C("sheet.displaced") & ~F.exists("sheet.outputs", lambda o: o["source"] == "derived"), _issue("C2.displaced_without_derived"))
    pairs = F.arrays_zip("facts.eq_columns", "facts.eq_values")

    def one(a: Column) -> Column:
        ignored = F.when(~F.array_contains("facts.literals", a["value"]), _issue("C2.assumption_ignored", a["target"], a["value"]))
        as_filter = F.transform(F.filter(pairs, lambda p: (F.lower(p["eq_columns"]) == _last(a["target"])) & (p["eq_values"] == a["value"])), lambda p: _issue("C2.assumption_as_filter", a["target"], a["value"]))
        return F.concat(F.array(ignored), as_filter)

    return F.concat(lone, _all(F.flatten(F.transform("sheet.assumptions", one))))


def _missing(ref: Column, owner: Column) -> Column:
    """Issue if table.column or column isn't in the catalog of the database; null if it is."""
    parts = F.split(ref, r"\.")
    column = F.lower(F.element_at(parts, -1))
    table = F.lower(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "."))
    return (
        F.when(F.size(parts) < 2, F.when(~F.array_contains("all_columns", column), _issue("C3.unknown_column", owner, column)))
        .when(table == "", F.when(~F.array_contains("all_columns", column), _issue("C3.unknown_column", owner, column)))
        .when(~F.array_contains("all_tables", table), _issue("C3.unknown_table", owner, table))
        .when(~F.array_contains("all_qualified", F.concat(table, F.lit("."), column)), _issue("C3.unknown_column", owner, ref))
    )


def c3_grounding() -> Column:
    """Declared tables and columns exist; a derived expression can be parsed. Needs expr_columns, one list per output."""

    def one(o: Column, i: Column) -> Column:
        named = F.get("expr_columns", i)
        strange = F.transform(F.filter(named, lambda c: ~F.array_contains("all_columns", c)), lambda c: _issue("C3.unknown_column", o["name"], c))
        return (
            F.when(o["source"] == "column", F.array(_missing(o["column"], o["name"])))
            .when(named.isNull(), F.array(_issue("C3.bad_expression", o["name"])))
            .otherwise(strange)
        )

    outputs = F.flatten(F.transform("sheet.outputs", one))
    targets = F.transform("sheet.assumptions", lambda a: _missing(a["target"], a["target"]))
    return _all(F.concat(outputs, targets))


def c4_anchors() -> Column:
    """With a displaced time every column of a derived expression has an anchor."""

    def one(o: Column, i: Column) -> Column:
        held = F.transform(o["anchors"], lambda a: _last(a["key"]))
        missing = F.array_except(F.coalesce(F.get("expr_columns", i), F.expr(NONE)), held)
        return F.when((o["source"] == "derived") & (F.size(missing) > 0), _issue("C4.no_anchor", o["name"], F.array_join(F.array_sort(missing), ",")))

    return F.when(C("sheet.displaced"), _all(F.transform("sheet.outputs", one))).otherwise(F.expr(NONE))


def c5a_considered() -> Column:
    """Every known fact is dealt with, and a rejection says why. Missing ones come in the order of their text (P10 before P2)."""
    items = F.coalesce("profile_items", F.expr(NONE))
    missing = F.transform(F.array_sort(F.array_except(items, F.transform("sheet.considered", lambda c: c["item"]))), lambda p: _issue("C5a.missing", p))
    silent = F.transform(F.filter("sheet.considered", lambda c: F.array_contains(items, c["item"]) & ~c["used"] & F.rlike(c["note"], F.lit(r"^\s*$"))), lambda c: _issue("C5a.no_reason", c["item"]))
    return _all(F.concat(missing, silent))


def c5b_anchor_sql() -> Column:
    """Values anchored at present in a question about another time need the present in the query."""
    anchors = F.flatten(F.transform("sheet.outputs", lambda o: o["anchors"]))
    now = F.array_sort(F.array_distinct(F.transform(F.filter(anchors, lambda a: (a["kind"] == "now") | F.rlike(a["ref"], F.lit(CURRENT))), lambda a: a["key"])))
    return _when(C("sheet.displaced") & ~says(C("question"), GIVEN_PERCENTAGE) & (F.size(now) > 0) & ~C("facts.has_now"), _issue("C5b.no_now", F.array_join(now, ",")))


def c6_ratio() -> Column:
    """A ratio is asked for, nothing is divided, and a table has further numbers. Needs numeric: array of (table, columns)."""
    used = C("facts.columns")

    def one(t: Column) -> Column:
        hit = F.filter(t["columns"], lambda c: F.array_contains(used, F.lower(c)))
        rest = F.filter(t["columns"], lambda c: ~F.array_contains(used, F.lower(c)))
        return F.when((F.size(hit) > 0) & (F.size(rest) > 0), _issue("C6.no_division", t["table"], F.array_join(hit, ","), F.array_join(rest, ",")))

    asked = says(C("question"), RATIO) & ~says(C("question"), GIVEN_PERCENTAGE) & ~C("facts.has_div")
    return F.when(asked, _all(F.transform(F.coalesce("numeric", F.expr("cast(array() as array<struct<table:string,columns:array<string>>>)")), one))).otherwise(F.expr(NONE))


def c7_constants() -> Column:
    """Constants that the rulebook replaces, each time one is written."""
    rule = F.create_map(*[F.lit(x) for pair in OFF_CONSTANTS.items() for x in pair])
    off = F.filter("facts.literals", lambda x: F.map_contains_key(rule, x))
    return _all(F.transform(off, lambda x: _issue("C7.constant", rule[x], x)))


def c7_difference() -> Column:
    """A difference is asked for, an item subtracts and nothing is taken as absolute."""
    return _when(says(C("question"), DIFFERENCE) & ~C("facts.has_abs") & C("facts.select_has_sub"), _issue("C7.no_abs"))


def c7_displaced() -> Column:
    """The question moves in time and the sheet says that it doesn't."""
    return _when(~C("sheet.displaced") & says(C("question"), DISPLACED), _issue("C7.not_displaced"))


def with_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows with what the rules need of the catalog, by db_id: names in lower case, and numeric columns by table."""
    low = catalog.groupBy("db_id").agg(
        F.collect_set(F.lower("column_name")).alias("all_columns"), F.collect_set(F.lower("table_name")).alias("all_tables"),
        F.collect_set(F.concat(F.lower("table_name"), F.lit("."), F.lower("column_name"))).alias("all_qualified"),
    )
    numbers = (
        numeric_columns(catalog).groupBy("db_id", F.lower("table_name").alias("table"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "column_name"))), lambda x: x["column_name"]).alias("columns"))
        .groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table", "columns"))).alias("numeric"))
    )
    known = rows.join(small(low, 10_000), "db_id", "left").join(small(numbers, 10_000), "db_id", "left")
    for c in ("all_columns", "all_tables", "all_qualified"):
        known = known.withColumn(c, F.coalesce(c, F.expr(NONE)))
    return known


def _expressions(rows: DataFrame) -> DataFrame:
    """rows with expr_columns: for each output the columns of its expression, or null if that can't be parsed."""
    texts = F.transform("sheet.outputs", lambda o: o["expr"])

    @F.pandas_udf("array<array<string>>")
    def parsed(exprs: pd.Series) -> pd.Series:
        one = expression_columns.func
        return exprs.map(lambda e: None if e is None else list(one(pd.Series(list(e), dtype=object))))

    return rows.withColumn("expr_columns", parsed(texts))


ALWAYS = {"C1": c1_alignment, "C2": c2_consistency, "C3": c3_grounding, "C4": c4_anchors, "C5a": c5a_considered}
EXTRA = {"C5b": c5b_anchor_sql, "C6": c6_ratio}
CONVENTION = {"C7-const": c7_constants, "C7-abs": c7_difference, "C7-dodge": c7_displaced}


#: Gives the stored values of columns, (db_id, table_name, column_name, value, number), for rows (db_id, table_name, column_name).
Stored = Callable[[DataFrame], DataFrame]


def _misspelt(rows: DataFrame, catalog: DataFrame, stored: Stored) -> DataFrame:
    """Rows (_key, misspelt): issues of text literals that their column lacks but has something like."""
    literals = cut(equality_literals(rows.dropDuplicates(["_key"]).withColumn("id", C("_key")), catalog))
    close = neighbours(literals, stored(literals.select("db_id", "table_name", "column_name").distinct()))
    issue = _issue("C3.unlike_stored", F.concat("table_name", F.lit("."), "column_name"), C("value"), F.array_join("close", ","))
    return close.groupBy(C("id").alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "column_name", "value", issue.alias("issue")))), lambda x: x["issue"]).alias("misspelt"))


def validate(rows: DataFrame, catalog: DataFrame, extra: bool = False, convention: bool = False, stored: Stored | None = None) -> DataFrame:
    """Rows (id, check, ord, issue) for all rules that are switched on; a sample without issues has none.

    A query that can't be parsed has the one issue SQL.unparsable and no other. A sheet that can't be read has the one issue
    REPLY with its error. Null questions say nothing; an unknown db_id has an empty catalog. With stored values, C3 ends
    with the literals that are spelt otherwise than their column has them, in order of column and value; without, it says
    nothing of literals.
    """
    rules = ALWAYS | (EXTRA if extra else {}) | (CONVENTION if convention else {})
    ready = _expressions(with_catalog(rows, catalog))
    if stored is not None:
        ready = ready.withColumn("_key", F.md5(F.to_json(F.struct("id", "db_id", "facts.eq_columns", "facts.eq_values", "facts.eq_strings"))))
        ready = ready.join(_misspelt(ready.select("_key", "db_id", "facts"), catalog, stored), "_key", "left")
        rules["C3"] = lambda: F.concat(c3_grounding(), F.coalesce("misspelt", F.expr(NONE)))
    bad = F.when(C("sheet.error").isNotNull(), F.struct(F.lit("REPLY").alias("check"), F.array(_issue("REPLY", C("sheet.error"))).alias("issues"))).when(C("facts.error").isNotNull(), F.struct(F.lit("SQL").alias("check"), F.array(_issue("SQL.unparsable")).alias("issues")))
    found = F.array(*(F.struct(F.lit(name).alias("check"), rule().alias("issues")) for name, rule in rules.items()))
    of = F.explode(F.when(bad.isNotNull(), F.array(bad)).otherwise(found)).alias("of")
    return ready.select("id", of).select("id", "of.check", F.posexplode("of.issues").alias("ord", "issue"))


@vectorised("array<string>")
def close_matches(value: pd.Series, pool: pd.Series) -> pd.Series:
    """The best matches by the ratio of matching blocks, best first."""
    return pd.Series([difflib.get_close_matches(v, [p for p in ps if p is not None], n=BEST, cutoff=CUTOFF) if v is not None and ps is not None else [] for v, ps in zip(value, pool)])


def neighbours(literals: DataFrame, values: DataFrame, pool: int = POOL) -> DataFrame:
    """Rows (id, table_name, column_name, value, close) for text literals that a column lacks but has something like.

    literals: (id, table_name, column_name, value); values: (table_name, column_name, value) with the stored values, and
    db_id in both if they are of several databases. Whether a value exists is decided on all values by an anti-join; only
    the pool for likeness is bounded, to the first values in order. Where values have a number, a literal with that number
    exists, too. Nulls match nothing.
    """
    keys = [*(["db_id"] if "db_id" in values.columns else []), "table_name", "column_name"]
    distinct = values.where("value is not null").select(*keys, F.col("value").cast("string").alias("value")).distinct()
    lacking = literals.where("value is not null").join(distinct, [*keys, "value"], "left_anti")
    if "number" in values.columns:
        lacking = lacking.withColumn("number", F.expr("try_cast(value as double)")).join(values.where("number is not null").select(*keys, "number").distinct(), [*keys, "number"], "left_anti")
    wanted = lacking.select(*keys).distinct()
    from pyspark.sql import Window

    ranked = distinct.join(wanted, keys, "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).where(C("_r") <= pool)
    pools = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("pool"))
    return lacking.join(pools, keys).withColumn("close", close_matches("value", "pool")).where(F.size("close") > 0).select("id", *keys, "value", "close")


def equality_literals(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (id, db_id, table_name, column_name, value) of text literals that a query compares with a column whose name is in exactly
    one table of its database."""
    pairs = rows.select("id", "db_id", F.explode(F.arrays_zip("facts.eq_columns", "facts.eq_values", "facts.eq_strings")).alias("p")).where("p.eq_strings")
    alone = catalog.groupBy("db_id", F.lower("column_name").alias("low")).agg(F.count_distinct(F.lower("table_name")).alias("n"), F.min("table_name").alias("table_name"), F.min("column_name").alias("column_name")).where("n = 1")
    return pairs.withColumn("low", F.lower("p.eq_columns")).join(alone, ["db_id", "low"]).select("id", "db_id", "table_name", "column_name", F.col("p.eq_values").alias("value"))
