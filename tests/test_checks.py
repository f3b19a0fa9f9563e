import json

import pytest
from pyspark.sql import functions as F

from querylens.functions.sqltext import sql_facts
from querylens.operators.checks import equality_literals, neighbours, validate
from querylens.operators.declarations import read_reply, reply_sheet
from querylens.operators.profile import facts as profile_facts
from querylens.operators.profile import numeric_columns, old_new_pairs, rendered, snapshot_candidates, stock_ages

CATALOG = "db_id string, table_name string, column_name string, ord int, decl_type string, is_pk boolean, fk_table string"
SINGER = [("d", "singer", "Name", 0, "TEXT", False, None), ("d", "singer", "Age", 1, "INT", False, None), ("d", "singer", "Song_Name", 2, "TEXT", False, None), ("d", "singer", "Height", 3, "REAL", False, None), ("d", "singer", "id", 4, "INT", True, None)]


def sheet(outputs, displaced=False, **more):
    return {"time_context": {"displaced": displaced, "reference": None}, "outputs": outputs, **more}


NAME = {"name": "n", "source": "column", "column": "singer.Name"}
AGE = {"name": "age", "source": "derived", "expr": "Age + 1", "anchors": {"singer.age": {"kind": "now"}}}


def issues(spark, sql, declarations, question="q", items=(), catalog=SINGER, **options):
    reply = declarations if isinstance(declarations, str) else json.dumps({"sql": sql, "declarations": declarations})
    df = spark.createDataFrame([(1, "d", question, reply, list(items), "clash")], "id long, db_id string, question string, reply string, profile_items array<string>, name string")
    df = df.withColumn("sheet", reply_sheet("reply")).withColumn("facts", sql_facts(F.lit(sql)))
    found = validate(df, spark.createDataFrame(catalog, CATALOG), **options)
    return [r["issue"] for r in found.orderBy("check", "ord").collect()]


@pytest.mark.parametrize(
    "sql,declared,want",
    [
        ("SELECT Name FROM singer", sheet([NAME]), []), ("SELECT * FROM singer", sheet([NAME]), ["C1.star"]), ("SELECT count(*) FROM singer", sheet([{"name": "c", "source": "derived", "expr": "count(*)"}]), []),
        ("SELECT Name, Age FROM singer", sheet([NAME]), ["C1.count:2:1"]), ("SELECT (Name) FROM singer", sheet([NAME]), ["C1.not_a_column:n"]), ("SELECT Age FROM singer", sheet([AGE]), ["C1.not_derived:age"]),
        ("SELECT Name FROM singer", sheet([NAME], True), ["C2.displaced_without_derived"]), ("SELECT Name FROM singer", sheet([NAME], assumptions=[{"target": "singer.Age", "value": 30}]), ["C2.assumption_ignored:singer.Age:30"]),
        ("SELECT Name FROM singer WHERE 30 = age", sheet([NAME], assumptions=[{"target": "singer.Age", "value": 30}]), ["C2.assumption_as_filter:singer.Age:30"]),
        ("SELECT Name FROM singer", sheet([{**NAME, "column": "stage.Name"}]), ["C3.unknown_table:n:stage"]), ("SELECT Name FROM singer", sheet([{**NAME, "column": "singer.Nam"}]), ["C3.unknown_column:n:singer.Nam"]),
        ("SELECT Name FROM singer", sheet([{**NAME, "column": "Nam"}]), ["C3.unknown_column:n:nam"]), ("SELECT Age + 1 FROM singer", sheet([{**AGE, "expr": "Agee + 1", "anchors": None}]), ["C3.unknown_column:age:agee"]),
        ("SELECT Age + 1 FROM singer", sheet([{**AGE, "expr": "Age +"}]), ["C3.bad_expression:age"]), ("SELECT Age + Height FROM singer", sheet([{**AGE, "expr": "Age + Height"}], True), ["C4.no_anchor:age:height"]),
        ("selec", sheet([NAME]), ["SQL.unparsable"]), ("DROP TABLE singer", sheet([NAME]), []),
    ],
)
def test_rules(spark, sql, declared, want):
    assert issues(spark, sql, declared) == want


def test_considered(spark):
    items = [f"P{i}" for i in range(1, 12)]
    done = [{"item": p, "used": True} for p in items if p not in ("P2", "P10")] + [{"item": "X", "used": False}]
    assert issues(spark, "SELECT Name FROM singer", sheet([NAME], considered=done), items=items) == ["C5a.missing:P10", "C5a.missing:P2"]
    done = [{"item": p, "used": p != "P3", "note": " "} for p in items]
    assert issues(spark, "SELECT Name FROM singer", sheet([NAME], considered=done), items=items) == ["C5a.no_reason:P3"]


def test_extra_rules(spark):
    got = lambda sql, d, q, **o: issues(spark, sql, d, q, **o)
    moved = sheet([AGE], True)
    assert got("SELECT Age + 1 FROM singer", moved, "in 2020", extra=True) == ["C5b.no_now:singer.age"]
    assert got("SELECT Age + 1 FROM singer", moved, "growing 0.4% a year", extra=True) == []
    assert got("SELECT Age + strftime('%Y', 'now') FROM singer", moved, "in 2020", extra=True) == []
    literal = sheet([{**AGE, "anchors": {"age": "the current year"}}], True)
    assert got("SELECT Age + 1 FROM singer", literal, "in 2020", extra=True) == ["C5b.no_now:age"]
    plain = sheet([{**NAME, "column": "Age"}])
    assert got("SELECT Age FROM singer", plain, "What is the rate?", extra=True) == ["C6.no_division:singer:Age:Height"]
    assert got("SELECT Age FROM singer", plain, "What is the average?", extra=True) == []
    assert got("SELECT Age FROM singer", plain, None, extra=True) == []
    derived = lambda e: sheet([{"name": "x", "source": "derived", "expr": e}])
    assert got("SELECT Age * 25.4 + 25.4 + 1.609344 FROM singer", derived("Age"), "q", convention=True) == ["C7.constant:K3:25.4"] * 2
    assert got("SELECT Age / 365.25 FROM singer", derived("Age"), "q", convention=True) == ["C7.constant:K2:365.25"]
    assert got("SELECT Age - Height FROM singer", derived("Age"), "difference between a and b", convention=True) == ["C7.no_abs"]
    assert got("SELECT abs(Age - Height) FROM singer", derived("Age"), "difference between a and b", convention=True) == []
    assert got("SELECT Age FROM singer", plain, "at the time of the show", convention=True) == ["C7.not_displaced"]


@pytest.mark.parametrize(
    "reply,error",
    [
        ("no object", "no_object"), (None, "no_object"), ("} {", "no_object"), ("{bad}", "bad_json"), ("{}", "bad_structure"), ('```json\n{"sql": "SELECT 1", "declarations": %s}\n```' % json.dumps(sheet([NAME])), None),
        (json.dumps({"sql": "", "declarations": sheet([NAME])}), "bad_structure"), (json.dumps({"sql": "x", "declarations": sheet([])}), "bad_structure"), (json.dumps({"sql": "x", "declarations": {"outputs": [NAME]}}), "bad_structure"),
        (json.dumps({"sql": "x", "declarations": sheet([{**AGE, "anchors": {"a": {"kind": "pound"}}}])}), "bad_structure"), (json.dumps({"sql": "x", "declarations": sheet([{**NAME, "column": None}])}), "bad_structure"),
        (json.dumps({"sql": "x", "declarations": sheet([NAME], "true")}), None), (json.dumps({"sql": "x", "declarations": sheet([NAME], assumptions=[{"target": "t", "value": None}])}), "bad_structure"),
    ],
)
def test_replies(reply, error):
    assert read_reply(reply)["error"] == error


def test_numbers_become_text():
    row = read_reply(json.dumps({"sql": "x", "declarations": sheet([{**AGE, "anchors": {"a": "since 2001", "b": {"kind": "now", "ref": None}}}], assumptions=[{"target": "t.c", "where": None, "value": 2001}])}))
    assert row["assumptions"] == [{"target": "t.c", "place": "", "value": "2001"}]
    assert row["outputs"][0]["anchors"] == [{"key": "a", "kind": "literal", "ref": "since 2001"}, {"key": "b", "kind": "now", "ref": ""}]


def test_neighbours(spark):
    values = spark.createDataFrame([("singer", "Name", "Balmoor"), ("singer", "Name", "Bob"), ("singer", "Name", None)], "table_name string, column_name string, value string")
    df = spark.createDataFrame([(1, "d", "SELECT 1 FROM singer WHERE name = 'Balmor'"), (2, "d", "SELECT 1 FROM singer WHERE 'Bob' = Name"), (3, "d", "SELECT 1 FROM singer WHERE Name = 'Zzzz'"), (4, "d", "SELECT 1 FROM singer WHERE Age = 3")], "id long, db_id string, sql string")
    literals = equality_literals(df.withColumn("facts", sql_facts("sql")), spark.createDataFrame(SINGER, CATALOG))
    assert [(r["id"], r["close"]) for r in neighbours(literals, values).collect()] == [(1, ["Balmoor"])]
    assert neighbours(literals, values.limit(0)).count() == 0


def test_misspelt_literals_are_issues_of_c3(spark):
    rows = [(1, "d", "SELECT Name FROM singer WHERE name = 'Balmor'"), (2, "d", "SELECT Name FROM singer WHERE name = 'Bob'"), (3, "e", "SELECT Name FROM singer WHERE name = 'Balmor'"), (4, "d", "SELECT Name FROM singer WHERE age = '20.0' OR name = 'Boby' AND name = 'Balmor'"), (1, "d", "SELECT Name FROM singer")]
    df = spark.createDataFrame([(*r, "q", json.dumps({"sql": r[2], "declarations": sheet([NAME])}), []) for r in rows], "id long, db_id string, sql string, question string, reply string, profile_items array<string>")
    values = spark.createDataFrame([("d", "singer", "Name", "Balmoor", None), ("d", "singer", "Name", "Bobby", None), ("d", "singer", "Name", "Bob", None), ("e", "singer", "Name", "Balmor", None), ("d", "singer", "Age", "20", 20.0)], "db_id string, table_name string, column_name string, value string, number double")
    catalog = spark.createDataFrame(SINGER + [("e", *r[1:]) for r in SINGER], CATALOG)
    found = validate(df.withColumn("sheet", reply_sheet("reply")).withColumn("facts", sql_facts("sql")), catalog, stored=lambda wanted: values.join(wanted, ["db_id", "table_name", "column_name"], "left_semi"))
    balmoor = "C3.unlike_stored:singer.Name:Balmor:Balmoor"
    assert sorted(tuple(r) for r in found.collect()) == [(1, "C3", 0, balmoor), (4, "C3", 0, balmoor), (4, "C3", 1, "C3.unlike_stored:singer.Name:Boby:Bobby,Bob")]


def test_profile(spark):
    rows = [
        ("d", "singer", "Age", 0, "INT", False, None), ("d", "singer", "Average", 1, "INT", False, None), ("d", "singer", "Percentage", 2, "REAL", False, None),
        ("d", "kid", "age", 0, "INT", False, None), ("d", "kid", "birth_day", 1, "TEXT", False, None),
        ("d", "land", "GNP", 0, "REAL", False, None), ("d", "land", "GNPOld", 1, "REAL", False, None),
        ("d", "player", "player_id", 0, "INT", True, None), ("d", "version", "date", 1, "TEXT", False, None), ("d", "version", "id", 0, "INT", True, "player"), ("d", "version", "player_id", 2, "INT", False, "player"),
        ("d", "event", "date", 0, "TEXT", False, None), ("d", "event", "a", 1, "INT", False, "player"), ("d", "event", "b", 2, "INT", False, "land"),
        ("d", "race", "date", 0, "TEXT", False, None), ("d", "race", "c", 1, "INT", False, "player"), ("d", "lap", "race", 0, "INT", False, "Race"), ("d", "void", "age", 0, "INT", False, None),
    ]
    catalog = spark.createDataFrame(rows, CATALOG)
    assert {(r[1], r[2]) for r in stock_ages(catalog).collect()} == {("singer", "Age"), ("void", "age")}
    assert {(r["column_name"], r["base_column"]) for r in old_new_pairs(catalog).collect()} == {("GNPOld", "GNP")}
    assert [(r["table_name"], r["key_columns"]) for r in snapshot_candidates(catalog).collect()] == [("version", ["player_id"])]
    assert "player_id" not in {r["column_name"] for r in numeric_columns(catalog).collect()}
    counts = spark.createDataFrame([("d", "void", None, 0, 0), ("d", "version", None, 90, 90), ("d", "version", "player_id", 90, 20)], "db_id string, table_name string, column_name string, n_rows long, n_keys long")
    found = profile_facts(catalog, counts)
    assert sorted((r["kind"], r["table_name"]) for r in found.collect()) == [("empty", "void"), ("old_new", "land"), ("snapshot", "version"), ("stock_age", "singer")]
    assert {r["item"] for r in found.collect()} == {"P1", "P2", "P3", "P4"}
    none = spark.createDataFrame([("d",), ("e",)], "db_id string")
    text = {r["db_id"]: r["text"] for r in rendered(found, none).collect()}
    assert text["e"] == "(no facts known)" and text["d"].startswith("P1. ") and {r["db_id"]: r["text"] for r in rendered(found, none, block=True).collect()}["e"] == ""
