import json

from querylens.llm.formats import canonical, collapse, found, records

ROWS = [
    (1, "SELECT a FROM t;", "x", "clash"), (2, "select  A\tfrom `T`", "X​", "clash"), (3, "ＳＥＬＥＣＴ　a from [t] ；", "“x”", None), (4, "select a from t", "x1", None),
    (5, None, None, None), (6, "", " \n", None), (7, "select a. from t", "x", None), (8, "selecta", "fromtx", None), (9, "selectafromt", "x", None), (None, "select a from t", "x", None),
]
SCHEMA = "result_id long, gold_sql string, pred_sql string, h1 string"


def test_copies(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert {tuple(r) for r in found(rows, "result_id", ["gold_sql", "pred_sql"]).collect()} == {(1, 2), (1, 3), (1, 9), (5, 6)}
    groups = {r["first_id"]: r["copies"] for r in collapse(rows, "result_id", ["gold_sql", "pred_sql"])[1].collect()}
    assert groups == {1: 5, 4: 1, 5: 2, 7: 1, 8: 1}
    assert found(rows.limit(0), "result_id", ["gold_sql", "pred_sql"]).count() == 0


def test_records(spark):
    results = spark.createDataFrame(ROWS[:1], SCHEMA)
    payloads = [json.dumps({"pred_sql": "x", "gold_sql": "y"}), '{"gold_sql": "y", "pred', None, "", "[1]", '{"gold_sql": null}', '"text"', '{"gold_sql": "\\u0061"}']
    lines = spark.createDataFrame([(10 + i, p, "c") for i, p in enumerate(payloads)], "result_id long, payload string, gold_sql string")
    got = {r["result_id"]: (r["gold_sql"], r["pred_sql"]) for r in records(results, lines).collect()}
    assert got == {1: ("SELECT a FROM t;", "x"), 10: ("y", "x"), 15: (None, None), 17: ("a", None)}


def test_hot_group(spark):
    rows = spark.range(30_000).selectExpr("id result_id", "if(id % 3 = 0, 'SELECT 1', concat('q', id)) gold_sql", "'' pred_sql")
    got = found(rows, "result_id", ["gold_sql", "pred_sql"])
    assert got.count() == 9_999 and got.where("first_id = 0").count() == 9_999


def test_long_text(spark):
    rows = spark.createDataFrame([(1, "a " * 500_000, ""), (2, "A" * 500_000, None)], "result_id long, gold_sql string, pred_sql string")
    assert [tuple(r) for r in found(rows, "result_id", ["gold_sql", "pred_sql"]).collect()] == [(1, 2)]
    assert rows.select(canonical(rows.gold_sql).alias("c")).distinct().count() == 1
