import json

import pytest

from querylens.functions import labels
from querylens.operators import generate, scores
from querylens.operators.evaluate import evaluate, vote
from querylens.operators.execution import Database, Refused, prepared, run
from querylens.operators.measure import last_declarations
from querylens.operators.vote import winners
from querylens.sources import datasets
from querylens.streaming.running import drain, running_scores, windowed_scores
from test_checks import CATALOG, NAME, SINGER, sheet

SAMPLES = "idx long, db_id string, question string, reasoning_type string, query string"


@pytest.fixture(scope="module")
def database(spark):
    return Database(spark, {"t": spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")})


@pytest.mark.parametrize("sql", ["DROP VIEW t", "INSERT INTO t VALUES (3, 'z')", "WITH c AS (SELECT 1) INSERT INTO t SELECT * FROM c", "CREATE TABLE u (a INT)", "DELETE FROM t", "SET x = 1", "SHOW TABLES", "CACHE TABLE t"])
def test_writes_are_refused(database, sql):
    with pytest.raises(Refused):
        prepared(database, sql)


@pytest.mark.parametrize("sql,want", [("SELECT 7 / 2", 3), ("SELECT -7 / 2", -3), ("SELECT 7 / 2.0", 3.5), ("SELECT a / 2 / 1 FROM t WHERE a = 2", 1), ("SELECT 1 / 0", None), ("SELECT count(*) FROM t WHERE b LIKE 'X'", 1), ("SELECT (SELECT max(a) / 2 FROM t)", 1), ("SELECT substr('abc', 0, 2)", "a"), ("SELECT CAST('12abc' AS INTEGER)", 12), ("SELECT CAST('abc' AS INT)", 0), ("SELECT CAST(' -1.5e1x' AS REAL)", -15.0), ("SELECT CAST(NULL AS INT)", None), ("SELECT CAST(3.7 AS INT)", 3), ("SELECT CAST(b AS INT) FROM t LIMIT 1", 0)])
def test_sqlite_meaning(database, sql, want):
    assert prepared(database, sql).first()[0] == want


def test_deadline(spark, tmp_path):
    big = Database(spark, {"n": spark.createDataFrame([(i,) for i in range(3000)], "id long")})
    out = run(big, "SELECT count(*) FROM n a, n b, n c WHERE a.id + b.id * c.id % 7 = 3", 0, "", str(tmp_path / "x"), False, timeout_s=2)
    assert not out.ok and out.error.startswith("Timeout")


def test_evaluation(spark, database):
    gold = ["SELECT a, b FROM t", "SELECT a FROM t ORDER BY a DESC", "SELECT a FROM t", "SELECT zz FROM t"]
    samples = spark.createDataFrame([(i, "d", "q", None, g) for i, g in enumerate(gold)], SAMPLES)
    perfect = evaluate(spark, samples.where("idx < 3"), samples.where("idx < 3").selectExpr("idx", "query pred_sql"), {"d": database}).collect()
    assert all(r["valid"] and r["match"] and r["similarity"] == 1.0 for r in perfect)
    mixed = spark.createDataFrame([(0, "SELECT 1"), (1, " \n"), (2, "oops"), (3, "SELECT 1")], "idx long, pred_sql string")
    got = {r["index"]: r for r in evaluate(spark, samples, mixed, {"d": database}).collect()}
    assert got[0]["valid"] and not got[0]["match"] and got[0]["pred_shape"] == [1, 1] and got[0]["gold_shape"] == [2, 2]
    assert got[1]["pred_error"] == "empty prediction" and not got[1]["valid"] and got[1]["gold_shape"] is None
    assert not got[2]["valid"] and got[2]["pred_error"] and got[2]["gold_shape"] is None
    assert got[3]["valid"] and got[3]["gold_error"] and not got[3]["match"]
    with pytest.raises(ValueError):
        evaluate(spark, samples, mixed.limit(2), {"d": database})
    with pytest.raises(KeyError):
        evaluate(spark, samples, mixed, {})


def test_votes(spark, database):
    rows = [(1, 0, True, "a"), (1, 1, True, "b"), (1, 2, True, "b"), (2, 0, True, "x"), (2, 1, True, "y"), (3, 0, False, None), (3, 4, None, None), (4, 0, False, "z"), (4, 1, True, None), (5, None, True, "a")]
    got = {r["q"]: (r["winner"], r["votes"], r["n_candidates"]) for r in winners(spark.createDataFrame(rows, "q long, i long, ok boolean, k string"), "q", "i", "ok", "k").collect()}
    assert got == {1: (1, 2, 3), 2: (0, 1, 2), 3: (4, 0, 2), 4: (1, 1, 2)}
    ran = vote(spark, [(1, 0, "d", "SELECT a, b FROM t"), (1, 1, "d", "SELECT b, a FROM t"), (1, 2, "d", "SELECT a * 1.0000000001, b FROM t ORDER BY a DESC"), (2, 0, "d", ""), (2, 1, "d", "oops")], {"d": database})
    assert {r["question"]: (r["winner"], r["votes"]) for r in ran.collect()} == {1: (0, 2), 2: (0, 1)}


def test_scores(spark):
    rows = [("a", "+ C", True, True, 1.0), ("a", "", True, False, 0.5), (None, None, None, None, None), ("b", "- H C", False, False, 0.0)]
    df = spark.createDataFrame(rows, "db_id string, reasoning_type string, valid boolean, match boolean, similarity double")
    s = scores.summary(df).first()
    assert tuple(s) == (4, 2, 1, 0.5, 0.25, 0.375)
    assert tuple(scores.summary(df.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    keys = {(r["level"], r["key"]): r["n"] for r in scores.rollup(df).collect()}
    assert keys == {("all", None): 4, ("db", "a"): 2, ("db", "b"): 1, ("db", None): 1, ("reasoning", "A+C"): 1, ("reasoning", "A+C+H"): 1, ("reasoning", "unknown"): 2}
    hits = spark.createDataFrame([(1, "C6"), (1, "C6"), (2, "C6"), (9, "C6"), (2, None)], "i long, check string")
    verdicts = spark.createDataFrame([(1, True), (2, None)], "i long, match boolean")
    assert [tuple(r) for r in scores.check_precision(hits, verdicts, "i").collect()] == [("C6", 2, 1, 1)]


def test_labels(spark):
    df = spark.createDataFrame([("- + C H",), ("+",), ("C ?",), ("",), (None,), ("+ -",)], "r string")
    got = [r["d"] for r in df.select(labels.describe_reasoning(df.r).alias("d")).collect()]
    assert got == ["subtraction, addition, commonsense, and hypothetical", "addition", "commonsense", "", "", "addition, and subtraction"]


def test_declare_and_repair(spark):
    good = json.dumps({"sql": "SELECT Name FROM singer", "declarations": sheet([NAME])})
    bad = json.dumps({"sql": "SELECT Name, Age FROM singer", "declarations": sheet([NAME])})
    script = [(1, "declare", 0, good), (2, "declare", 0, bad), (2, "declare", 1, f"sure: {good}"), (3, "declare", 0, bad), (3, "declare", 1, "nonsense"), (3, "declare", 2, "{"), (4, "declare", 0, "nothing")]
    ask = generate.scripted(spark.createDataFrame(script, "id long, stage string, turn int, reply string"))
    samples = spark.createDataFrame([(i, "d", "q", []) for i in range(1, 5)], "id long, db_id string, question string, profile_items array<string>")
    final, rounds = generate.declare(samples, spark.createDataFrame(SINGER, CATALOG), ask, generate.VARIANTS["sheet"])
    got = {r["id"]: (r["sql"], r["passed"], r["n_rounds"]) for r in final.collect()}
    assert got == {1: ("SELECT Name FROM singer", True, 1), 2: ("SELECT Name FROM singer", True, 2), 3: ("SELECT Name, Age FROM singer", False, 3), 4: ("", False, 3)}
    assert rounds.count() == 9
    once, _ = generate.declare(samples, spark.createDataFrame(SINGER, CATALOG), ask, generate.VARIANTS["sheet_rules_checks_once"])
    assert all(r["n_rounds"] == 1 for r in once.collect())


def test_plan_and_generate(spark):
    script = [(1, "plan", 0, "steps"), (1, "generate", 0, "```sql\nSELECT 1\n```")]
    ask = generate.scripted(spark.createDataFrame(script, "id long, stage string, turn int, reply string"))
    samples = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r["id"]: (r["plan"], r["sql"]) for r in generate.generate(generate.plans(samples, ask, generate.VARIANTS["plan"]), ask).collect()}
    assert got == {1: ("steps", "SELECT 1"), 2: ("", "")}


def test_generators(spark):
    samples = spark.createDataFrame([(0, "d"), (1, "missing")], "idx long, db_id string")
    got = {r["idx"]: r["pred_sql"] for r in generate.FirstTable({"d": 't"x'}).predict_all(samples).collect()}
    assert got == {0: 'SELECT * FROM "t""x"', 1: ""}
    chat = generate.Chat(lambda messages, **s: f"```sql\nSELECT {s['t']}```", t=1)
    assert generate.Direct(chat, lambda s: []).predict({}) == "SELECT 1" and chat([], t=2) == "```sql\nSELECT 2```"
    with pytest.raises(RuntimeError):
        generate.Chat(None)([])
    assert all(name == v.name for name, v in generate.VARIANTS.items()) and generate.VARIANTS["plan"].plan_temperature == 0.0 and len(generate.MODELS) == 18
    assert generate.variant("sheet_rules").conventions and generate.VARIANTS["direct_large"].settings == {"large": True, "thinking": False}
    with pytest.raises(ValueError):
        generate.variant("sheet_nothing")


def test_files(spark, tmp_path):
    data = [{"db_id": "d", "query": "SELECT 1", "question": "q", "level": 3, "tags": ["x"]}, {"db_id": "e", "query": "q", "question": "问", "reasoning_type": "+", "commonsense_knowledge": None}]
    path = str(tmp_path / "data.json")
    open(path, "w", encoding="utf-8").write(json.dumps(data, ensure_ascii=False, indent=1))
    rows = datasets.load_dataset(spark, path).orderBy("idx").collect()
    assert [(r["idx"], r["db_id"], r["question"], r["reasoning_type"]) for r in rows] == [(0, "d", "q", ""), (1, "e", "问", "+")]
    assert rows[0]["extras"] == {"level": "3", "tags": '["x"]'} and rows[1]["extras"] == {}
    bad = str(tmp_path / "bad.json")
    open(bad, "w").write('[{"db_id": "d", "query": "x"}]')
    with pytest.raises(KeyError):
        datasets.load_dataset(spark, bad)
    preds = str(tmp_path / "p.json")
    open(preds, "w").write('["SELECT 1", {"predicted_sql": ""}]')
    assert [r["pred_sql"] for r in datasets.load_predictions(spark, preds, 2).orderBy("idx").collect()] == ["SELECT 1", ""]
    with pytest.raises(ValueError):
        datasets.load_predictions(spark, preds, 3)
    open(bad, "w").write('["x", 3]')
    with pytest.raises(TypeError):
        datasets.load_predictions(spark, bad)
    df = spark.createDataFrame([("en_dev", "out/model_en_dev.json"), ("en_dev", "x.json")], "a string, p string")
    assert [r["n"] for r in df.select(datasets.report_name(df.a, df.p).alias("n")).collect()] == ["en_dev_model", "en_dev_x"]
    results = spark.createDataFrame([("a", "+ C", True, True, 1.0)], "db_id string, reasoning_type string, valid boolean, match boolean, similarity double")
    at = datasets.write_report(spark, results, scores.rollup(results), datasets.run_meta("d", None, "db", 30.0), str(tmp_path / "r"), "rep")
    report = json.load(open(at, encoding="utf-8"))
    assert report["summary"]["EX"] == 1.0 and report["by_reasoning_type"] == {"A+C": {"n": 1, "VA": 1.0, "EX": 1.0, "SIM": 1.0}} and set(report) == {"meta", "summary", "by_db", "by_reasoning_type", "samples"} and report["samples"][0]["match"] is True
    assert datasets.write_traces(results.limit(0), str(tmp_path / "t.json")) is False and datasets.write_traces(results, str(tmp_path / "t.json")) is True
    (tmp_path / "dbs/one").mkdir(parents=True)
    (tmp_path / "dbs/two").mkdir()
    results.write.parquet(str(tmp_path / "dbs/one/t.parquet"))
    present = datasets.database_folders(spark, str(tmp_path / "dbs"))
    needed = spark.createDataFrame([("one",), ("one",), ("two",), ("three",), (None,)], "db_id string")
    assert {tuple(r) for r in datasets.inventory(needed, present).collect()} == {("one", "ok", 2, 1), ("two", "missing", 1, 0), ("three", "missing", 1, 0)}


def test_last_declarations(spark):
    d = lambda n: {"time_context": {"displaced": True}, "outputs": [{"name": n}]}
    payloads = {
        1: {"candidates": [{"checks": {"rounds": [{"declarations": d("a")}, {"declarations": d("b")}, {"declarations": None}]}}, {"checks": None}]},
        2: {"candidates": [{"checks": {"rounds": [{"declarations": d("a")}]}}, {"checks": {"rounds": [], "declarations": d("c")}}]},
        3: {"candidates": [{"checks": {"rounds": [{"declarations": d("a")}]}}, {"checks": {"passed": False}}]},
        4: {"error": "x"},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in payloads.items()] + [(5, "broken"), (6, None)], "trace_id long, payload string")
    got = {r["record"]: json.loads(r["declarations"])["outputs"][0]["name"] for r in last_declarations(df).collect()}
    assert got == {1: "b", 2: "c"}


def test_streams(spark, tmp_path):
    rows = [("r1", True, True, 1.0, "2024-01-05 00:00:00"), ("r1", True, False, 0.5, "2024-01-06 00:00:00"), ("r2", False, None, None, "2024-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "run_id string, valid boolean, match boolean, similarity double, t string").selectExpr("*", "cast(t as timestamp) evaluated_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r["run_id"]: (r["n"], r["ex"], r["sim"]) for r in drain(spark, running_scores(stream), "scores_t", str(tmp_path / "c1")).collect()}
    assert got == {"r1": (2, 0.5, 0.75), "r2": (1, 0.0, 0.0)}
    assert drain(spark, windowed_scores(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "scores_w", str(tmp_path / "c2")).count() == 2

