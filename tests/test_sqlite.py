import json
import sqlite3

import pytest

from querylens.__main__ import main
from querylens.operators import generate
from querylens.operators.profile import numeric_columns
from querylens.sources import datasets, sqlite
from test_checks import NAME, sheet


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("dbs")
    (root / "music").mkdir()
    con = sqlite3.connect(root / "music/music.sqlite")
    con.executescript(
        """CREATE TABLE singer (id INTEGER PRIMARY KEY, Name TEXT, Age INT, mixed, "odd name" REAL);
        INSERT INTO singer VALUES (1, 'Balmoor', 20, 1, 1.5), (2, 'Bob', 30, 'x', 2), (5, NULL, NULL, NULL, NULL);
        CREATE TABLE song (title TEXT, singer_id INT REFERENCES singer(id), raw BLOB); CREATE TABLE keyed (k TEXT PRIMARY KEY) WITHOUT ROWID;
        INSERT INTO song VALUES ('Gentleman', 1, x'00ff'), (CAST(x'61ff' AS TEXT), 2, NULL); INSERT INTO keyed VALUES ('a')"""
    )
    con.commit()
    con.close()
    (root / "empty").mkdir()
    (root / "empty/empty.sqlite").touch()
    return str(root)


def test_tables(spark, folder):
    path = sqlite.find(folder, "music")
    singer = sqlite.read_table(spark, path, "singer", rows=2)
    assert [f.dataType.simpleString() for f in singer.schema.fields] == ["bigint", "string", "bigint", "string", "double"]
    assert [tuple(r) for r in singer.orderBy("id").collect()] == [(1, "Balmoor", 20, "1", 1.5), (2, "Bob", 30, "x", 2.0), (5, None, None, None, None)]
    song = sqlite.read_table(spark, path, "song").orderBy("singer_id").collect()
    assert bytes(song[0]["raw"]) == b"\x00\xff" and song[1]["title"] == "a�"
    assert sqlite.read_table(spark, path, "keyed").count() == 1
    rows = sqlite.catalog(spark, {"music": path})
    assert {(r["table_name"], r["column_name"]) for r in rows.where("fk_table = 'singer'").collect()} == {("song", "singer_id")}
    assert {r["column_name"] for r in numeric_columns(rows).collect()} == {"Age", "odd name"}
    for missing in ("empty", "none"):
        with pytest.raises(FileNotFoundError):
            sqlite.find(folder, missing)


def test_commands(spark, folder, tmp_path, capsys):
    data = [{"db_id": "music", "query": q, "question": "who?", "reasoning_type": "+ C"} for q in ("SELECT Name FROM singer ORDER BY Name", "SELECT max(age) / 3 FROM singer", 'SELECT "odd name" FROM singer WHERE name = "Bob"')]
    path = str(tmp_path / "set.json")
    json.dump(data, open(path, "w"))
    assert main(["evaluate", "--data", path, "--gold-as-pred", "--db-dir", folder, "--out", str(tmp_path / "r")], spark) == 0
    report = json.load(open(tmp_path / "r/set_gold.json"))
    assert report["summary"]["VA"] == report["summary"]["EX"] == report["summary"]["SIM"] == 1.0 and report["summary"]["n"] == 3
    assert main(["generate", "--data", path, "--db-dir", folder, "--out", str(tmp_path / "p"), "--limit", "2"], spark) == 0
    assert {r["predicted_sql"] for r in spark.read.json(str(tmp_path / "p")).collect()} == {'SELECT * FROM "singer"'}
    assert main(["evaluate", "--data", path, "--db-dir", folder, "--pred", str(tmp_path / "p"), "--limit", "2"], spark) == 0
    capsys.readouterr()
    assert main(["prompts", "--data", path, "--db-dir", folder, "--index", "0"], spark) == 0
    assert capsys.readouterr().out.strip().endswith("SELECT")
    assert main(["inventory", "--data", path, "--db-dir", folder], spark) == 0
    json.dump([{**data[0], "db_id": "none"}], open(path, "w"))
    assert main(["inventory", "--data", path, "--db-dir", folder], spark) == 1
    with pytest.raises(FileNotFoundError):
        main(["evaluate", "--data", path, "--gold-as-pred", "--db-dir", folder], spark)
    with pytest.raises(SystemExit):
        main(["evaluate", "--data", path, "--db-dir", folder, "--pred", "x", "--gold-as-pred"], spark)


def test_pipeline_repairs_misspelt_values(spark, folder):
    path = sqlite.find(folder, "music")
    catalog, databases = sqlite.catalog(spark, {"music": path}), {"music": sqlite.load(spark, path)}
    samples = spark.createDataFrame([(1, "music", "who?", [])], "id long, db_id string, question string, profile_items array<string>")
    replies = [json.dumps({"sql": f"SELECT Name FROM singer WHERE name = '{n}'", "declarations": sheet([NAME])}) for n in ("Balmor", "Balmoor")]
    ask = generate.scripted(spark.createDataFrame([(1, "declare", i, r) for i, r in enumerate(replies)], "id long, stage string, turn int, reply string"))
    chosen, _, _ = generate.pipeline(samples, catalog, ask, generate.VARIANTS["sheet"], databases)
    assert [r["pred_sql"] for r in chosen.collect()] == ["SELECT Name FROM singer WHERE name = 'Balmoor'"]


def test_pipeline(spark, folder):
    path = sqlite.find(folder, "music")
    catalog, databases = sqlite.catalog(spark, {"music": path}), {"music": sqlite.load(spark, path)}
    samples = spark.createDataFrame([(1, "music", "who?", []), (2, "music", "what?", [])], "id long, db_id string, question string, profile_items array<string>")
    good = json.dumps({"sql": "SELECT Name FROM singer", "declarations": sheet([NAME])})
    ask = generate.scripted(spark.createDataFrame([(1, "declare", 0, good)], "id long, stage string, turn int, reply string"))
    chosen, _, _ = generate.pipeline(samples, catalog, ask, generate.VARIANTS["sheet"], databases)
    assert {r["id"]: r["pred_sql"] for r in chosen.collect()} == {1: "SELECT Name FROM singer", 2: ""}
    three = generate.Variant("three", use_plan=True, n_plans=3)
    script = [(1, "plan", i, f"plan {i}") for i in range(3)] + [(3, "generate", 0, "SELECT 1"), (4, "generate", 0, "SELECT count(*) FROM song"), (5, "generate", 0, "```SELECT 2```")]
    chosen, candidates, traces = generate.pipeline(samples.where("id = 1"), catalog, generate.scripted(spark.createDataFrame(script, "id long, stage string, turn int, reply string")), three, databases)
    assert [tuple(r) for r in chosen.collect()] == [(1, 1, "SELECT count(*) FROM song")] and candidates.count() == 3
    trace = json.loads(traces.first()["payload"])
    assert trace["plans"] == ["plan 0", "plan 1", "plan 2"] and trace["winner"] == 1 and trace["final_sql"] == "SELECT count(*) FROM song"
    assert [(c["sql"], c["ok"], c["n_rows"], c["checks"]) for c in trace["candidates"]] == [("SELECT 1", True, 1, None), ("SELECT count(*) FROM song", True, 1, None), ("SELECT 2", True, 1, None)]
    shown = generate.preview(samples, generate.VARIANTS["plan_sheet_rules"]).collect()
    assert len(shown) == 8 and any("K11" in r["content"] for r in shown) and not any("K11" in r["content"] for r in shown if r["stage"] == "plan")
    base = {(r["stage"], r["role"]): r["content"] for r in generate.preview(samples, generate.VARIANTS["plan_sheet"]).collect()}
    assert all(r["content"].startswith(base[r["stage"], r["role"]]) or r["role"] == "user" for r in shown)
    chat = generate.Chat(lambda said, **s: "SELECT 1" if said[0]["role"] == "system" else None)
    asked = generate.asked_of(chat, lambda row: generate.messages(row, generate.VARIANTS["direct"]), samples.drop("profile_items"))
    planned = generate.plans(samples, asked, generate.VARIANTS["direct"])
    assert {r["sql"] for r in generate.generate(planned, asked).collect()} == {"SELECT 1"}


def test_a_run_from_files_to_files(spark, folder, tmp_path, capsys):
    data = [{"db_id": "music", "query": "SELECT Name FROM singer", "question": 'who "sings"?'}, {"db_id": "music", "query": "SELECT count(*) FROM song", "question": "what ratio?"}]
    json.dump(data, open(tmp_path / "set.json", "w"))
    good = json.dumps({"sql": "SELECT Name FROM singer", "declarations": sheet([NAME])})
    bad = json.dumps({"sql": "SELECT Name FROM singer WHERE Name = 'Balmor'", "declarations": sheet([NAME])})
    lines = [{"id": 0, "stage": "declare", "turn": 0, "reply": bad}, {"id": 0, "stage": "declare", "turn": 1, "reply": good}, {"id": 1, "stage": "declare", "turn": 0, "reply": good.replace("SELECT Name", "SELECT Age * 0.453592")}]
    (tmp_path / "replies.json").write_text("\n".join(map(json.dumps, lines)))
    base = ["--data", str(tmp_path / "set.json"), "--db-dir", folder]
    out = str(tmp_path / "m_set.json")
    assert main(["generate", *base, "--model", "sheet", "--replies", str(tmp_path / "replies.json"), "--out", out, "--eval", str(tmp_path / "r")], spark) == 0
    assert json.load(open(out)) == ["SELECT Name FROM singer", "SELECT Age * 0.453592 FROM singer"]
    report = json.load(open(tmp_path / "r/set_m.json"))
    assert [s["match"] for s in report["samples"]] == [True, False] and report["summary"]["n"] == 2
    traces = {r["idx"]: json.loads(r["payload"]) for r in datasets.load_traces(spark, str(tmp_path / "m_set.trace.json")).collect()}
    rounds = traces[0]["candidates"][0]["checks"]["rounds"]
    assert len(rounds) == 2 and rounds[0]["issues"] and not rounds[1]["issues"] and rounds[1]["declarations"]["outputs"] and traces[0]["question"] == 'who "sings"?'
    assert traces[0]["candidates"][0]["checks"]["passed"] is True and traces[1]["final_sql"] == "SELECT Age * 0.453592 FROM singer"
    capsys.readouterr()
    run = ["--pred", out, "--trace", str(tmp_path / "m_set.trace.json"), "--results", str(tmp_path / "r/set_m.json")]
    assert main(["measure", *base, *run], spark) == 0
    assert "|C7-const|1        |1     |0      |" in capsys.readouterr().out
    assert main(["preview", *base, "--index", "1"], spark) == 0
    assert "what ratio?" in (shown := capsys.readouterr().out) and "K11" in shown and "singer" in shown
    json.dump(data[:1], open(tmp_path / "set.json", "w"))
    with pytest.raises(ValueError, match="lengths"):
        main(["measure", *base, *run], spark)
    for rows in ([(0, "a\n\"x\""), (1, ""), (2, "问")], []):
        df = spark.createDataFrame(rows, "idx long, pred_sql string")
        for at in ("q.json", "q"):
            datasets.write_predictions(df, str(tmp_path / at))
            assert sorted(tuple(r) for r in datasets.load_predictions(spark, str(tmp_path / at)).select("idx", "pred_sql").collect()) == rows
