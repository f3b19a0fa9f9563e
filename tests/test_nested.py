import json
import random

from querylens.operators.nested import TRACE, Invalid, Tokens, repeated_paths, candidates, considered, outputs, rounds, triples

SCHEMA = "trace_id long, payload string, record string, version int"


def keys(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_shapes(spark):
    o = {"name": "n", "source": "column", "column": "c", "extra": {"x": [1]}}
    d = {"outputs": [o, None, {}, "text", json.dumps(o)], "considered": {"item": "P1", "used": True}}
    payloads = [
        {"candidates": [None, {"sql": "q", "checks": {"rounds": [{"declarations": d}, None, {"declarations": json.dumps({"outputs": o})}], "declarations": d}}]},
        {"candidates": {"checks": json.dumps({"rounds": {"declarations": {"outputs": []}}, "declarations": None})}, "unknown": {"candidates": [o]}},
        {"question": "q", "error": "e"}, {"candidates": 5}, {"candidates": [[o], 3]},
    ]
    rows = [(i, json.dumps(p, indent=i % 2), "clash", 3) for i, p in enumerate(payloads)] + [(10, None, "c", 1), (11, "", "c", 1), (12, '{"candidates": [', "c", 1), (13, "[]", "c", 1), (14, '{"candidates": [NaN]}', "c", 1), (15, "[" * 200_000, "c", 1), (None, json.dumps(payloads[0]), "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(1, r, n) for r in (-1, 0) for n in (0, 2, 4)] + [(1, 2, 0)]
    got = keys(outputs(df).where("record is not null"), "record", "candidate_no", "round_no", "output_no")
    assert got == sorted((0, *w) for w in want)
    assert outputs(df).where("record is null").count() == len(want)
    assert keys(candidates(df).where("record is not null"), "record", "candidate_no") == [(0, 1), (1, 0)]
    assert keys(rounds(df).where("record is not null"), "record", "candidate_no", "round_no") == [(0, 1, 0), (0, 1, 2), (1, 0, 0)]
    assert considered(df.where("trace_id = 0")).count() == 2
    one = outputs(df.where("trace_id = 0")).where("round_no = 0 and output_no = 0").first()
    assert (one["name"], one["source"], one["column"], one["expr"]) == ("n", "column", "c", None)
    assert outputs(df.limit(0)).count() == 0


def test_repeated_rows_and_long_texts(spark):
    p = json.dumps({"candidates": [{"sql": "x" * 2_000_000}] * 3})
    q = json.dumps({"candidates": [{"sql": "y"}]})
    df = spark.createDataFrame([(1, p, "", 0), (1, p, "", 0), (1, q, "", 0)], SCHEMA)
    assert keys(candidates(df), "record", "candidate_no") == [(1, 0), (1, 0), (1, 1), (1, 2)]


def test_triples_hold_every_value(spark):
    p = {"question": "q", "plans": ["a", None, "b"], "candidates": [{"n_rows": 3, "checks": {"passed": True}}]}
    got = {(r["path"], tuple(r["ordinals"]), r["leaf"], r["value"]) for r in triples(spark.createDataFrame([(1, json.dumps(p), "", 0)], SCHEMA), "trace_id", "payload", TRACE).collect()}
    assert got == {("", (), "question", "q"), ("plans", (0,), "", "a"), ("plans", (2,), "", "b"), ("candidates", (0,), "", None), ("candidates", (0,), "n_rows", "3"), ("candidates", (0,), "checks.passed", "true")}


def strict(text):
    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except ValueError:
        return False


def test_validity_is_that_of_strict_json():
    r = random.Random(4)
    base = ['{"a": [1, -2.5e+3, {"b": null}], "c": "x\\u00e9\\n\\"", "d": true}', "[[], {}, [[0]], 0.1]", ' {"k": {"k": {"k": []}}} ', '"s"', "12", "[1,2", '{"a" 1}']
    for _ in range(6000):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = r.choice(['"', "{", "}", "[", "]", ",", ":", "0", "1", "-", ".", "e", "\\", " ", "\t", "\x0b", "null", "tru", ""])
        text = "".join(t)
        try:
            tokens = Tokens(text)
            tokens.skip()
            tokens.end()
            valid = True
        except Invalid:
            valid = False
        assert valid == strict(text), text


def test_deep_and_odd_values(spark):
    deep = "[" * 50_000 + "]" * 50_000
    texts = {
        1: '{"unknown": %s, "candidates": [{"sql": "a", "n_rows": %s}]}' % (deep, "9" * 6000),
        2: '{"candidates": [{"sql": "\\ud800x", "n_rows": 1.50, "plan": {"b":[1, 2.0]}}], "candidates": [{"sql": "last"}, {"sql": "\\ud83d\\ude00"}]}',
        3: '{"candidates": [{"sql": "a", "sql": "b", "sql": null, "plan": {"b":[1,2.50]}}]}',
        4: '{"candidates": [{"sql": "a"}]} x', 5: '{"candidates": [{"sql": "a"},]}', 6: '{"candidates": "[{\\"sql\\": \\"in\\"}, "}',
    }
    df = spark.createDataFrame([(i, t, "", 0) for i, t in texts.items()], SCHEMA)
    got = {(r["record"], r["candidate_no"]): (r["sql"], r["n_rows"], r["plan"]) for r in candidates(df).collect()}
    assert got == {(1, 0): ("a", "9" * 6000, None), (2, 0): ("last", None, None), (2, 1): ("\U0001f600", None, None), (3, 0): (None, None, '{"b": [1, 2.50]}')}
    lone = spark.createDataFrame([(1, '{"candidates": [{"sql": "\\ud800x"}]}', "", 0)], SCHEMA)
    assert candidates(lone).first()["sql"] == "\ufffdx"


def test_repeated_paths(spark):
    texts = ['{"a": [1, [2, 3], {"b": []}], "c": {"d": [{"e": [0]}, {"e": [1, 2]}]}}', '[{"x": [1]}]', '{"a": [}', None, "", "3"]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = {r["path"]: (r["n_arrays"], r["n_elements"]) for r in repeated_paths(df, "payload").collect()}
    assert got == {"a": (1, 3), "a[]": (1, 2), "a[].b": (1, 0), "c.d": (1, 2), "c.d[].e": (2, 3), "": (1, 1), "[].x": (1, 1)}
