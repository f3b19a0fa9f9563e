import random

import numpy as np
import pyarrow as pa
import pytest

from querylens.llm import spans
from querylens.llm.spans import chains, passages, shared_spans, shares

DOCS = "doc_id long, text string, doc string, seed int"


def brute(rows, least):
    texts = {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            texts.setdefault(i, []).append(t)
    where = {}
    for i, of in texts.items():
        for t in of:
            for p in range(len(t) - least + 1):
                where.setdefault(t[p : p + least], set()).add(i)
    out = set()
    for i, of in texts.items():
        marks = set()
        for t in of:
            for p in range(len(t) - least + 1):
                if len(where[t[p : p + least]]) > 1:
                    marks.update(range(p, p + least))
        begin = None
        for p in sorted(marks):
            if p - 1 not in marks:
                begin = p
            if p + 1 not in marks:
                out.add((i, begin, p + 1))
    return out


def make(seed, n=40, letters="abcdeé表", least=30):
    r = random.Random(seed)
    pool = ["".join(r.choice(letters) for _ in range(r.randint(10, 150))) for _ in range(8)]
    rows = []
    for i in range(n):
        t = "".join(r.choice(pool)[r.randint(0, 30) :][: r.randint(5, 140)] + r.choice(letters) * r.randint(0, 3) for _ in range(r.randint(0, 5)))
        rows.append((i, t, "x", 1))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "abcdeé表"), (2, "ab"), (3, "a😀")])
def test_against_all_windows(spark, seed, letters):
    rows = make(seed, letters=letters)
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(rows, DOCS), 30, 10).collect()}
    assert got == brute(rows, 30)


def test_odd_rows(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = [(1, base, "x", 1), (2, "zz" + base[100:500] + "yy" + base[450:700], "x", 1), (3, None, "x", 1), (4, "", "x", 1), (None, base, "x", 1), (5, base[:299], "x", 1), (6, base[:300], "x", 1), (7, "q" * 5000, "x", 1), (8, "q" * 400_000, "x", 1), (7, base[:310], "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in shared_spans(df).collect()}
    assert got == {(1, 0, 500), (2, 2, 402), (6, 0, 300), (7, 0, 5000), (8, 0, 400_000)}
    total = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in shares(df.where("doc_id != 7")).collect()}
    assert total[1] == (700, 500) and total[3] == (0, 0) and total[5] == (299, 0)
    assert shared_spans(df.limit(0)).count() == 0


def test_many_copies(spark):
    r = random.Random(6)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(i, base if i % 3 == 0 else base[: 200 + i % 50] + "".join(r.choice("ijklmnop") for _ in range(200)), "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in shared_spans(df, 100, 40).collect()}
    assert got == brute(rows, 100)
    assert passages(df, 100, 40).count() < 3 * len(rows)


def test_passages_are_aligned(spark):
    rows = make(8, n=30, letters="abcdefgh")
    texts = {r[0]: r[1] for r in rows}
    df = spark.createDataFrame(rows, DOCS)
    covered = {}
    for r in passages(df, 30, 10).collect():
        mine, other = texts[r["doc_id"]][r["span_start"] : r["span_end"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        assert r["doc_id"] != r["other_id"] and 30 * r["n_parts"] <= r["exact_chars"] <= min(len(mine), len(other))
        assert mine[:30] == other[:30] and mine[-30:] == other[-30:]
        if r["n_parts"] == 1:
            assert mine == other
        covered.setdefault(r["doc_id"], set()).update(range(r["span_start"], r["span_end"]))
    for d, lo, hi in brute(rows, 30):
        assert set(range(lo, hi)) <= covered[d]


def test_spans_need_no_chains(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(spans, "chains", never)
    table = pa.table({c: pa.array(v, pa.int64()) for c, v in {"doc": [1, 1], "lo": [0, 90], "hi": [10, 95], "other": [2, 2], "other_lo": [5, 200]}.items()})
    got = [b.to_pydict() for b in spans._stretches(30)(iter(table.to_batches()))]
    assert got == [{"doc_id": [1, 1], "span_start": [0, 90], "span_end": [40, 125]}]


def test_chains():
    x, y, n = np.array([0, 100, 220, 50]), np.array([10, 130, 240, 500]), np.array([80, 90, 50, 30])
    c = chains(x, y, n)
    assert c[0] == c[1] == c[2] != c[3]
    r = random.Random(3)
    for _ in range(50):  # the best chain is as good as that of the quadratic recurrence
        m = r.randint(1, 12)
        x, y, n = (np.array([r.randint(lo, hi) for _ in range(m)]) for lo, hi in ((0, 300), (0, 300), (5, 40)))
        got = chains(x, y, n)
        assert (got >= 0).all()
        for k in set(got.tolist()):
            of = sorted(np.flatnonzero(got == k), key=lambda i: x[i])
            assert all(x[a] + n[a] <= x[b] and y[a] + n[a] <= y[b] for a, b in zip(of, of[1:]))
