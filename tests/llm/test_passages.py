import random

import pytest

from querylens.llm import passages as module
from querylens.llm.passages import all_passages, distance
from test_spans import brute, make

DOCS = "doc_id long, text string, doc string, seed int"


def letters(r, n):
    return "".join(r.choice("abcdefghijklmnop ") for _ in range(n))


def test_pairs_that_a_third_document_stood_between(spark):
    r = random.Random(1)
    s1, s2 = letters(r, 400), letters(r, 400)
    rows = [(1, letters(r, 50) + s1, "x", 1), (2, s1 + letters(r, 40) + s2, "x", 1), (3, letters(r, 30) + s1 + letters(r, 45) + s2, "x", 1), (4, s1 + letters(r, 40), "x", 1)]
    rows.append((5, rows[1][1], "x", 1))
    got = {(p["doc_id"], p["other_id"]): p for p in all_passages(spark.createDataFrame(rows, DOCS), 100, 40).collect()}
    assert set(got) == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a != b} | {(2, 5), (5, 2)}
    p = got[2, 3]
    assert (p["span_start"], p["span_end"], p["other_start"], p["other_end"], p["n_parts"]) == (0, 840, 30, 875, 2)
    assert p["edits"] == distance(rows[1][1], rows[2][1][30:]) and got[5, 2]["exact_chars"] == 840


def test_edits_closer_than_the_window(spark):
    r = random.Random(2)
    base = letters(r, 2000)
    changed = "".join("#" if i % 170 == 100 else c for i, c in enumerate(base))
    rows = [(1, base, "x", 1), (2, "zz" + changed, "x", 1)]
    p = max(all_passages(spark.createDataFrame(rows, DOCS), 300, 40).where("doc_id = 1").collect(), key=lambda p: p["exact_chars"])
    assert p["edits"] > 5 and p["span_end"] - p["span_start"] > 1500 and p["exact_chars"] + p["edits"] == p["span_end"] - p["span_start"]


@pytest.mark.parametrize("tile,chars,letters", [(1000, 1_000_000, "abcdefgh"), (3, 500, "abcdefgh"), (2, 500, "ab")])
def test_every_pair_is_covered(spark, monkeypatch, tile, chars, letters):
    monkeypatch.setattr(module, "TILE", tile)
    monkeypatch.setattr(module, "BUCKET_CHARS", chars)
    rows = make(8, n=25, letters=letters)
    texts = {i: t for i, t, *_ in rows}
    first = {t: i for i, t in sorted(texts.items(), reverse=True)}
    got = all_passages(spark.createDataFrame(rows + rows[:3], DOCS), 30, 10).collect()
    assert len({tuple(r) for r in got}) == len(got)
    covered = {}
    for p in got:
        mine, other = texts[p["doc_id"]][p["span_start"] : p["span_end"]], texts[p["other_id"]][p["other_start"] : p["other_end"]]
        assert distance(mine, other) <= p["edits"] < p["exact_chars"] <= min(len(mine), len(other)) and min(len(mine), len(other)) >= 30
        covered.setdefault((p["doc_id"], p["other_id"]), set()).update(range(p["span_start"], p["span_end"]))
    for i in texts:
        for j in texts:
            if i != j and first[texts[i]] == i and first[texts[j]] == j:
                for d, lo, hi in brute([(i, texts[i]), (j, texts[j])], 30):
                    if d == i:
                        assert set(range(lo, hi)) <= covered[i, j]
    assert all_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_distance():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert distance(a, b) == row[-1]
