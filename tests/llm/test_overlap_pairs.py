import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from querylens.llm import overlap
from querylens.llm.near import CELLS, _count, widest
from test_near import brute, variants

REG = "db_id string, derived_from string, topic string"


def pairs(rows, splits, dbs):
    groups = {}
    for g, i in brute(rows):
        groups[i] = g
    root = {"a": "a", "b": "a", "c": "c"}
    out = set()
    for x, *_ in rows:
        for y, *_ in rows:
            if splits.get(x) == "train" and splits.get(y) in ("dev", "test") and groups.get(x, x) == groups.get(y, y) and root.get(dbs[x]) is not None and root.get(dbs[x]) == root.get(dbs[y]):
                out.add((min(x, y), max(x, y)))
    return out


@pytest.mark.parametrize("rounds,small", [(4, False), (1, True)])
def test_pairs_against_brute_force(spark, monkeypatch, rounds, small):
    if small:
        for name, value in {"PIECES": 20, "SUB": 5, "AT_ONCE": 600}.items():
            monkeypatch.setattr(overlap, name, value)
    r = random.Random(3)
    rows = variants(11, 150, [f"w{i}" for i in range(70)] + ["表", "the"])
    splits = {x[0]: r.choice(["train", "train", "train", "dev", "test", None]) for x in rows}
    dbs = {x[0]: r.choice(["a", "b", "c", "lost", None]) for x in rows}
    df = spark.createDataFrame([(i, a, b, splits[i], dbs[i], "s", "clash") for i, a, b, *_ in rows] + [(None, rows[0][1], rows[0][2], "train", "a", "s", "x"), (9999, None, "", "dev", "a", "s", "x")], "sample_id long, question string, query string, split string, db_id string, source string, words string")
    registry = spark.createDataFrame([("a", None, "t"), ("b", "A.sqlite", "t"), ("c", None, "t")], REG)
    got = {(x["first_id"], x["second_id"]) for x in overlap.overlaps(df, registry, rounds).collect()}
    assert got == pairs(rows, splits, dbs) and len(got) > 20
    assert overlap.overlaps(df.limit(0), registry).count() == 0


def test_pieces_lose_no_pair():
    """Of any two records within the radius one piece of either stands unbroken in the other."""
    r = np.random.default_rng(2)
    for _ in range(400):
        n = int(r.integers(1, 60))
        a = np.sort(r.choice(1000, n, replace=False))
        b = set(a.tolist())
        for _ in range(int(r.integers(0, 12))):
            b ^= {int(r.integers(0, 1000))}
        b = sorted(b)
        shared = len(set(a.tolist()) & set(b))
        if 20 * shared < 17 * max(n, len(b)):
            continue
        row, start, end = overlap.pieces(np.array([0]), np.array([n]), r.integers(1, 100, n), r.random(n) * 9 + 0.05)
        assert len(row) == widest(np.array([n]))[0] + 1 and (end > start).all() and (start[1:] == end[:-1]).all() and end[-1] <= n
        runs = {tuple(b[i : i + k]) for k in range(1, 25) for i in range(len(b))}
        assert any(tuple(a[p:q].tolist()) in runs for p, q in zip(start, end))


class Value:
    """What a broadcast has."""

    def __init__(self, value):
        self.value = value


def laid(texts, rare=overlap.RARE):
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "split": texts, "root_db": texts, "_a": texts, "_b": pa.nulls(len(texts), pa.string())})
    (counted,) = _count(iter([batch]))
    count = np.zeros(1 << CELLS, np.int64)
    count[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    (out,) = overlap._lay(Value(count), rare)(iter([batch]))
    return out


def dealt(out, afters=None):
    """The rows of pieces and of places that travel."""
    pats = list(overlap._patterns(afters, out.num_rows)(iter([out])))
    marked = np.zeros((1 << (overlap.HEADS - 6)) + 1, np.uint64)
    for m in overlap._marks(iter(pats)):
        marked[m.column("word").to_numpy()] |= m.column("bits").to_numpy().view(np.uint64)
    return pats, list(overlap._fragments(Value(marked))(iter([out])))


def test_few_pieces_of_rare_words_travel():
    """Of records of rare words one word more than an alike record may lack is searched for, and among as many first words only."""
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(50)]
    pats, frags = dealt(laid(texts))
    least = 40 - 34 + 1
    for parts in (pats, frags):
        assert sum(p.num_rows for p in parts) == 50 * least < 50 * (widest(np.array([40]))[0] + 1)
        assert all(len(x) == 4 for p in parts for x in p.column("letters").to_pylist())


@pytest.mark.parametrize("vocabulary,rare", [(4000, overlap.RARE), (60, 0), (25, 0)])
def test_alike_records_meet(vocabulary, rare):
    """Any two alike records share a piece of either that is dealt at a place of the other, whatever pieces they choose."""
    r = random.Random(vocabulary)
    texts = [[f"v{r.randrange(vocabulary)}" for _ in range(r.randint(1, 50))] for _ in range(60)]
    for t in texts[:60]:
        for _ in range(2):
            u = list(t)
            for _ in range(r.randint(0, len(u) // 7 + 1)):
                k = r.randrange(len(u) + 1)
                u[k : k + r.randint(0, 1)] = [f"v{r.randrange(vocabulary)}"] * r.randint(0, 1)
            texts.append(r.sample(u, len(u)) or ["x"])
    out = laid([" ".join(t) for t in texts], rare)
    flat, _ = overlap._flat(out.column("words"))
    afters = np.bincount(overlap._after(flat), minlength=1 << CELLS)
    pats, frags = dealt(out, Value(afters))
    at, met = {}, set()
    for p in frags:
        for head, i, letters in zip(*(p.column(c).to_pylist() for c in ("head", "id", "letters"))):
            at.setdefault(head, []).append((i, letters))
    for p in pats:
        for head, i, letters in zip(*(p.column(c).to_pylist() for c in ("head", "id", "letters"))):
            met |= {(i, j) for j, text in at.get(head, ()) if text.startswith(letters)}
    kinds = {k for p in pats for k in p.column("kind").to_pylist()}
    assert 0 in kinds and (rare or max(kinds) > 1)
    alike = 0
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if i != j and 20 * (Counter(a) & Counter(b)).total() >= 17 * max(len(a), len(b)):
                alike += 1
                assert (i, j) in met
    assert alike > 60


def test_frequent_words_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "RARE", 0)
    r = random.Random(5)
    rows = variants(12, 120, [f"w{i}" for i in range(40)] + ["表", "the"])
    splits = {x[0]: r.choice(["train", "train", "dev", "test", None]) for x in rows}
    dbs = {x[0]: r.choice(["a", "b", "c", None]) for x in rows}
    df = spark.createDataFrame([(i, a, b, splits[i], dbs[i], "s") for i, a, b, *_ in rows], "sample_id long, question string, query string, split string, db_id string, source string")
    registry = spark.createDataFrame([("a", None, "t"), ("b", "A.sqlite", "t"), ("c", None, "t")], REG)
    got = {(x["first_id"], x["second_id"]) for x in overlap.overlaps(df, registry).collect()}
    assert got == pairs(rows, splits, dbs) and len(got) > 20
