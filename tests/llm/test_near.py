import random
import re
from collections import Counter

import pytest

from querylens.llm.near import least_shared, near_groups, radius

SCHEMA = "sample_id long, question string, query string, group_id string, id int"


def brute(rows):
    words = re.compile(r"[a-z0-9_]+|[一-鿿]")
    bags = {}
    for i, a, b, *_ in rows:
        if i is not None:
            bags.setdefault(i, Counter(words.findall(f"{a or ''}\n{b or ''}".lower())))
    top = {i: i for i in bags}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(i for i in bags if bags[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = sum((bags[a] & bags[b]).values())
            if 20 * shared >= 17 * max(bags[a].total(), bags[b].total()):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {(find(i), i) for i in ids if find(i) != i}


def found(spark, rows, **options):
    got = near_groups(spark.createDataFrame(rows, SCHEMA), "sample_id", "question", "query", **options)
    return {(r["group_id"], r["id"]) for r in got.where("group_id != id").collect()}


def variants(seed, n, vocabulary):
    r = random.Random(seed)
    rows, texts = [], [[r.choice(vocabulary) for _ in range(r.randint(3, 40))] for _ in range(12)]
    for i in range(n):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 2)
            t = t or ["x"]
        if r.random() < 0.3:
            r.shuffle(t)
        rows.append((i * 3 + 1, " ".join(t[: len(t) // 2]), "，".join(t[len(t) // 2 :]), "clash", 7))
    return rows


@pytest.mark.parametrize("options", [{}, {"rare": 3, "block": 7, "tile": 4}, {"dense": 0}, {"rare": 0, "dense": 1, "block": 5, "tile": 3}, {"rare": 5, "long": 20}, {"rare": 0, "long": 0, "block": 4}])
def test_against_all_pairs(spark, options):
    rows = variants(1, 120, [f"w{i}" for i in range(60)] + ["表", "the", "The"])
    assert found(spark, rows, **options) == brute(rows)


def test_nulls_copies_and_empty(spark):
    long = " ".join(f"u{i}" for i in range(200_000))
    rows = [
        (5, "a b c", None, None, 1), (2, None, "C, b; A", None, 1), (9, None, None, None, 1), (10, "", "!?", None, 1), (None, "a b c", "", None, 1),
        (20, long, "x", None, 1), (21, long, "y", None, 1), (30, "q q q q", "", None, 1), (31, "q", "", None, 1), (5, "a b c", None, None, 1),
    ]
    assert found(spark, rows) == {(2, 5), (20, 21)}
    assert found(spark, []) == set()


def test_a_third_are_copies(spark):
    rows = [(i, "same words in every row", "SELECT 1", None, 0) for i in range(400)] + variants(2, 60, [f"v{i}" for i in range(500)])
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    assert found(spark, rows, rare=50, block=16, tile=8) == brute(rows)


def test_a_third_are_near_alike(spark):
    r = random.Random(5)
    core = [f"c{i}" for i in range(30)]
    rows = []
    for n in range(300):
        t = list(core)
        for _ in range(r.randint(1, 4)):
            t[r.randrange(30)] = f"x{r.randrange(8)}"
        rows.append((n, " ".join(t), "", None, 0))
    rows += [(1000 + x[0], *x[1:]) for x in variants(3, 80, [f"x{i}" for i in range(8)] + core)]
    for options in ({"rare": 20, "block": 40}, {"rare": 20, "block": 25, "tile": 4, "dense": 2}):
        assert found(spark, rows, **options) == brute(rows)


def test_tiles_against_all_pairs():
    import numpy as np

    from querylens.llm.near import tiles

    r = np.random.default_rng(1)
    cell, n = np.sort(r.integers(0, 9, 200)), r.integers(20, 60, 200).astype(np.int32)
    s1, s2 = (np.where(r.random(200) < 0.5, np.uint64(0xFFFF0000), np.uint64(0x0FFFF0FF)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) for _ in range(2))
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if cell[i] == cell[j] and int(s1[i] ^ s1[j]).bit_count() + int(s2[i] ^ s2[j]).bit_count() <= radius(n[i], n[j])}
    for tile in (2, 5, 16, 64):
        x, y, full = tiles(cell, n, s1, s2, tile)
        assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == want and len(x) == len(want) and not full.any()
    x, y, full = tiles(cell, n, s1, s2, 4, dense=0)
    assert full.sum() == len({cell[i] for i, _ in want}) and not len(x)


def test_radius_never_loses_a_pair():
    import numpy as np

    for a in range(1, 60):
        for b in range(a, 60):
            most = radius(np.array([a]), np.array([b]))[0]
            shared = least_shared(np.array([b]))[0]
            assert (a + b - 2 * shared) == most and (shared > a or most >= 0)
