import random

from querylens.llm.leaks import edit_distance, leaks

DOCS, ITEMS = "doc_id long, text string, item_id int, id int", "item_id long, passage string, text string"


def make(seed, n_docs=60, n_items=15):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + list("表数据库")
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 12, 20, 30]))), "c") for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        p = r.choice(items)[1].split()
        if r.random() < 0.7:
            lo = r.randint(0, max(0, len(p) - 12))
            part = p[lo : lo + r.randint(8, 16)]
            for _ in range(r.choice([0, 0, 1, 2])):
                k = r.randrange(len(part))
                part[k : k + r.randint(0, 1)] = [r.choice(vocabulary)] if r.random() < 0.6 else []
            words[r.randint(0, len(words)) : 0] = part
        docs.append((d, ", ".join(words).upper(), 1, 2))
    return docs, items


def brute(docs, items, window, edits):
    import re

    words = re.compile(r"[a-z0-9_]+|[一-鿿]")
    out = {}
    for i, passage, _ in items:
        p = words.findall((passage or "").lower())
        for d, text, *_ in docs:
            t = words.findall((text or "").lower())
            for a in range(len(p) - window + 1):
                for b in range(len(t) - window + 1):
                    e = edit_distance(t[b : b + window], p[a : a + window], edits)
                    if e <= edits and e < out.get((i, d), edits + 1):
                        out[i, d] = e
    return out


def found(spark, docs, items, **options):
    return {(r["item_id"], r["doc_id"]): r["edits"] for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()}


def test_exact_windows(spark):
    docs, items = make(1)
    want = brute(docs, items, 12, 0)
    assert want and found(spark, docs, items) == want


def test_recall_with_edits(spark):
    docs, items = make(2)
    for edits in (1, 2):
        want, got = brute(docs, items, 12, edits), found(spark, docs, items, edits=edits)
        assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 5


def test_words_inserted_and_dropped(spark):
    r = random.Random(7)
    items = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(12)), "c") for i in range(60)]
    docs = []
    for i, passage, _ in items:
        p = passage.split()
        at = r.randint(1, 10)
        docs += [(3 * i, " ".join([*p[:at], "new", *p[at:]]), 1, 2), (3 * i + 1, " ".join(p[:at] + p[at + 1 :]), 1, 2), (3 * i + 2, " ".join(["x", *p[:at], "y", *p[at + 1 :], "z"]), 1, 2)]
    got = found(spark, docs, items, edits=1, uneven=True)
    assert set(got.values()) == {1} and set(got) <= {(d // 3, d) for d, *_ in docs} and len(got) >= 0.95 * len(docs)
    docs, items = make(3)
    words = {i: p.lower().split() for i, p, _ in items}
    want = {(i, d) for i, p in words.items() for d, t, *_ in docs for t in [t.lower().split(", ")] for a in range(len(p) - 11) for n in (11, 12, 13) for b in range(len(t) - n + 1) if edit_distance(t[b : b + n], p[a : a + 12], 1) <= 1}
    got = set(found(spark, docs, items, edits=1, uneven=True))
    assert got <= want and len(got) >= 0.95 * len(want) > 5


def test_recall_of_planted_windows():
    """Each kind of edit on 10,000 windows that the plan has not seen; agreement by the walk, then all within the distance."""
    from querylens.llm.leaks import edits_of, measured_recall, plan

    for edits, uneven in ((1, True), (1, False), (2, False), (2, True)):
        steps = plan(12, edits, 0.95, 1, uneven)
        for kinds in edits_of(edits, uneven):
            assert measured_recall(12, kinds, steps, 10_000, seed=99) >= 0.95, (edits, kinds, len(steps))
    assert edits_of(1, False) == [("replace",)] and len(edits_of(2, True)) == 6


def test_blocks_of_items(spark, monkeypatch):
    from querylens.llm import leaks as module

    docs, items = make(4)
    want = found(spark, docs, items)
    monkeypatch.setattr(module, "BLOCK_CHARS", 300)
    assert found(spark, docs, items) == want == brute(docs, items, 12, 0)


def test_odd_rows(spark):
    twelve = "a b c d e f g h i j k l"
    docs = [(1, None, 0, 0), (2, "", 0, 0), (3, twelve.replace(" ", "\n--\n"), 0, 0), (None, twelve, 0, 0), (4, "x " * 300_000 + twelve, 0, 0), (5, twelve[:-2], 0, 0), (3, "z", 0, 0)]
    items = [(1, twelve, "t"), (1, None, "t"), (None, twelve, "t"), (2, "short", "t"), (3, "x a " + twelve, "t")]
    assert found(spark, docs, items) == {(1, 3): 0, (1, 4): 0, (3, 3): 0, (3, 4): 0}
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}
