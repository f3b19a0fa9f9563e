from collections import defaultdict

from querylens.llm.families import name_key, roots
from querylens.llm.splits import resolved, split_families
from querylens.llm.graph import boruvka, components

REGISTRY = "db_id string, derived_from string, topic string, key string"


def test_written_names(spark):
    names = {"Ferry_Census-2": "ferrycensus2", " a/b/Ferry census 2.sqlite ": "ferrycensus2", "x\\y.DB": "y", "__": None, None: None, "folder/": "folder", "a.db.db": "adb"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["k"] for r in df.select("n", name_key(df.n).alias("k")).collect()} == names


def test_roots(spark):
    rows = [("a", None, "t", "k"), ("b", "A.sqlite", None, "k"), ("c", "db/b", None, "k"), ("d", "D", None, "k"), ("e", "lost", None, "k"), ("x1", "y1", None, "k"), ("y1", "x1", None, "k"), (None, "a", None, "k"), ("B_", "e", None, "k")]
    got, forest = roots(spark.createDataFrame(rows, REGISTRY))
    assert {r["db_id"]: r["root_db"] for r in got.collect()} == {"a": "a", "B_": "e", "c": "e", "d": "d", "e": "e", "x1": "x1", "y1": "x1"}
    assert forest.count() == 3
    empty, none = roots(spark.createDataFrame([], REGISTRY))
    assert empty.count() == none.count() == 0


def test_splits(spark):
    registry = spark.createDataFrame([(f"db{i}", None if i % 3 else f"db{i + 1}", None, None) for i in range(60)], REGISTRY)
    rows = [(n, f"DB {n % 60 if n % 3 else 0}", "x", "y") for n in range(3000)] + [(None, None, "x", "y")] + [(5000 + n, None, "x", "y") for n in range(400)] + [(6000, "unknown", "x", "y"), (6001, "UNKNOWN", "x", "y")]
    df = spark.createDataFrame(rows, "sample_id long, db_id string, family string, split string")
    got = split_families(df, registry, "sample_id", "db_id").collect()
    assert len(got) == len(rows)
    splits, sizes = defaultdict(set), defaultdict(int)
    for r in got:
        splits[r["family"]].add(r["split"])
        sizes[r["split"]] += 1
    assert all(len(s) == 1 for s in splits.values())
    assert abs(sizes["train"] / len(rows) - 0.8) < 0.02 and abs(sizes["validation"] / len(rows) - 0.1) < 0.02
    assert splits["n:unknown"] and resolved(df, registry, "sample_id", "db_id").count() == len(rows)
    assert split_families(df.limit(0), registry, "sample_id", "db_id").count() == 0


def test_shares_whatever_the_sizes(spark):
    """No split is off by more than the largest family; every band of many families is spread over all splits."""
    registry = spark.createDataFrame([], REGISTRY)
    for sizes in ([700, 90, 80, 70, 30, 20, 5, 3, 1, 1], [40] * 30, [2**k for k in range(10)], [1] * 500, [900, 1]):
        rows = [(len(sizes) * n + i, f"f{i}", "", "") for i, m in enumerate(sizes) for n in range(m)]
        got = split_families(spark.createDataFrame(rows, "sample_id long, db_id string, family string, split string"), registry, "sample_id", "db_id").groupBy("split").count().collect()
        n = {r["split"]: r["count"] for r in got}
        assert sum(n.values()) == len(rows)
        for split, share in {"train": 0.8, "validation": 0.1, "test": 0.1}.items():
            assert abs(n.get(split, 0) - share * len(rows)) <= max(sizes)


def test_weights_of_edges(spark):
    rows = [("a", "b", "2024-01-01"), ("b", "c", "2024-01-03"), ("c", "a", "2024-02-01"), ("d", "a", None)]
    df = spark.createDataFrame(rows, "db_id string, derived_from string, t string").selectExpr("*", "cast(t as timestamp) registered_at")
    forest = {(r["a"], r["b"], r["weight"]) for r in roots(df)[1].collect()}
    assert forest == {("a", "b", 2.0), ("b", "c", 29.0), ("a", "d", 0.0)}


def test_forest_and_components(spark):
    links = [(i, i + 1, float(i % 5)) for i in range(0, 40)] + [(i, i + 7, 9.0) for i in range(0, 30)] + [(100, 101, 1.0), (101, 100, 0.5), (7, 7, 1.0), (None, 3, 1.0)]
    df = spark.createDataFrame(links, "a long, b long, w double")
    forest, labels = boruvka(df, weight="w")
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert {r["node"]: r["component"] for r in labels.collect()} == want
    assert {r["node"]: r["component"] for r in components(df).collect()} == want
    # Kruskal
    top, total = {}, 0.0

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b, w in sorted((x for x in links if x[0] is not None and x[0] != x[1]), key=lambda x: x[2]):
        if find(a) != find(b):
            top[find(a)] = find(b)
            total += w
    got = forest.collect()
    assert len(got) == len(want) - 2 and sum(r["weight"] for r in got) == total
    assert components(df.limit(0)).count() == boruvka(df.limit(0))[1].count() == 0
