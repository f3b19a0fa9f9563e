from querylens.llm.overlap import coverage, overlaps, report

REGISTRY = "db_id string, derived_from string"
SAMPLES = "sample_id long, question string, query string, db_id string, split string, source string, root_db string"


def test_overlaps_and_report(spark):
    registry = spark.createDataFrame([("a", None), ("b", "a"), ("c", None)], REGISTRY)
    text = "one two three four five six seven eight nine ten"
    rows = [
        (1, text, "q", "a", "train", "s", "z"), (2, text, "Q", "B.db", "dev", "s", "z"), (3, text, "q", "c", "test", "s", "z"), (4, text, "q", "a", None, "s", "z"),
        (5, text + " more", "q", "a", "test", None, "z"), (6, text, "q", None, "dev", "s", "z"), (7, "else", None, "a", "dev", "s", "z"), (8, text, "q", "b", "train", "s", "z"), (None, text, "q", "a", "dev", "s", "z"),
    ]
    df = spark.createDataFrame(rows, SAMPLES)
    got = {tuple(r)[:2] for r in overlaps(df, registry).collect()}
    assert got == {(1, 2), (2, 8), (1, 5), (5, 8)}
    counts = {(r["split"], r["source"]): (r["n_rows"], r["n_overlapping"], r["n_pairs"]) for r in report(df, registry).collect()}
    assert counts == {("dev", "s"): (4, 1, 2), ("test", "s"): (1, 0, 0), ("test", None): (1, 1, 2)}
    assert overlaps(df.limit(0), registry).count() == 0
    covered = {r["sample_id"]: (r["n_words"], r["n_covered"]) for r in coverage(df, registry).collect()}
    assert covered == {2: (11, 11), 3: (11, 0), 5: (12, 10), 7: (1, 0)}
    again = {r["sample_id"]: (r["n_words"], r["n_covered"]) for r in coverage(df, registry, shard=3, chunk=1).collect()}
    assert again == covered
    assert coverage(df.where("split = 'dev'"), registry).where("n_covered > 0").count() == 0
    assert coverage(df.limit(0), registry).count() == 0
