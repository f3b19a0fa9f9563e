import pytest

from querylens.llm.mixing import count_tokens, mix, source_key

DOCS, TARGETS = "doc_id long, text string, source string, copies int", "source string, target_share double, max_repeats int"


def documents(spark):
    rows = [(i, f"word{i % 97} " * (1 + i % 40), ["a", "A ", "b-x", "B_X", "c", None, "other"][i % 7], 5) for i in range(3000)]
    return spark.createDataFrame([*rows, (9001, None, "a", 1), (9002, "", "a", 1), (None, "text", "a", 1)], DOCS)


def test_shares_are_met(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b_x", 0.3, 3), ("c", 0.15, 4), ("none", 0.05, 4), (None, 0.1, 1)], TARGETS)
    chosen, shares = mix(documents(spark), targets)
    got = {r["source"]: r for r in shares.collect()}
    for s, want in (("a", 0.5 / 0.95), ("b_x", 0.3 / 0.95), ("c", 0.15 / 0.95)):
        assert got[s]["actual_share"] == pytest.approx(want, abs=0.002)
        assert got[s]["most_copies"] <= got[s]["max_repeats"]
    assert got["none"]["chosen_tokens"] == 0
    rows = chosen.collect()
    assert {(r["doc_id"], r["copies"]) for r in mix(documents(spark), targets)[0].collect()} == {(r["doc_id"], r["copies"]) for r in rows}
    assert sum(r["tokens"] * r["copies"] for r in rows) == sum(r["chosen_tokens"] for r in got.values())


def test_sample_is_the_lowest_ranks(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("c", 0.5, 1)], TARGETS)
    chosen, _ = mix(documents(spark), targets, total=4000, seed=3, power=0)
    tokens = count_tokens(documents(spark)).where("tokens > 0 and doc_id is not null")
    picked = {r["doc_id"] for r in chosen.collect()}
    for s in "ac":
        ranked = tokens.where(f"source = '{s}'").selectExpr("doc_id", "tokens", f"pmod(xxhash64(3, doc_id), {1 << 52}L) as u").orderBy("u").collect()
        so_far, want = 0, set()
        for r in ranked:
            if so_far + r["tokens"] / 2 <= 2000:
                want.add(r["doc_id"])
            so_far += r["tokens"]
        assert {r["doc_id"] for r in ranked} & picked == want


def test_chances_of_inclusion(spark):
    """Over 300 seeds each document is in about as often as its chance says, and the largest are certain."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from querylens.llm.mixing import factors, pareto_rank

    tokens = {i: (1 + i % 10) ** 2 * 10 for i in range(120)} | {120: 200_000, 121: 150_000}
    aim = 380_000.0
    weights = {i: t**0.5 for i, t in tokens.items()}
    import math

    cells = {}
    for i, t in tokens.items():
        c = cells.setdefault(math.floor(math.log2(weights[i]) * 16), [0, 0.0])
        c[0], c[1] = c[0] + t, c[1] + t * weights[i]
    f = factors([("s", c, t, wt) for c, (t, wt) in cells.items()], {"s": aim})["s"]
    p = {i: min(1.0, f * w) for i, w in weights.items()}
    assert p[120] == p[121] == 1.0 and sum(p[i] * t for i, t in tokens.items()) == pytest.approx(aim, rel=0.02)
    df = spark.createDataFrame([(i, t, p[i]) for i, t in tokens.items()], "doc_id long, tokens long, p double").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(300))))
    so_far = F.sum("tokens").over(Window.partitionBy("seed").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2
    got = df.withColumn("z", pareto_rank(F.col("seed"), F.col("doc_id"), F.col("p"))).withColumn("in", so_far <= aim).groupBy("doc_id").agg(F.avg(F.col("in").cast("double")).alias("r")).collect()
    rate = {r["doc_id"]: r["r"] for r in got}
    assert rate[120] == rate[121] == 1.0
    for size in range(10):
        of = [i for i in range(120) if i % 10 == size]
        assert sum(rate[i] for i in of) / len(of) == pytest.approx(p[of[0]], abs=0.04)


def test_long_documents_are_likelier(spark):
    docs = documents(spark).where("doc_id is not null")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mean = lambda power: mix(docs, targets, total=5000, power=power)[0].selectExpr("avg(tokens) a").first()["a"]
    assert mean(1.0) > mean(0.5) > mean(0.0)


def test_weights_and_empty(spark):
    docs = documents(spark).selectExpr("*", "doc_id % 10 + 1.0D as w")
    chosen, _ = mix(docs.where("doc_id is not null"), spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=3000, weight="w", power=0)
    high = chosen.where("doc_id % 10 >= 5").count()
    assert high > chosen.count() / 2
    none = spark.createDataFrame([], TARGETS)
    assert mix(documents(spark), none)[0].count() == 0 and mix(documents(spark).limit(0), spark.createDataFrame([("a", 1.0, 1)], TARGETS))[1].collect()[0]["chosen_tokens"] == 0
    zero = spark.createDataFrame([("a", 1.0, 0), ("c", 0.0, 3)], TARGETS)
    assert mix(documents(spark), zero)[0].count() == 0


def test_source_spellings(spark):
    df = spark.createDataFrame([(" Query-Forum ",), ("query_forum",), ("QUERY_FORUM",)], "s string")
    assert df.select(source_key(df.s).alias("k")).distinct().count() == 1
