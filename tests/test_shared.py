import os

from pyspark.sql import functions as F

from querylens.operators.shared import cut, forget, join_counted, shared_dir, small, with_position


def test_positions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), (F.col("id") % 3).alias("w"))
    got = with_position(df, ["v"]).orderBy("v").collect()
    assert [r["position"] for r in got] == list(range(1000))
    summed, so_far = with_position(df, ["v"], "before", F.col("w"), parts=7).orderBy("v").collect(), 0
    for r in summed:
        assert r["before"] == so_far
        so_far += r["w"]
    assert with_position(df.limit(0), ["v"]).count() == 0


def test_counted_join_with_a_hot_key(spark):
    members = cut(spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"))
    groups = cut(members.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    got = join_counted(members, groups, ["k"], "n")
    assert got.count() == 9000 and got.where("k = 0").count() == 3000 and got.where("first > id").count() == 0
    assert join_counted(members.limit(0), groups.limit(0), ["k"], "n").count() == 0


def test_tables_are_written_and_removed(spark):
    t = cut(spark.range(10))
    at = t._querylens_at.removeprefix("file://")
    assert t.count() == 10 and os.path.isdir(at) and t._querylens_at.startswith(shared_dir(spark))
    forget(t)
    assert not os.path.isdir(at)
    forget(t, spark.range(3))


def test_broadcast_only_what_is_small(spark):
    plan = lambda df: df.join(small(spark.range(100), 50), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan(spark.range(10))
    assert "broadcast" in spark.range(10).join(small(spark.range(40), 50), "id")._jdf.queryExecution().optimizedPlan().toString()
