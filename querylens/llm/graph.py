"""Connected components with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.operators.shared import cut, forget


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of the links; component is the smallest node that it is linked with.

    Alternates the two star contractions of Kiveris et al. (2014), each an aggregation with map-side combining and an
    equi-join, until no edge changes: O(log^2) rounds, never more edges than at the start. Null ends and loops are
    ignored. Each round ends in a written table.
    """
    edges = cut(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    state = None
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        last, edges = edges, cut(large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        forget(last)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def boruvka(links: DataFrame, a: str = "a", b: str = "b", weight: str | None = None, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """A minimum spanning forest (a, b, weight) and labels (node, component), by contraction of minimum edges.

    In each round every component takes its lightest edge to another one, ties by the smaller pair of ends, which rules out
    circles but of two; chosen edges are contracted by pointer jumping, and edges inside a component are dropped. The
    number of components at least halves, so log2 of them rounds suffice. Ends may be of any ordered type; null ends and
    loops are ignored; component is the smallest node. Without weight all edges weigh the same. Forest and labels are
    written tables.
    """
    w = F.lit(0.0) if weight is None else F.col(weight).cast("double")
    base = cut(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.coalesce(w, F.lit(0.0)).alias("w"))
        .groupBy("a", "b").agg(F.min("w").alias("w"))
    )
    label = cut(base.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    edges, forest = base.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), []
    for _ in range(rounds):
        ends = edges.select(F.col("ca").alias("c"), F.col("cb").alias("to"), F.struct("w", "a", "b").alias("e")).unionByName(edges.select(F.col("cb").alias("c"), F.col("ca").alias("to"), F.struct("w", "a", "b").alias("e")))
        chosen = cut(ends.groupBy("c").agg(F.min_by("to", "e").alias("to"), F.min("e").alias("e")))
        if not chosen.take(1):
            break
        forest.append(chosen.select("e.a", "e.b", "e.w").distinct())
        back = chosen.select(F.col("c").alias("to"), F.col("to").alias("back"))
        jump = cut(chosen.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
        while True:
            up = jump.select(F.col("c").alias("to"), F.col("to").alias("up"))
            last, longer = jump, cut(jump.join(up, "to").select("c", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
            jump = longer.select("c", "to")
            jump._querylens_at = longer._querylens_at
            forget(last)
            if not longer.where("moved").take(1):
                break
        last, label = label, cut(label.join(jump, label.component == jump.c, "left").select("node", F.coalesce("to", "component").alias("component")))
        forget(last, jump)
        la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        last, edges = edges, cut(edges.select("a", "b", "w").join(la, "a").join(lb, "b").where("ca != cb"))
        forget(last)
    else:
        raise RuntimeError("contraction did not settle")
    smallest = label.groupBy("component").agg(F.min("node").alias("smallest"))
    labels = cut(label.join(smallest, "component").select("node", F.col("smallest").alias("component")))
    tree = forest[0] if forest else base.select("a", "b", "w").limit(0)
    for f in forest[1:]:
        tree = tree.unionByName(f)
    return cut(tree.distinct().withColumnRenamed("w", "weight")), labels
