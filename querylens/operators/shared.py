"""What several operators need: intermediate tables, guarded joins, global positions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds more than this part of all rows, so there are at most 1000 hot groups.
HOT_PART = 1000
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only in local mode, where driver and executors are one machine, a temporary folder stands in when it is unset.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "local", None):
        shared_dir.local = "file://" + tempfile.mkdtemp(prefix="querylens-")
        _made.add(shared_dir.local)
    return shared_dir.local


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for at in _made:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session is already gone
        pass


atexit.register(_remove)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it back: its lineage ends there and survives executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _made.add(at)
    written = spark.read.schema(df.schema).parquet(at)
    written._querylens_at = at
    return written


def forget(*tables: DataFrame) -> None:
    """Remove tables made by cut() that nothing will read again, such as those of a finished round."""
    for df in tables:
        at = getattr(df, "_querylens_at", None)
        if at in _made:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _made.discard(at)


def join_counted(members: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of members with groups (one row per key, n = its members) that holds for any skew.

    Keys with more than 1/HOT_PART of all counted rows are at most HOT_PART, so they are broadcast and their members stay
    where they are; all other keys are joined by shuffle. Both inputs are read twice; pass tables made by cut().
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > F.lit(total / HOT_PART)
    few = F.broadcast(groups.where(hot))
    return members.join(few, keys).unionByName(
        members.join(few.select(*keys), keys, "left_anti").join(groups.where(~hot), keys)
    )


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint only if it has no more than so many rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if len(df.limit(rows + 1).groupBy().count().where(F.col("count") <= rows).take(1)) else df


def with_position(df: DataFrame, order: list, position: str = "position", weight=None, parts: int | None = None) -> DataFrame:
    """Add 0-based global positions in the given order (or sums of weight before each row) without one big window.

    Range partitions are sorted on their own; only one total per partition goes through the driver. Rows must be
    distinct in order for a fixed result; ties fall arbitrarily.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    weight = F.lit(1).cast("long") if weight is None else weight
    ranged = cut(df.withColumn("_w", weight).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_o", F.monotonically_increasing_id()))
    totals = sorted((r["_p"], r["t"]) for r in ranged.groupBy("_p").agg(F.sum("_w").alias("t")).collect())
    offsets, so_far = [], 0
    for p, t in totals:
        offsets.append((p, so_far))
        so_far += t or 0
    from pyspark.sql import Window

    before = Window.partitionBy("_p").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    at = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return ranged.withColumn(position, F.coalesce(F.sum("_w").over(before), F.lit(0)) + F.element_at(at, F.col("_p"))).drop("_w", "_p", "_o")
