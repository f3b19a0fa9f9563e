"""Problem 2: splits that keep families together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm.families import name_key, roots
from querylens.operators.shared import cut, join_counted, with_position

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def resolved(rows: DataFrame, registry: DataFrame, ident: str, db: str) -> DataFrame:
    """Rows (id, written, key, root_db): key is null for null names, root_db is null for unknown ones."""
    of, _ = roots(registry)
    named = rows.select(F.col(ident).alias("id"), F.col(db).alias("written"), name_key(F.col(db)).alias("key"))
    return named.join(of.select("key", "root_db"), "key", "left")


def split_families(rows: DataFrame, registry: DataFrame, ident: str, db: str, shares: dict[str, float] = SHARES) -> DataFrame:
    """Rows (id, family, split): shares of all rows, and all rows of a family in one split.

    A family is the root database; rows with an unknown name are a family by that name, and each row without a name is a
    family of its own. Families are stratified by size: a band holds those of 2^k to 2^(k+1) - 1 rows. Bands are dealt from
    the largest down. Within a band the families lie in random order on a line of rows, which is cut into a stretch for each
    split, and a family goes to the split in whose stretch its middle lies. A stretch is as long as the share of all rows
    dealt so far lacks, so what one band leaves uneven the next evens out, and no split is off its share by more than the
    rows of the largest family. Null ids are kept, each repeated row stays.

    Only sums of a band pass through the driver, and there are at most 63 bands.
    """
    known = resolved(rows, registry, ident, db).withColumn("family", F.coalesce(F.concat(F.lit("r:"), "root_db"), F.concat(F.lit("n:"), "key"), F.concat(F.lit("i:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    known = cut(known.select("id", "family"))
    sizes = cut(known.groupBy("family").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.log2("n")).cast("int")))
    placed = cut(with_position(sizes, [F.col("band"), F.xxhash64("family"), F.col("family")], "before", F.col("n")))
    bands = sorted(((r["band"], r["before"], r["n"]) for r in placed.groupBy("band").agg(F.min("before").alias("before"), F.sum("n").alias("n")).collect()), reverse=True)
    middle, got, so_far, pick = F.col("before") + F.col("n") / 2, dict.fromkeys(shares, 0), 0, F.lit(next(reversed(shares)))
    whole = sum(shares.values())
    for band, begin, n in bands:
        so_far += n
        lacks = {k: max(0.0, v / whole * so_far - got[k]) for k, v in shares.items()}
        end, stretch = float(begin), F
        for k, v in lacks.items():
            end += v * n / sum(lacks.values())
            stretch = stretch.when(middle < end, F.lit(k))
        stretch = stretch.otherwise(F.lit(k))
        for r in placed.where(F.col("band") == band).groupBy(stretch.alias("split")).agg(F.sum("n").alias("n")).collect():
            got[r["split"]] += r["n"]
        pick = F.when(F.col("band") == band, stretch).otherwise(pick)
    return join_counted(known, cut(placed.select("family", "n", pick.alias("split"))), ["family"], "n").select("id", "family", "split")
