"""Queries that compare result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.operators import cells, compare, evaluate
from querylens.operators.execution import Database
from querylens.operators.shared import cut
from querylens.sources.tables import table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two queries on orders as pred and gold: neighbouring ranges of keys, with columns swapped and totals rounded apart."""
    o = table(spark, d, "orders")
    pred = o.where("o_orderkey % 7 < 3").select("o_orderstatus", "o_custkey", F.round("o_totalprice", 0).alias("t"))
    gold = o.where("o_orderkey % 7 > 1").select("o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") + 1e-8, 0).alias("t"))
    both = cut(cells.stage(pred, 0, "pred").unionByName(cells.stage(gold, 0, "gold")))
    n = both.where("col_idx = 0").groupBy("sample_id", "side").agg(F.count("*").alias("n_rows"))
    return both, cut(n.select("sample_id", "side", F.lit(True).alias("ok"), "n_rows", F.lit(3).alias("n_cols"), F.lit(None).cast("string").alias("error")))


def pair_row_signature(spark: SparkSession, d: str) -> DataFrame:
    """How many row signatures appear how often, by side."""
    return compare.row_signatures(_sides(spark, d)[0]).groupBy("side", "n").agg(F.count("*").alias("signatures"))


def pair_col_signature(spark: SparkSession, d: str) -> DataFrame:
    found = compare.column_signatures(*_sides(spark, d))
    return found.groupBy("side", "n").agg(F.count("*").alias("signatures"))


def pair_jaccard(spark: SparkSession, d: str) -> DataFrame:
    both, shape = _sides(spark, d)
    rows = compare.jaccard(compare.row_signatures(both)).select(F.lit("row").alias("kind"), "common", "total")
    columns = compare.jaccard(compare.column_signatures(both, shape)).select(F.lit("col").alias("kind"), "common", "total")
    return rows.unionByName(columns).withColumn("sim", compare.similarity(F.col("common"), F.col("total")))


#: (gold, pred) over tables of fixed size.
PAIRS = [
    ("SELECT n_name, n_regionkey FROM nation", "SELECT n_name, n_regionkey FROM nation"),
    ("SELECT n_name, n_regionkey FROM nation", "SELECT n_name, n_regionkey FROM nation ORDER BY n_name DESC"),
    ("SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation"),
    ("SELECT n_name, n_regionkey FROM nation ORDER BY n_name", "SELECT n_name, n_regionkey FROM nation ORDER BY n_name DESC"),
    ("SELECT n_name, n_regionkey FROM nation ORDER BY n_name", "SELECT n_regionkey, n_name FROM nation ORDER BY n_name"),
    ("SELECT n_name FROM nation", "SELECT n_name FROM nation WHERE n_regionkey <> 3"),
    ("SELECT count(*) FROM region", "SELECT 5.0000000001"),
    ("SELECT r_name FROM region WHERE r_regionkey > 9", "SELECT n_name FROM nation WHERE n_nationkey < 0"),
    ("SELECT r_name FROM region WHERE r_regionkey > 9", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 0"),
    ("SELECT sum(n_regionkey) / 7 FROM nation", "SELECT 7"),
    ("SELECT r_name FROM region", "   "),
    ("SELECT r_name FROM region", "SELECT no_column FROM region"),
    ("SELECT no_column FROM region", "SELECT r_name FROM region"),
    ("SELECT r_name FROM region", "DROP TABLE region"),
    ("SELECT r_name FROM region", "-- nothing"),
]


def execution_match_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The pairs, run and compared end to end."""
    database = Database(spark, {t: f"{d}/{t}.parquet" for t in ("nation", "region")})
    samples = spark.createDataFrame([(i, "d", "", "", gold) for i, (gold, _) in enumerate(PAIRS)], "idx long, db_id string, question string, reasoning_type string, query string")
    predictions = spark.createDataFrame([(i, pred) for i, (_, pred) in enumerate(PAIRS)], "idx long, pred_sql string")
    found = evaluate.evaluate(spark, samples, predictions, {"d": database})
    return found.select("index", "valid", "match", "sim_row", "sim_col", "similarity")


def vote_executed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of three questions, run and voted by result."""
    database = Database(spark, {t: f"{d}/{t}.parquet" for t in ("nation", "region")})
    texts = {
        1: ["SELECT 5", "SELECT count(*) FROM region", "SELECT count(*) FROM nation", "SELECT count(*) * 1.0 FROM region"],
        2: ["SELECT r_name FROM region", "SELECT r_name FROM region ORDER BY 1 DESC", "SELECT n_name FROM nation", "SELECT oops"],
        3: ["SELECT oops", "no query", "SELECT FROM"],
    }
    return evaluate.vote(spark, [(q, i, "d", sql) for q, of in texts.items() for i, sql in enumerate(of)], {"d": database})


def ordered_match(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty orders by price in order, in reverse order and with columns swapped, against an ordered gold query."""
    top = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    variants = {0: ["o_orderkey", "o_totalprice"], 1: ["o_orderkey", "o_totalprice"], 2: ["o_totalprice", "o_orderkey"], 3: ["o_orderkey", "o_custkey"]}
    order = {0: ["_desc", "_key"], 1: ["o_totalprice", "_key"], 2: ["_desc", "_key"], 3: ["_desc", "_key"]}
    parts = []
    from pyspark.sql import Window

    keyed = cut(top.withColumn("_desc", -F.col("o_totalprice")).withColumn("_key", F.col("o_orderkey")))
    for i, columns in variants.items():
        for side, cols, by in (("gold", variants[0], order[0]), ("pred", columns, order[i])):
            at = F.row_number().over(Window.orderBy(*by)) - 1
            kinds = {f.name: f.dataType for f in keyed.schema.fields}
            rows = keyed.withColumn("row_pos", at.cast("long")).select("row_pos", F.posexplode(F.array(*(cells.cell_text(F.col(c), kinds[c]) for c in cols))).alias("col_idx", "cell"))
            parts.append(rows.select(F.lit(i).cast("long").alias("sample_id"), F.lit(side).alias("side"), "row_pos", "col_idx", "cell"))
    all_cells = parts[0]
    for p in parts[1:]:
        all_cells = all_cells.unionByName(p)
    all_cells = cut(all_cells)
    shape = all_cells.groupBy("sample_id", "side").agg(F.lit(True).alias("ok"), F.count_if(F.col("col_idx") == 0).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"), F.lit(None).cast("string").alias("error"))
    ordered = spark.createDataFrame([(i, True) for i in variants], "sample_id long, ordered boolean")
    return compare.compare(all_cells, shape, ordered)


QUERIES = {f.__name__: f for f in (pair_row_signature, pair_col_signature, pair_jaccard, execution_match_matrix, vote_executed, ordered_match)}

_SIDES = """s AS (SELECT 'pred' AS side, o_orderkey AS k, 'n' || o_custkey AS a, 's' || o_orderstatus AS b, 'n' || round(o_totalprice)::BIGINT AS t FROM orders WHERE o_orderkey % 7 < 3
  UNION ALL SELECT 'gold', o_orderkey, 'n' || o_custkey, 's' || o_orderstatus, 'n' || round(o_totalprice + 1e-8::DOUBLE)::BIGINT FROM orders WHERE o_orderkey % 7 > 1),
  r AS (SELECT side, list_sort([a, b, t])::VARCHAR AS sig, count(*) AS n FROM s GROUP BY 1, 2),
  u AS (SELECT side, 'a' AS c, a AS cell FROM s UNION ALL SELECT side, 'b', b FROM s UNION ALL SELECT side, 't', t FROM s),
  f AS (SELECT side, c, cell, count(*) AS times FROM u GROUP BY ALL),
  c AS (SELECT side, sig, count(*) AS n FROM (SELECT side, c, md5(string_agg(cell || ':' || times, ',' ORDER BY cell)) AS sig FROM f GROUP BY 1, 2) GROUP BY 1, 2)"""


def _jaccard(kind: str, source: str) -> str:
    return f"""SELECT '{kind}' AS kind, sum(least(p, g))::BIGINT AS common, sum(greatest(p, g))::BIGINT AS total, round(sum(least(p, g)) / sum(greatest(p, g)), 4) AS sim
      FROM (SELECT sig, coalesce(sum(n) FILTER (WHERE side = 'pred'), 0) AS p, coalesce(sum(n) FILTER (WHERE side = 'gold'), 0) AS g FROM {source} GROUP BY sig)"""


ORACLE = {
    "pair_row_signature": f"WITH {_SIDES} SELECT side, n, count(*) AS signatures FROM r GROUP BY side, n",
    "pair_col_signature": f"WITH {_SIDES} SELECT side, n, count(*) AS signatures FROM c GROUP BY side, n",
    "pair_jaccard": f"WITH {_SIDES} {_jaccard('row', 'r')} UNION ALL {_jaccard('col', 'c')}",
    "execution_match_matrix": """SELECT * FROM (VALUES (0::BIGINT, true, true, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (1, true, true, 1, 1, 1), (2, true, true, 1, 1, 1), (3, true, false, 1, 1, 1), (4, true, true, 1, 1, 1),
      (5, true, false, round((SELECT count(*) FILTER (WHERE n_regionkey <> 3) / count(*) FROM nation), 4), 0, round((SELECT count(*) FILTER (WHERE n_regionkey <> 3) / count(*) FROM nation), 4) / 2),
      (6, true, true, 1, 1, 1), (7, true, true, 1, 1, 1), (8, true, false, 1, 0.5, 0.75), (9, true, (SELECT sum(n_regionkey) // 7 = 7 FROM nation), (SELECT (sum(n_regionkey) // 7 = 7)::INT FROM nation), (SELECT (sum(n_regionkey) // 7 = 7)::INT FROM nation), (SELECT (sum(n_regionkey) // 7 = 7)::INT FROM nation)),
      (10, false, false, 0, 0, 0), (11, false, false, 0, 0, 0), (12, true, false, 0, 0, 0), (13, false, false, 0, 0, 0), (14, true, false, 0, 0, 0)) v("index", valid, match, sim_row, sim_col, similarity)""",
    "vote_executed": "SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 3::BIGINT, 4::BIGINT), (2, 0, 2, 4), (3, 2, 0, 3)) v(question, winner, votes, n_candidates)",
    "ordered_match": """WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20),
      a AS (SELECT k, c, p, row_number() OVER (ORDER BY p DESC, k) AS down, row_number() OVER (ORDER BY p, k) AS up FROM t),
      e AS (SELECT (SELECT bool_and(x.k = y.k AND x.p = y.p) FROM a x JOIN a y ON x.down = y.up) AS same_reversed,
                   (SELECT count(*) FROM (SELECT DISTINCT k FROM a)) AS n)
      SELECT 0::BIGINT AS sample_id, true AS match, 1.0::DOUBLE AS sim_row, 1.0::DOUBLE AS sim_col, 1.0::DOUBLE AS similarity
      UNION ALL SELECT 1, same_reversed, 1, 1, 1 FROM e UNION ALL SELECT 2, true, 1, 1, 1 UNION ALL SELECT 3, false, 0, 0.3333, 0.1666""",
}
