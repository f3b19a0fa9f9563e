"""python -m querylens evaluate | generate | measure | inventory | prompts | preview

evaluate   --data F (--pred F | --gold-as-pred) --db-dir D [--timeout S] [--limit N] [--out D]: run, compare and report
generate   --data F --db-dir D --out F [--model M] [--replies F] [--limit N] [--eval D]: predictions of a model, F.json as one file or F
           as a folder, and its traces; --replies has lines of JSON (id, stage, turn, reply) in place of a chat endpoint, id being
           the position; --eval evaluates at once and puts the report into D
measure    --data D: worth of the checks on the tables of a folder
measure    --data F --pred F --trace F --results F --db-dir D: the same for the files of one run
inventory  --data F --db-dir D: databases needed and present; exit code 1 if one is missing
prompts    --data F --db-dir D [--index N] [--out D]: question prompts
preview    --data F --db-dir D --index N [--model M]: the first messages a model would be sent, without sending any
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.prompts import question_prompt, schema_with_rows
from querylens.operators import generate, profile, scores
from querylens.operators.evaluate import evaluate
from querylens.operators.measure import precision_of_run
from querylens.plans.scores import check_precision
from querylens.sources import datasets, sqlite


def _databases(data, folder: str) -> dict[str, str]:
    return {r["db_id"]: sqlite.find(folder, r["db_id"]) for r in data.select("db_id").distinct().collect()}


def _schemas(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows (db_id, schema): the tables of each database with their first rows."""
    texts = {}
    for db, path in paths.items():
        con = sqlite.connect(path)
        names = sqlite.table_names(con)
        con.close()
        tables = {t: sqlite.read_table(spark, path, t) for t in names}
        texts[db] = "\n\n".join(schema_with_rows(df, t, df.columns[:1]).first()["text"] for t, df in tables.items())
    return spark.createDataFrame(list(texts.items()), "db_id string, schema string")


def _facts(spark: SparkSession, paths: dict[str, str], catalog: DataFrame) -> DataFrame:
    """Rows (db_id, facts, profile_items): what the data of each database prove."""
    counts = None
    for db, path in paths.items():
        own = catalog.where(F.col("db_id") == db)
        keys: dict[str, list[str]] = {}
        for r in profile.snapshot_candidates(own).select("table_name", F.explode("key_columns").alias("k")).collect():
            keys.setdefault(r["table_name"], []).append(r["k"])
        names = [r["table_name"] for r in own.select("table_name").distinct().collect()]
        one = profile.counted(spark, {t: sqlite.read_table(spark, path, t) for t in names}, keys).withColumn("db_id", F.lit(db))
        counts = one if counts is None else counts.unionByName(one)
    found = profile.facts(catalog, counts)
    dbs = spark.createDataFrame([(db,) for db in paths], "db_id string")
    number = F.substring("item", 2, 9).cast("int")
    items = found.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("i"), "fact"))), lambda x: x["fact"]).alias("profile_items"))
    return profile.rendered(found, dbs).withColumnRenamed("text", "facts").join(items, "db_id", "left").withColumn("profile_items", F.coalesce("profile_items", F.expr("cast(array() as array<string>)")))


def _context(spark: SparkSession, data: DataFrame, paths: dict[str, str], catalog: DataFrame) -> DataFrame:
    return data.select(F.col("idx").alias("id"), "db_id", "question").join(_schemas(spark, paths), "db_id").join(_facts(spark, paths, catalog), "db_id")


def _report(spark: SparkSession, a, data: DataFrame, predictions: DataFrame, paths: dict[str, str], pred: str | None, out: str | None) -> None:
    results = evaluate(spark, data, predictions, {db: sqlite.load(spark, path) for db, path in paths.items()}, a.timeout).cache()
    rollup = scores.rollup(results).cache()
    rollup.orderBy("level", "key").show(1000, False)
    if out:
        alias, stem = (x.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json") for x in (a.data, pred or "gold"))
        name = spark.range(1).select(datasets.report_name(F.lit(alias), F.lit(stem)).alias("n")).first()["n"]
        print(datasets.write_report(spark, results, rollup, datasets.run_meta(a.data, pred, a.db_dir, a.timeout), out, name))


def _generate(spark: SparkSession, a, data: DataFrame, paths: dict[str, str]) -> None:
    traces = None
    if a.model == generate.FirstTable.name:
        predictions = generate.FirstTable(sqlite.first_tables(spark, paths)).predict_all(data.select("idx", "db_id"))
    else:
        variant, catalog = generate.VARIANTS[a.model], sqlite.catalog(spark, paths)
        samples = _context(spark, data, paths, catalog)
        if a.replies:
            ask = generate.scripted(spark.read.schema("id long, stage string, turn int, reply string").json(a.replies))
        else:
            ask = generate.asked_of(generate.Chat(None, **variant.settings), lambda row: generate.messages(row, variant), samples.drop("profile_items"))
        chosen, _, traces = generate.pipeline(samples, catalog, ask, variant, {db: sqlite.load(spark, path) for db, path in paths.items()}, a.timeout)
        predictions = data.select("idx").join(chosen.select(F.col("id").alias("idx"), "pred_sql"), "idx", "left").withColumn("pred_sql", F.coalesce("pred_sql", F.lit("")))
    datasets.write_predictions(predictions, a.out)
    if traces is not None:
        datasets.write_traces(traces.withColumnRenamed("id", "idx"), a.out)
    if a.eval:
        _report(spark, a, data, datasets.load_predictions(spark, a.out), paths, a.out, a.eval)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="querylens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("command", choices=["evaluate", "generate", "measure", "inventory", "prompts", "preview"])
    ap.add_argument("--data", required=True)
    ap.add_argument("--pred")
    ap.add_argument("--gold-as-pred", action="store_true")
    ap.add_argument("--db-dir")
    ap.add_argument("--timeout", type=float, default=30.0)
    ap.add_argument("--limit", type=int, default=0, help="first samples only; 0 is all")
    ap.add_argument("--index", type=int)
    ap.add_argument("--out")
    ap.add_argument("--model", default=generate.FirstTable.name, choices=generate.MODELS)
    ap.add_argument("--replies")
    ap.add_argument("--eval")
    ap.add_argument("--trace")
    ap.add_argument("--results")
    a = ap.parse_args(args)
    if a.command == "evaluate" and bool(a.pred) == a.gold_as_pred:
        ap.error("evaluate takes one of --pred and --gold-as-pred")
    spark = spark or SparkSession.builder.appName("querylens").getOrCreate()
    if a.command == "measure" and not a.pred:
        check_precision(spark, a.data).orderBy("check").show(100, False)
        return 0
    data = datasets.load_dataset(spark, a.data)
    if a.limit:
        data = data.where(F.col("idx") < a.limit)
    if a.command == "inventory":
        present = []
        for r in data.select("db_id").distinct().collect():
            try:
                con = sqlite.connect(sqlite.find(a.db_dir, r["db_id"]))
                present.append((r["db_id"], len(sqlite.table_names(con))))
                con.close()
            except FileNotFoundError:
                pass
        found = datasets.inventory(data.select("db_id"), spark.createDataFrame(present, "db_id string, n_tables int"))
        found.orderBy("db_id").show(1000, False)
        return int(bool(found.where("status = 'missing'").take(1)))
    paths = _databases(data, a.db_dir)
    if a.command == "generate":
        _generate(spark, a, data, paths)
        return 0
    if a.command == "measure":
        found = precision_of_run(data, datasets.load_predictions(spark, a.pred), datasets.load_traces(spark, a.trace), datasets.load_results(spark, a.results), sqlite.catalog(spark, paths))
        found.orderBy("check").show(100, False)
        return 0
    if a.command == "preview":
        variant = generate.VARIANTS["plan_sheet_rules" if a.model == generate.FirstTable.name else a.model]
        one = data.where(F.col("idx") == a.index)
        paths = {r["db_id"]: paths[r["db_id"]] for r in one.select("db_id").collect()}
        for r in generate.preview(_context(spark, one, paths, sqlite.catalog(spark, paths)), variant).collect():
            print(f"== {r['stage']} {r['role']}\n{r['content']}\n")
        return 0
    if a.command == "prompts":
        prompts = data.join(_schemas(spark, paths), "db_id").select("idx", question_prompt(F.col("schema"), F.col("question"), F.col("commonsense_knowledge"), F.col("reasoning_type")).alias("prompt"))
        if a.index is not None:
            print(prompts.where(F.col("idx") == a.index).first()["prompt"])
        if a.out:
            prompts.write.mode("overwrite").json(a.out)
        return 0
    predictions = data.select("idx", F.col("query").alias("pred_sql")) if a.gold_as_pred else datasets.load_predictions(spark, a.pred)
    _report(spark, a, data, predictions if not a.limit else predictions.where(F.col("idx") < a.limit), paths, a.pred, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
