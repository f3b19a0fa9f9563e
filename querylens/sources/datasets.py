"""Datasets, predictions, databases and reports as files."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED, OPTIONAL = ("db_id", "query", "question"), ("reasoning_type", "commonsense_knowledge")


def resolve(name: str, aliases: dict[str, str]) -> str:
    """The path that an alias stands for; any other name is a path itself."""
    return aliases.get(name, name)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """Rows (idx, v): the elements of the one JSON array in a file, counted from 0, or the lines of JSON in a folder, which carry
    their idx; v is a variant."""
    if is_folder(spark, path):
        return spark.read.text(path).select(F.parse_json("value").alias("v")).select(F.variant_get("v", "$.idx", "long").alias("idx"), "v")
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    if whole.count() != 1 or not whole.where("schema_of_variant(v) like 'ARRAY%'").take(1):
        raise ValueError(f"{path} is not one JSON array")
    return whole.select(F.posexplode(F.col("v").cast("array<variant>")).alias("idx", "v"))


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Rows (idx, db_id, query, question, reasoning_type, commonsense_knowledge, extras) of a dataset file.

    Elements without db_id, query or question raise KeyError; reasoning_type is '' and commonsense_knowledge null where absent;
    all other keys go to extras, plain values as their text and others as JSON. For datasets of many files use parquet: a
    JSON array is one record and is read in one task.
    """
    rows = _elements(spark, path)
    fields = F.from_json(F.to_json("v"), "map<string,string>")
    rows = rows.select(F.col("idx").cast("long").alias("idx"), "v", fields.alias("m"))
    lacking = rows.where(" or ".join(["m is null"] + [f"not map_contains_key(m, '{k}')" for k in REQUIRED])).select("m").take(1)
    if lacking:
        raise KeyError(next(k for k in REQUIRED if k not in (lacking[0]["m"] or {})))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    return rows.select(
        "idx", *(text(k).alias(k) for k in REQUIRED), F.coalesce(text("reasoning_type"), F.lit("")).alias("reasoning_type"),
        text("commonsense_knowledge").alias("commonsense_knowledge"), F.map_filter("m", lambda k, _: ~k.isin(*REQUIRED, *OPTIONAL)).alias("extras"),
    )


def load_predictions(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Rows (idx, pred_sql) of a file with an array of texts or objects {"predicted_sql": text}, which may be mixed, or of a folder
    that write_predictions() made.

    An element of another kind raises TypeError, another number of elements than expected ValueError.
    """
    rows = _elements(spark, path)
    kind = F.schema_of_variant("v")
    sql = F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).when(kind.startswith("OBJECT"), F.try_variant_get("v", "$.predicted_sql", "string"))
    rows = rows.select(F.col("idx").cast("long").alias("idx"), sql.alias("pred_sql"))
    if rows.where("pred_sql is null").take(1):
        raise TypeError("a prediction is neither a text nor an object with predicted_sql")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} predictions, {expected} expected")
    return rows


def schema_map(catalog: DataFrame) -> DataFrame:
    """Rows (db_id, table_name, columns): names in lower case, columns sorted."""
    return catalog.groupBy("db_id", F.lower("table_name").alias("table_name")).agg(F.array_sort(F.collect_set(F.lower("column_name"))).alias("columns"))


def view_catalog(spark: SparkSession, db_id: str, names: list[str] | None = None, keys: dict[str, set[str]] | None = None, parents: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """The catalog rows of registered views: (db_id, table_name, column_name, ord, decl_type, is_pk, fk_table). Files know no
    keys, so they are given: keys by table, parents by (table, column)."""
    names = names or [t.name for t in spark.catalog.listTables() if t.isTemporary]
    rows = [
        (db_id, t, f.name, i, f.dataType.simpleString(), f.name in (keys or {}).get(t, ()), (parents or {}).get((t, f.name)))
        for t in names for i, f in enumerate(spark.table(t).schema.fields)
    ]
    return spark.createDataFrame(rows, "db_id string, table_name string, column_name string, ord int, decl_type string, is_pk boolean, fk_table string")


def database_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (db_id, n_tables): the databases in a folder, each a folder of Parquet tables that aren't empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for at in fs.listStatus(fs_path) if fs.exists(fs_path) else []:
        if at.isDirectory():
            tables = [t for t in fs.listStatus(at.getPath()) if t.getPath().getName().endswith(".parquet") and (t.isDirectory() or t.getLen() > 0)]
            rows.append((at.getPath().getName(), len(tables)))
    return spark.createDataFrame(rows, "db_id string, n_tables int")


def inventory(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Rows (db_id, status, n_samples, n_tables): ok, missing (needed but absent or empty) or unreferenced.

    needed has a db_id per sample, present (db_id, n_tables). Null db_ids are not needed.
    """
    wanted = needed.where("db_id is not null").groupBy("db_id").agg(F.count("*").alias("n_samples"))
    both = wanted.join(present, "db_id", "full")
    status = F.when(F.col("n_samples").isNull(), "unreferenced").when(F.coalesce("n_tables", F.lit(0)) == 0, "missing").otherwise("ok")
    return both.select("db_id", status.alias("status"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("n_tables", F.lit(0)).cast("int").alias("n_tables"))


def report_name(alias: Column, predictions: Column) -> Column:
    """alias_predictions; an ending _alias of the predictions' name isn't repeated."""
    stem = F.regexp_replace(F.regexp_extract(predictions, r"([^/\\]*)$", 1), r"\.json$", "")
    ending = F.concat(F.lit("_"), alias)
    short = F.when(F.endswith(stem, ending), F.substring(stem, F.lit(1), F.length(stem) - F.length(ending))).otherwise(stem)
    return F.concat(alias, F.lit("_"), short)


def run_meta(data: str, predictions: str | None, db_dir: str, timeout_s: float) -> dict:
    return {"data": data, "predictions": predictions, "db_dir": db_dir, "timeout_s": timeout_s, "timestamp": datetime.datetime.now().isoformat(timespec="seconds")}


def _write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> str:
    """Write one file, part by part, through the file system of the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    out = fs.create(target, True)
    try:
        parts = iter(parts)
        while some := "".join(islice(parts, 1000)):
            out.write(bytearray(some.encode("utf-8")))
    finally:
        out.close()
    return path


def write_report(spark: SparkSession, results: DataFrame, rollup: DataFrame, meta: dict, folder: str, name: str, whole: bool = True) -> str:
    """name.json with meta, summary, both groupings and the samples in the order of their index.

    The roll-up is one row a database and reasoning type. Samples pass the driver one after the other; for results that one
    file shouldn't hold, whole=False writes them where they are, as lines of JSON in name.samples beside the document.
    """
    def scores(r) -> dict:
        return {"n": r["n"], "VA": r["va"], "EX": r["ex"], "SIM": r["sim"]}

    rows = rollup.orderBy("level", "key").collect()
    total = next((r for r in rows if r["level"] == "all"), None)
    summary = {"n": 0, "n_valid": 0, "n_match": 0, "VA": 0.0, "EX": 0.0, "SIM": 0.0} if total is None else {"n": total["n"], "n_valid": total["n_valid"], "n_match": total["n_match"], **{k: v for k, v in scores(total).items() if k != "n"}}
    report = {"meta": meta, "summary": summary} | {part: {r["key"]: scores(r) for r in rows if r["level"] == level} for part, level in (("by_db", "db"), ("by_reasoning_type", "reasoning"))}
    head = json.dumps(report, ensure_ascii=False, indent=2)
    if not whole:
        results.write.mode("overwrite").json(f"{folder}/{name}.samples", ignoreNullFields=False)
        return _write_text(spark, f"{folder}/{name}.json", [head])
    lines = results.orderBy("index") if "index" in results.columns else results
    lines = lines.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator()
    body = (f"{',' if i else ''}\n    {r['line']}" for i, r in enumerate(lines))
    return _write_text(spark, f"{folder}/{name}.json", chain([head[:-2], ',\n  "samples": ['], body, ["\n  ]\n}"]))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows (idx, match) of a report with its samples in it."""
    samples = spark.read.text(path, wholetext=True).select(F.explode(F.variant_get(F.parse_json("value"), "$.samples", "array<variant>")).alias("v"))
    return samples.select(F.variant_get("v", "$.index", "long").alias("idx"), F.variant_get("v", "$.match", "boolean").alias("match"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One file with a JSON array of the queries in the order of idx if the path ends in .json, else a folder of lines of JSON
    (idx, predicted_sql) in that order, written where they are. load_predictions() reads both. Positions must be 0, 1, ...
    for a file: an array has no others."""
    if not path.endswith(".json"):
        predictions.select("idx", F.col("pred_sql").alias("predicted_sql")).repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").json(path)
        return
    rows = predictions.orderBy("idx").select("idx", F.coalesce("pred_sql", F.lit("")).alias("pred_sql")).toLocalIterator()

    def items() -> Iterator[str]:
        for i, r in enumerate(rows):
            if r["idx"] != i:
                raise ValueError(f"position {i} is missing or stands twice")
            yield f"{',' if i else ''}\n {json.dumps(r['pred_sql'], ensure_ascii=False)}"

    _write_text(predictions.sparkSession, path, chain(["["], items(), ["\n]"]))


def write_traces(traces: DataFrame, path: str) -> bool:
    """Traces (idx, payload) as lines of JSON {"idx", "trace"} in the order of idx, in the folder <stem>.trace.json; nothing is
    written where there are none. Other columns than these make the trace where there is no payload."""
    if not traces.take(1):
        return False
    target = re.sub(r"\.json$", "", path) + ".trace.json"
    if "payload" in traces.columns:
        line = F.concat(F.lit('{"idx":'), F.col("idx").cast("string"), F.lit(',"trace":'), F.col("payload"), F.lit("}"))
        traces = traces.repartitionByRange("idx").sortWithinPartitions("idx")
    else:
        line = F.to_json(F.struct(*[c for c in traces.columns if c not in ("db_path", "schema")]), {"ignoreNullFields": "false"})
    traces.select(line.alias("value")).write.mode("overwrite").text(target)
    return True


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    """Rows (idx, payload) of a folder that write_traces() made, or of a file with an array of traces."""
    rows = _elements(spark, path)
    inner = F.coalesce(F.try_variant_get("v", "$.trace", "variant"), F.col("v")) if is_folder(spark, path) else F.col("v")
    return rows.select(F.col("idx").cast("long").alias("idx"), F.to_json(inner).alias("payload"))
