"""Problem 7: mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.operators.shared import cut

CELLS = 4096
TOKENIZER = "byte_bpe_50k.tiktoken"


def source_key(source: Column) -> Column:
    """Spellings that differ in case, hyphen or underscore, or outer spaces are one source."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), "-", "_")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str | None = None, pattern: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows (doc_id, source, tokens, weight) with the tokens of the whole text; null texts have none, a null weight is 1."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), batch.column("weight")], ["doc_id", "source", "tokens", "weight"])

    heavy = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text", heavy.alias("weight")).mapInArrow(run, "doc_id long, source string, tokens long, weight double")


def _targets(counted: DataFrame, targets: DataFrame, total: float | None) -> tuple[dict[str, dict], float]:
    """Per source its tokens, share, cap and aim. The sources of the targets are few, as they are written by hand."""
    have = {r["source"]: r["t"] for r in counted.join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    per = {}
    for r in targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect():
        per[r["source"]] = {"share": r["share"] or 0.0, "cap": max(0, r["cap"] if r["cap"] is not None else 1), "have": have.get(r["source"]) or 0}
    usable = {s: p for s, p in per.items() if p["share"] > 0 and p["cap"] and p["have"]}
    whole = sum(p["share"] for p in usable.values())
    most = min((p["cap"] * p["have"] * whole / p["share"] for p in usable.values()), default=0.0)
    total = most if total is None else min(total, most)
    for s, p in per.items():
        p["aim"] = total * p["share"] / whole if s in usable else 0.0
        p["copies"] = min(p["cap"], int(p["aim"] // p["have"])) if p["have"] else 0
        p["rest"] = p["aim"] - p["copies"] * p["have"] if p["copies"] < p["cap"] else 0.0
    return per, total


def pareto_rank(seed: Column, ident: Column, p: Column) -> Column:
    """Random odds divided by the odds of inclusion p, brought to 0 to 1 in the same order. Random odds are a hash of seed and id."""
    u = (F.pmod(F.xxhash64(seed, ident), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))  # kept away from 0 and 1
    rank = (u / (1 - u)) / (q / (1 - q))
    return rank / (1 + rank)


def factors(cells: list[tuple[str, int, float, float]], aims: dict[str, float]) -> dict[str, float]:
    """Per source the factor f with which the chances of inclusion min(1, f w) give its aim in tokens. cells: rows (source, cell
    of w, tokens, w times tokens); cells of large w whose chance would pass 1 are certain and leave the rest to the others."""
    out = {}
    for s, aim in aims.items():
        mine = sorted(((c, t, wt) for of, c, t, wt in cells if of == s), reverse=True)
        tokens, weighted = float(aim), sum(wt for _, _, wt in mine)
        for _, t, wt in mine:
            if weighted <= 0 or tokens / weighted * (wt / t) < 1:
                break
            tokens, weighted = tokens - t, weighted - wt
        out[s] = max(0.0, tokens) / weighted if weighted > 0 else 1e300
    return out


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, weight: str | None = None, power: float = 0.5, path: str | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): rows (doc_id, source, tokens, copies), and per target source what was aimed at and reached.

    total is the number of tokens to choose; by default, and at most, the largest at which every source that has documents
    can get its share within its max_repeats. A source's aim is met by whole copies of all its documents plus a sample:
    documents are ranked by random odds divided by their odds of inclusion (Rosen's Pareto sampling) and taken until the
    aim is reached, to the nearest document. Chances of inclusion are unequal: in proportion to weight, a column of the
    documents (1 by default; documents of no positive weight come last), times the tokens to the given power, so that by
    default a document of four times the tokens is twice as likely to be in. Documents whose chance would pass 1 are certain.
    Random odds are a hash of seed and doc_id, so a run repeats itself. Sources without targets are left out; targets
    without documents get nothing and the others keep their proportions. Texts without tokens are never chosen. Repeated
    doc_ids are documents of their own.

    No source is ranked in one task: ranks are cut into 4096 cells, twice, and only the cell in which the aim is
    reached is sorted.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    counted = count_tokens(documents, path, pattern, weight)
    counted = cut(counted.where("tokens > 0 and doc_id is not null"))
    per, _ = _targets(counted, wanted, total)
    facts = spark.createDataFrame([(s, float(p["share"]), int(p["cap"]), int(p["have"]), float(p["aim"]), int(p["copies"]), float(p["rest"])) for s, p in sorted(per.items())], "source string, share double, cap int, have long, aim double, copies int, rest double")
    aims = {s: q["rest"] for s, q in per.items()}
    w = F.greatest(F.lit(1e-12), F.col("weight")) * F.pow("tokens", F.lit(float(power)))
    near = counted.join(F.broadcast(facts), "source").withColumn("_w", w)
    spread = near.where("rest > 0").groupBy("source", F.floor(F.log2("_w") * 16).alias("c")).agg(F.sum("tokens").alias("t"), F.sum(F.col("_w") * F.col("tokens")).alias("wt")).collect()
    scale = spark.createDataFrame(sorted(factors([(r["source"], r["c"], r["t"], r["wt"]) for r in spread], {s: v for s, v in aims.items() if v > 0}).items()), "source string, _f double")
    ranked = (
        near.join(F.broadcast(scale), "source", "left")
        .withColumn("_z", pareto_rank(F.lit(seed), F.col("doc_id"), F.coalesce("_f", F.lit(0.0)) * F.col("_w")))
        .withColumn("_c", F.floor(F.col("_z") * CELLS)).withColumn("_f", F.floor((F.col("_z") * CELLS - F.col("_c")) * CELLS))
    )
    cells = ranked.where("rest > 0").groupBy("source", "_c").agg(F.sum("tokens").alias("t")).collect()
    at, before = _crossing(((r["source"], r["_c"], r["t"]) for r in cells), aims)
    edge = spark.createDataFrame([(s, c) for s, c in at.items()], "source string, _ec long")
    close = ranked.join(F.broadcast(edge), "source").where("_c = _ec")
    fine = close.groupBy("source", "_f").agg(F.sum("tokens").alias("t")).collect()
    at2, before2 = _crossing(((r["source"], r["_f"], r["t"]) for r in fine), {s: aims[s] - before[s] for s in at})
    edge2 = spark.createDataFrame([(s, at[s], at2.get(s, CELLS), float(aims[s] - before[s] - before2.get(s, 0))) for s in at], "source string, _ec long, _ef long, _left double")
    placed = ranked.join(F.broadcast(edge2), "source", "left")
    below = (F.col("_c") < F.col("_ec")) | ((F.col("_c") == F.col("_ec")) & (F.col("_f") < F.col("_ef")))
    on = (F.col("_c") == F.col("_ec")) & (F.col("_f") == F.col("_ef"))
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("_z", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2
    last = placed.where(on).withColumn("_so", so_far).withColumn("extra", (F.col("_so") <= F.col("_left")).cast("int"))
    rest = placed.where(~F.coalesce(on, F.lit(False))).withColumn("extra", F.when((F.col("rest") > 0) & F.col("_ec").isNull(), 1).when((F.col("rest") > 0) & below, 1).otherwise(0))
    columns = ["doc_id", "source", "tokens", (F.col("copies") + F.col("extra")).cast("int").alias("copies")]
    chosen = cut(rest.select(*columns).unionByName(last.select(*columns)).where("copies > 0"))
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    everything = chosen.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    shares = facts.join(got, "source", "left").select(
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.col("have").alias("source_tokens"),
        F.coalesce("chosen_tokens", F.lit(0)).alias("chosen_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce("chosen_tokens", F.lit(0)) / F.lit(float(everything or 1)), 6).alias("actual_share"),
    )
    return chosen, shares


def _crossing(cells, aims: dict[str, float]) -> tuple[dict[str, int], dict[str, float]]:
    """Per source the cell in which the running sum passes the aim, and the sum before it. None if it never does."""
    by: dict[str, list[tuple[int, int]]] = {}
    for s, c, t in cells:
        by.setdefault(s, []).append((c, t))
    at, before = {}, {}
    for s, of in by.items():
        so_far = 0.0
        for c, t in sorted(of):
            if so_far + t > aims[s]:
                at[s], before[s] = c, so_far
                break
            so_far += t
    return at, before
