"""Generation of queries as stages over rows: plan, generate or declare and repair, vote.

The language model is behind an interface; here it is a table of scripted replies or any function on batches, so a stage
is one pass over all samples, and repair is one pass over those that still fail.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.prompts import composed, fenced
from querylens.functions.sqltext import extract_sql, sql_facts
from querylens.operators.checks import Stored, validate
from querylens.operators.declarations import reply_sheet
from querylens.operators.evaluate import voted
from querylens.operators.execution import stored_values
from querylens.operators.shared import cut


class Generator(ABC):
    """Turns samples into queries. predict() gives one query for one sample; predict_all() runs it on the executors."""

    name = ""

    @abstractmethod
    def predict(self, sample: dict) -> str: ...

    def predict_all(self, samples: DataFrame) -> DataFrame:
        """Rows (idx, pred_sql), one a sample; a sample on which predict() fails gets the empty text."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for sample in batch.to_dict("records"):
                    try:
                        out.append(self.predict(sample) or "")
                    except Exception:  # a failure is an empty prediction
                        out.append("")
                yield pd.DataFrame({"idx": batch["idx"], "pred_sql": out})

        return samples.mapInPandas(run, "idx long, pred_sql string")


class FirstTable(Generator):
    """Selects everything of the first table of the database: a baseline that needs no model."""

    name = "first_table"

    def __init__(self, first_tables: dict[str, str]):
        self.first = first_tables

    def predict(self, sample: dict) -> str:
        return 'SELECT * FROM "{}"'.format(self.first[sample["db_id"]].replace('"', '""'))


class Chat:
    """A chat endpoint: a function from messages to a reply. Settings of a call go before the endpoint's own."""

    def __init__(self, send: Callable[..., str] | None, **settings):
        self.send, self.settings = send, settings

    def __call__(self, messages: list[dict], **settings) -> str:
        if self.send is None:
            raise RuntimeError("no chat endpoint is configured")
        return self.send(messages, **(self.settings | settings))


class Direct(Generator):
    """One prompt, one reply, one query."""

    name = "direct"

    def __init__(self, chat: Chat, prompt: Callable[[dict], list[dict]]):
        self.chat, self.prompt = chat, prompt

    def predict(self, sample: dict) -> str:
        return fenced(self.chat(self.prompt(sample)))


Replies = Callable[[DataFrame], DataFrame]


def scripted(replies: DataFrame) -> Replies:
    """A model that replays a table (id, stage, turn, reply): asked rows (id, stage, turn) get their reply, others null."""

    def ask(asked: DataFrame) -> DataFrame:
        return asked.join(replies.select("id", "stage", "turn", "reply"), ["id", "stage", "turn"], "left")

    return ask


@dataclass(frozen=True)
class Variant:
    """What a pipeline switches on."""

    name: str
    use_plan: bool = False
    declare: bool = False
    use_profile: bool = False
    force_considered: bool = False
    extra_checks: bool = False
    conventions: bool = False
    convention_checks: bool = False
    max_repairs: int = 2
    n_plans: int = 1
    large: bool = False
    thinking: bool = False

    @property
    def plan_temperature(self) -> float:
        return 0.0 if self.n_plans == 1 else 0.7

    @property
    def settings(self) -> dict:
        """What a call passes to the chat endpoint besides its messages."""
        return {"large": self.large, "thinking": self.thinking}


#: What a part of a variant's name switches on.
SWITCHES = {
    "plan": {"use_plan": True}, "sheet": {"declare": True}, "profile": {"use_profile": True}, "forced": {"force_considered": True}, "rules": {"conventions": True},
    "checks": {"extra_checks": True}, "checked": {"convention_checks": True}, "once": {"max_repairs": 0}, "large": {"large": True}, "thinking": {"thinking": True}, "direct": {},
}
# The combinations of switches on offer. All that plan or declare use the large model with thinking.
OFFERED = """direct direct_thinking direct_large direct_large_thinking direct_rules plan plan_sheet sheet sheet_rules sheet_rules_checks sheet_checks
 sheet_rules_checks_once plan_sheet_profile plan_sheet_profile_forced plan_sheet_profile_forced_checks plan_sheet_rules plan_sheet_rules_checked""".split()


def variant(name: str) -> Variant:
    """The variant that a name of switches stands for, offered or not; ValueError names an unknown switch."""
    on: dict = {}
    for part in name.split("_"):
        if part not in SWITCHES:
            raise ValueError(f"unknown switch {part!r} in {name!r}; known are {sorted(SWITCHES)}")
        on |= SWITCHES[part]
    if on.get("use_plan") or on.get("declare") or on.get("conventions"):
        on |= {"large": True, "thinking": True}
    return Variant(name, **on)


VARIANTS = {name: variant(name) for name in OFFERED}
#: All that can be chosen by name.
MODELS = [FirstTable.name, *OFFERED]


def plans(samples: DataFrame, ask: Replies, variant: Variant) -> DataFrame:
    """Rows (id, turn, plan): n_plans plans a sample; without planning one empty plan."""
    if not variant.use_plan:
        return samples.select("id", F.lit(0).alias("turn"), F.lit("").alias("plan"))
    asked = samples.select("id", F.lit("plan").alias("stage"), F.explode(F.expr(f"sequence(0, {variant.n_plans - 1})")).alias("turn"))
    return ask(asked).select("id", "turn", F.coalesce("reply", F.lit("")).alias("plan"))


def generate(planned: DataFrame, ask: Replies) -> DataFrame:
    """Rows (id, turn, plan, sql): one query a plan; a missing reply gives the empty text."""
    asked = planned.withColumn("stage", F.lit("generate"))
    return ask(asked).select("id", "turn", "plan", F.coalesce(extract_sql(F.col("reply")), F.lit("")).alias("sql"))


def declare(samples: DataFrame, catalog: DataFrame, ask: Replies, variant: Variant, stored: Stored | None = None) -> tuple[DataFrame, DataFrame]:
    """(final, rounds): rows (id, sql, passed, n_rounds), and every round (id, round_no, sql, error, declarations, issues).

    Each sample is asked at most 1 + max_repairs times, until a reply has no issues. The last query that could be read is
    kept even if it fails; it is '' only if no round could be read. All samples that still fail are asked in one pass; the
    turn of the script is the round. samples: (id, db_id, question, profile_items); stored
    gives the stored values that literals are checked against.
    """
    left = samples.select("id", "db_id", "question", F.expr("cast(array() as array<string>)").alias("profile_items") if not variant.force_considered else F.col("profile_items"))
    rounds = None
    for turn in range(1 + variant.max_repairs):
        asked = left.select("id", F.lit("declare").alias("stage"), F.lit(turn).alias("turn"))
        read = cut(left.join(ask(asked).select("id", "reply"), "id", "left").withColumn("sheet", reply_sheet("reply")).withColumn("sql", F.col("sheet.sql")).withColumn("facts", sql_facts("sql")))
        found = validate(read, catalog, variant.extra_checks, variant.convention_checks, stored)
        issues = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("check", "ord", "issue"))), lambda x: x["issue"]).alias("issues"))
        written = F.get_json_object(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "$.declarations").alias("declarations")
        this = cut(read.select("id", F.lit(turn).alias("round_no"), "sql", F.col("sheet.error").alias("error"), written).join(issues, "id", "left").withColumn("issues", F.coalesce("issues", F.expr("cast(array() as array<string>)"))))
        rounds = this if rounds is None else rounds.unionByName(this)
        failing = this.where(F.size("issues") > 0).select("id")
        if turn == variant.max_repairs or not failing.take(1):
            break
        left = left.join(failing, "id", "left_semi")
    rounds = cut(rounds)
    last = F.max_by("sql", F.when(F.col("error").isNull(), F.col("round_no")))
    final = rounds.groupBy("id").agg(F.coalesce(last, F.lit("")).alias("sql"), F.max_by(F.size("issues") == 0, "round_no").alias("passed"), F.count("*").alias("n_rounds"))
    return final, rounds


def asked_of(chat: Chat, build: Callable[[dict], list[dict]], context: DataFrame, threads: int = 10) -> Replies:
    """A model behind a chat endpoint: messages are built from a row (id, stage, turn and the columns of context, by id) and
    sent from the executors, some at a time; a failed call gives a null reply."""

    def ask(asked: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from concurrent.futures import ThreadPoolExecutor

            def one(row: dict) -> str | None:
                try:
                    return chat(build(row), temperature=row.get("temperature", 0.0))
                except Exception:  # as in predict_all
                    return None

            with ThreadPoolExecutor(threads) as pool:
                for batch in batches:
                    yield pd.DataFrame({"id": batch["id"], "stage": batch["stage"], "turn": batch["turn"], "reply": list(pool.map(one, batch.to_dict("records")))})

        replies = cut(asked.select("id", "stage", "turn").join(context, "id").mapInPandas(run, "id long, stage string, turn int, reply string"))
        return asked.join(replies, ["id", "stage", "turn"], "left")

    return ask


def messages(row: dict, variant: Variant) -> list[dict]:
    """The messages of one call for a row (stage, and schema, facts, question, plan and issues as far as there are)."""
    told = {k: row.get(k) or "" for k in ("schema", "facts", "question", "plan", "issues")}
    if row["stage"] == "plan" and not variant.use_profile:
        told["facts"] = ""
    elif row["stage"] == "declare":
        told["facts"] = told["facts"] or "(no facts known)"
    return composed(row["stage"], told, variant.conventions)


def preview(samples: DataFrame, variant: Variant) -> DataFrame:
    """Rows (id, stage, role, content): every first message that a variant would send, without sending any."""
    stages = (["plan"] if variant.use_plan else []) + (["declare"] if variant.declare else ["generate"])
    schema = "id long, stage string, role string, content string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r["id"], s, m["role"], m["content"]) for r in batch.to_dict("records") for s in stages for m in messages(r | {"stage": s}, variant)]
            yield pd.DataFrame(rows, columns=["id", "stage", "role", "content"])

    return samples.mapInPandas(run, schema)


def traced(samples: DataFrame, candidates: DataFrame, rounds: DataFrame | None, chosen: DataFrame) -> DataFrame:
    """Rows (id, payload): the trace of every sample as JSON {question, plans, candidates, winner, final_sql}, a candidate being
    {plan, sql, ok, error, n_rows, checks}, checks {passed, rounds, declarations} and a round {sql, declarations, issues}.

    candidates: (id, candidate, cid, plan, sql, ok, n_rows, error), rounds: those of declare() by cid, chosen: (id, winner, pred_sql)."""
    def ordered(by: str, what: Column, into: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), what.alias("of")))), lambda x: x["of"]).alias(into)

    if rounds is not None:
        sheet = F.try_parse_json("declarations")
        one = F.to_json(F.struct("sql", sheet.alias("declarations"), "issues"), {"ignoreNullFields": "false"})
        last = F.max_by("declarations", F.when(F.col("declarations").isNotNull(), F.col("round_no")))
        checks = rounds.groupBy(F.col("id").alias("cid")).agg(F.max_by(F.size("issues") == 0, "round_no").alias("passed"), ordered("round_no", one, "rounds"), last.alias("declarations"))
        checks = checks.select("cid", F.concat(F.lit('{"passed":'), F.col("passed").cast("string"), F.lit(',"rounds":['), F.array_join("rounds", ","), F.lit('],"declarations":'), F.coalesce(F.to_json(F.try_parse_json("declarations")), F.lit("null")), F.lit("}")).alias("checks"))
        candidates = candidates.join(checks, "cid", "left")
    else:
        candidates = candidates.withColumn("checks", F.lit(None).cast("string"))
    parts = F.to_json(F.struct("plan", "sql", "ok", "error", "n_rows"), {"ignoreNullFields": "false"})
    each = F.concat(F.substring(parts, F.lit(1), F.length(parts) - 1), F.lit(',"checks":'), F.coalesce("checks", F.lit("null")), F.lit("}"))
    by = candidates.groupBy("id").agg(ordered("candidate", F.col("plan"), "plans"), ordered("candidate", each, "each"))
    whole = samples.select("id", "question").join(by, "id", "left").join(chosen.select("id", "winner", "pred_sql"), "id", "left")
    quoted = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(F.array(c).alias("x"))), "$.x"), F.lit("[null]"))
    text = lambda c: F.expr(f"substring(q_{c}, 2, length(q_{c}) - 2)")
    whole = whole.withColumns({f"q_{c}": quoted(F.col(c)) for c in ("question", "pred_sql")})
    payload = F.concat(
        F.lit('{"question":'), text("question"), F.lit(',"plans":'), F.coalesce(F.to_json("plans"), F.lit("[]")), F.lit(',"candidates":['), F.coalesce(F.array_join("each", ","), F.lit("")),
        F.lit('],"winner":'), F.coalesce(F.col("winner").cast("string"), F.lit("null")), F.lit(',"final_sql":'), text("pred_sql"), F.lit("}"),
    )
    return whole.select("id", payload.alias("payload"))


def pipeline(samples: DataFrame, catalog: DataFrame, ask: Replies, variant: Variant, databases: dict, timeout_s: float = 30.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, candidates, traces) of a variant: plans, one query or sheet a plan, and a vote over all plans' queries by result.

    predictions: (id, winner, pred_sql), '' where no query came out; candidates: (id, candidate, plan, sql); traces: see traced().
    With one plan the script asks for id, with more for id * n_plans + plan.
    """
    planned = plans(samples, ask, variant)
    each = cut(planned.join(samples, "id").withColumn("cid", F.col("id") * variant.n_plans + F.col("turn")).withColumnsRenamed({"id": "sample", "turn": "candidate"}).withColumnRenamed("cid", "id"))
    rounds = None
    if variant.declare:
        written, rounds = declare(each, catalog, ask, variant, stored_values(samples.sparkSession, databases))
    else:
        written = generate(each.select("id", F.lit(0).alias("turn"), "plan"), ask)
    candidates = cut(each.join(written.select("id", "sql"), "id").select(F.col("sample").alias("id"), "candidate", F.col("id").alias("cid"), "db_id", "plan", "sql"))
    won, outcomes = voted(samples.sparkSession, candidates.select(F.col("id").alias("question"), "candidate", "db_id", "sql"), databases, timeout_s)
    chosen = cut(won.select(F.col("question").alias("id"), "winner").join(candidates, "id").where("candidate = winner").select("id", "winner", F.col("sql").alias("pred_sql")))
    full = candidates.join(outcomes.withColumnRenamed("question", "id"), ["id", "candidate"])
    return chosen, candidates.drop("db_id", "cid"), traced(samples, full, rounds, chosen)
