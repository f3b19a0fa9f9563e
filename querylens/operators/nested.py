"""Problem 4: flat tables out of deeply nested JSON texts.

Each record is read as a stream of tokens and turned into triples as it is read: the path of the nearest repeated ancestor
with its positions, the path of a value below it, and the value. What no table wants is checked and passed over, whatever its
depth; no record is held parsed. Triples of one repeated ancestor make one table; they are pivoted where they arise, as
the aggregation combines on the map side and all triples of a record come from one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where arrays and objects belong. A list of one shape is an array of such elements, a dict an object, None a plain value.
DECLARATIONS = {
    "time_context": {},
    "outputs": [{"anchors": {}}],
    "assumptions": [{}],
    "considered": [{}],
}
TRACE = {
    "plans": [None],
    "candidates": [{"checks": {"rounds": [{"declarations": DECLARATIONS, "issues": [None]}], "declarations": DECLARATIONS}}],
}
_SCHEMA = "record long, version long, path string, ordinals array<int>, leaf string, value string"


class Invalid(ValueError):
    """The text is not strict JSON."""


_STRING = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"'
_TOKEN = re.compile(rf"[ \t\n\r]*(?:([{{}}\[\],:])|({_STRING})|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9.eE+\-])|(true|false|null))")
_SPACE = re.compile(r"[ \t\n\r]*")


def _string(token: str) -> str:
    """The text of a string token; halves of surrogate pairs that stand alone become the replacement character."""
    if "\\" not in token:
        return token[1:-1]
    text = json.loads(token)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Tokens:
    """A JSON text read token by token."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        """The first character of the next token, '' at the end."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        found = _TOKEN.match(self.text, self.at)
        if found is None:
            raise Invalid(f"at {self.at}")
        self.at = found.end()
        return found.group(found.lastindex)

    def expect(self, mark: str) -> None:
        if self.take() != mark:
            raise Invalid(f"{mark} expected before {self.at}")

    def members(self) -> Iterator[str]:
        """The keys of the object that begins here; whoever asks has to read each value."""
        self.expect("{")
        if self.peek() == "}":
            self.take()
            return
        while True:
            key = self.take()
            if key[0] != '"':
                raise Invalid(f"key expected before {self.at}")
            self.expect(":")
            yield _string(key)
            end = self.take()
            if end == "}":
                return
            if end != ",":
                raise Invalid(f"comma expected before {self.at}")

    def elements(self) -> Iterator[int]:
        """The positions of the array that begins here, likewise."""
        self.expect("[")
        if self.peek() == "]":
            self.take()
            return
        i = 0
        while True:
            yield i
            end = self.take()
            if end == "]":
                return
            if end != ",":
                raise Invalid(f"comma expected before {self.at}")
            i += 1

    def skip(self) -> str:
        """Read one value of any depth; its text as written."""
        self.peek()
        start, open_ = self.at, []
        while True:
            token = self.take()
            if token in "}],:":
                raise Invalid(f"value expected before {self.at}")
            if token in "{[":
                if self.peek() == ("}" if token == "{" else "]"):
                    self.take()
                else:
                    open_.append(token)
                    if token == "{":
                        self._key()
                    continue
            while open_:
                end = self.take()
                if end == ",":
                    if open_[-1] == "{":
                        self._key()
                    break
                if end != ("}" if open_.pop() == "{" else "]"):
                    raise Invalid(f"comma expected before {self.at}")
            else:
                return self.text[start : self.at]

    def _key(self) -> None:
        if self.take()[0] != '"':
            raise Invalid(f"key expected before {self.at}")
        self.expect(":")

    def end(self) -> None:
        if self.peek():
            raise Invalid(f"more text at {self.at}")


def _plain(written: str) -> str | None:
    """A value as the text of a cell: null for null, the text of a string, numbers as written, others as JSON of one layout."""
    if written[0] == '"':
        return _string(written)
    if written[0] not in "{[":
        return None if written == "null" else written
    tokens, out = Tokens(written), []
    while tokens.peek():
        token = tokens.take()
        out.append(json.dumps(_string(token), ensure_ascii=False) if token[0] == '"' else {",": ", ", ":": ": "}.get(token, token))
    return "".join(out)


class _Reader:
    """Triples (path of the repeated ancestor, positions, path below it, value) of one record, as it is read. An object that stands
    as an element gives a triple with an empty leaf, so it is there even if it holds nothing."""

    def __init__(self, wanted: frozenset[str] | None):
        self.wanted, self.out = wanted, []

    def read(self, text: str, shape: dict) -> list[tuple]:
        tokens = Tokens(text)
        if tokens.peek() != "{":
            return []
        try:
            self.object(tokens, shape, "", (), "")
            tokens.end()
        except Invalid:
            return []
        return [x for x in self.out if x is not None]

    def inside(self, tokens: Tokens, what, marks: str) -> None:
        """what() of the value here, or of the JSON text that stands in its place; a text that isn't JSON gives nothing."""
        mark = tokens.peek()
        if mark in marks:
            what(tokens)
            return
        written = tokens.skip()
        if mark == '"':
            inner, n = Tokens(_string(written)), len(self.out)
            if (first := inner.peek()) and first in marks:
                try:
                    what(inner)
                    inner.end()
                except Invalid:
                    del self.out[n:]

    def object(self, tokens: Tokens, shape: dict, path: str, at: tuple, leaf: str) -> None:
        here = self.wanted is None or path in self.wanted
        if here and leaf == "" and path:
            self.out.append((path, at, "", None))
        seen: dict[str, tuple[int, int]] = {}
        for k in tokens.members():
            if k in seen:  # of a key that comes twice the last value counts
                self.out[slice(*seen[k])] = [None] * (seen[k][1] - seen[k][0])
            n, name, kind = len(self.out), f"{leaf}.{k}".strip("."), shape.get(k)
            if isinstance(kind, dict):
                self.inside(tokens, lambda t, kind=kind, name=name: self.object(t, kind, path, at, name), "{")
            elif isinstance(kind, list):
                inner = f"{path}.{name}".strip(".")
                if self.wanted is not None and not any(w == inner or w.startswith(f"{inner}.") for w in self.wanted):
                    tokens.skip()
                else:
                    self.inside(tokens, lambda t, kind=kind, inner=inner: self.array(t, kind[0], inner, at), "[{")
            else:
                value = _plain(tokens.skip()) if here else tokens.skip()
                if here and value is not None:
                    self.out.append((path, at, name, value))
            seen[k] = (n, len(self.out))

    def array(self, tokens: Tokens, kind, path: str, at: tuple) -> None:
        for i in tokens.elements() if tokens.peek() == "[" else (0,):  # an object is an array of one
            if kind is not None:
                self.inside(tokens, lambda t, i=i: self.object(t, kind, path, (*at, i), ""), "{")
                continue
            value = _plain(tokens.skip())
            if value is not None and (self.wanted is None or path in self.wanted):
                self.out.append((path, (*at, i), "", value))


def _arrays(text: str) -> dict[str, list[int]]:
    """Of all arrays of a text by path how many there are and how many elements they have; {} if it isn't JSON."""
    tokens, found = Tokens(text), {}
    todo: list[tuple[str, Iterator]] = []
    path = ""
    try:
        while True:
            mark = tokens.peek()
            if mark == "{":
                todo.append((path, tokens.members()))
            elif mark == "[":
                found.setdefault(path, [0, 0])[0] += 1
                todo.append((path, tokens.elements()))
            else:
                tokens.skip()
            while todo:
                up, rest = todo[-1]
                if (step := next(rest, None)) is None:
                    todo.pop()
                    continue
                if isinstance(step, int):
                    found[up][1] += 1
                    path = f"{up}[]"
                else:
                    path = f"{up}.{step}".strip(".")
                break
            else:
                tokens.end()
                return found
    except Invalid:
        return {}


def repeated_paths(rows: DataFrame, payload: str) -> DataFrame:
    """Rows (path, n_arrays, n_elements): the repeated ancestors that the records hold, found from their arrays as they are read.
    [] stands for the elements of an array. Texts that aren't valid JSON have none; arrays inside texts aren't looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = {}
            for text in batch.column(0).to_pylist():
                for path, (n, m) in _arrays(text).items() if text else ():
                    at = total.setdefault(path, [0, 0])
                    at[0], at[1] = at[0] + n, at[1] + m
            yield pa.RecordBatch.from_pydict({"path": pa.array(list(total), pa.string()), "n_arrays": pa.array([n for n, _ in total.values()], pa.int64()), "n_elements": pa.array([m for _, m in total.values()], pa.int64())})

    return rows.select(payload).mapInArrow(run, "path string, n_arrays long, n_elements long").groupBy("path").agg(F.sum("n_arrays").alias("n_arrays"), F.sum("n_elements").alias("n_elements"))


def triples(rows: DataFrame, ident: str, payload: str, shape: dict = TRACE, paths: list[str] | None = None) -> DataFrame:
    """Rows (record, version, path, ordinals, leaf, value); version is a hash of the payload, so records that share an id
    stay apart. paths limits the triples to those of these repeated ancestors; "" is the record itself.

    Positions count from 0 as written; null elements take a position but give nothing. An object where an array belongs is
    an array of one, a JSON text where an object or array belongs is that object or array. Payloads that are null, empty,
    not strict JSON or not an object yield nothing, nesting may be of any depth. Plain values keep their text, other values are JSON text. Identical
    rows (same id and payload) are one record; null ids stay null.
    """
    wanted = None if paths is None else frozenset(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], [], []]
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                version = xxhash.xxh64_intdigest(text) - (1 << 63)
                for triple in _Reader(wanted).read(text, shape):
                    for column, x in zip(out, (i, version, *triple)):
                        column.append(x)
                if len(out[0]) > 50_000:
                    yield _batch(out)
                    out = [[], [], [], [], [], []]
        if out[0]:
            yield _batch(out)

    return rows.select(F.col(ident).cast("long").alias("record"), F.col(payload).alias("payload")).mapInArrow(run, _SCHEMA)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["record", "version", "path", "ordinals", "leaf", "value"])


def pivot(found: DataFrame, path: str, leaves: dict[str, str], positions: list[str]) -> DataFrame:
    """One table: the rows of a repeated ancestor, with positions as parent links and leaves ({column: path below}) as columns."""
    rows = found.where(F.col("path") == path).groupBy("record", "version", "ordinals").agg(*(F.max(F.when(F.col("leaf") == leaf, F.col("value"))).alias(c) for c, leaf in ({"_there": ""} | leaves).items()))
    return rows.select("record", "version", *(F.element_at("ordinals", i + 1).alias(p) for i, p in enumerate(positions)), *leaves)


CHECKS = "candidates.checks"
OUTPUT_LEAVES = {"name": "name", "source": "source", "column": "column", "expr": "expr"}


def candidates(traces: DataFrame) -> DataFrame:
    """One row per candidate object: (record, candidate_no, plan, sql, ok, error, n_rows, passed)."""
    leaves = {c: c for c in ("plan", "sql", "ok", "error", "n_rows")} | {"passed": "checks.passed"}
    return pivot(triples(traces, "trace_id", "payload", paths=["candidates"]), "candidates", leaves, ["candidate_no"])


def rounds(traces: DataFrame) -> DataFrame:
    """One row per round object: (record, candidate_no, round_no, sql, displaced, reference)."""
    path = f"{CHECKS}.rounds"
    leaves = {"sql": "sql", "displaced": "declarations.time_context.displaced", "reference": "declarations.time_context.reference"}
    return pivot(triples(traces, "trace_id", "payload", paths=[path]), path, leaves, ["candidate_no", "round_no"])


def outputs(traces: DataFrame) -> DataFrame:
    """One row per output object, in the declarations of every round and in those directly under checks (round_no -1)."""
    return _declared(traces, "outputs", OUTPUT_LEAVES, "output_no")


def assumptions(traces: DataFrame) -> DataFrame:
    """One row per assumption object, numbered like outputs."""
    return _declared(traces, "assumptions", {c: c for c in ("target", "where", "value")}, "assumption_no")


def considered(traces: DataFrame) -> DataFrame:
    """One row per considered object, numbered like outputs."""
    return _declared(traces, "considered", {c: c for c in ("item", "used", "note")}, "considered_no")


def _declared(traces: DataFrame, what: str, leaves: dict[str, str], number: str) -> DataFrame:
    inner, direct = f"{CHECKS}.rounds.declarations.{what}", f"{CHECKS}.declarations.{what}"
    found = triples(traces, "trace_id", "payload", paths=[inner, direct])
    rows = found.groupBy("record", "version", "path", "ordinals").agg(*(F.max(F.when(F.col("leaf") == leaf, F.col("value"))).alias(c) for c, leaf in leaves.items()))
    deep = F.col("path") == inner
    return rows.select(
        "record", "version", F.col("ordinals")[0].alias("candidate_no"),
        F.when(deep, F.col("ordinals")[1]).otherwise(F.lit(-1)).alias("round_no"),
        F.element_at("ordinals", -1).alias(number), *leaves,
    )
