"""Declaration sheets: replies of a generator as typed rows, and the reason where a reply can't be read.

A reply holds a JSON object {sql, declarations{time_context, outputs, assumptions, considered}} between its first and last
brace. Every stage is one pass over rows on the executors.
"""

from __future__ import annotations

import json

import pandas as pd

from querylens.functions.vectorised import vectorised

# What may stand in the two enumerated fields, and the texts that stand for truth values.
ANCHOR_KINDS = ("now", "column", "literal")
SOURCES = ("column", "derived")
TRUE, FALSE = ("true", "1", "yes", "y", "on", "t"), ("false", "0", "no", "n", "off", "f")

SHEET = (
    "error string, detail string, sql string, displaced boolean, reference string, "
    "outputs array<struct<name:string,source:string,column:string,expr:string,anchors:array<struct<key:string,kind:string,ref:string>>>>, "
    "assumptions array<struct<target:string,place:string,value:string>>, "
    "considered array<struct<item:string,used:boolean,note:string>>"
)
NAMES = ["error", "detail", "sql", "displaced", "reference", "outputs", "assumptions", "considered"]


class Invalid(ValueError):
    pass


def _text(x, where: str, blank: bool = False) -> str:
    if x is None and blank:
        return ""
    if not isinstance(x, str):
        raise Invalid(f"{where} is no text")
    return x


def _truth(x, where: str) -> bool:
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) and x in (0, 1):
        return bool(x)
    if isinstance(x, str) and x.lower() in TRUE + FALSE:
        return x.lower() in TRUE
    raise Invalid(f"{where} is neither true nor false")


def _list(x, where: str) -> list:
    if not isinstance(x, list):
        raise Invalid(f"{where} is no list")
    return x


def _dict(x, where: str) -> dict:
    if not isinstance(x, dict):
        raise Invalid(f"{where} is no object")
    return x


def _anchors(x, where: str) -> list[dict]:
    out = []
    for k, a in ({} if x is None else _dict(x, where)).items():
        if isinstance(a, str):
            a = {"kind": "literal", "ref": a}
        a = _dict(a, f"{where}.{k}")
        if a.get("kind") not in ANCHOR_KINDS:
            raise Invalid(f"{where}.{k}.kind is unknown")
        out.append({"key": k, "kind": a["kind"], "ref": _text(a.get("ref", ""), f"{where}.{k}.ref", True)})
    return out


def _output(x, where: str) -> dict:
    x = _dict(x, where)
    out = {"name": _text(x.get("name"), f"{where}.name"), "source": x.get("source")}
    if out["source"] not in SOURCES:
        raise Invalid(f"{where}.source is unknown")
    out |= {c: _text(x.get(c, ""), f"{where}.{c}", True) for c in ("column", "expr")} | {"anchors": _anchors(x.get("anchors"), f"{where}.anchors")}
    needed = "column" if out["source"] == "column" else "expr"
    if not out[needed]:
        raise Invalid(f"{where} is of source {out['source']} but has no {needed}")
    return out


def _assumption(x, where: str) -> dict:
    x = _dict(x, where)
    if x.get("value") is None:
        raise Invalid(f"{where}.value is missing")
    return {"target": _text(x.get("target"), f"{where}.target"), "place": _text(x.get("where", ""), f"{where}.where", True), "value": str(x["value"])}


def _considered(x, where: str) -> dict:
    x = _dict(x, where)
    return {"item": _text(x.get("item"), f"{where}.item"), "used": _truth(x.get("used"), f"{where}.used"), "note": _text(x.get("note", ""), f"{where}.note", True)}


def read_declarations(d) -> dict:
    """The four parts of a sheet; Invalid tells what is wrong with it."""
    d = _dict(d, "declarations")
    time = _dict(d.get("time_context"), "time_context")
    outputs = [_output(x, f"outputs.{i}") for i, x in enumerate(_list(d.get("outputs"), "outputs"))]
    if not outputs:
        raise Invalid("outputs is empty")
    return {
        "displaced": _truth(time.get("displaced"), "time_context.displaced"), "reference": _text(time.get("reference", ""), "time_context.reference", True), "outputs": outputs,
        "assumptions": [_assumption(x, f"assumptions.{i}") for i, x in enumerate(_list(d.get("assumptions", []), "assumptions"))],
        "considered": [_considered(x, f"considered.{i}") for i, x in enumerate(_list(d.get("considered", []), "considered"))],
    }


def read_reply(reply: str | None) -> dict:
    """One reply as a row of SHEET. error is null, no_object, bad_json or bad_structure."""
    row = dict.fromkeys(NAMES)
    text = reply or ""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end <= start:
        return row | {"error": "no_object"}
    try:
        data = json.loads(text[start : end + 1])
    except (ValueError, RecursionError) as e:
        return row | {"error": "bad_json", "detail": str(e)[:200]}
    try:
        sql = _text(_dict(data, "reply").get("sql"), "sql")
        if not sql:
            raise Invalid("sql is empty")
        return row | {"sql": sql} | read_declarations(data.get("declarations"))
    except Invalid as e:
        return row | {"error": "bad_structure", "detail": str(e)[:200]}


def read_sheet(declarations: str | None) -> dict:
    """The same for the JSON text of the declarations alone."""
    row = dict.fromkeys(NAMES)
    if declarations is None:
        return row | {"error": "no_object"}
    try:
        return row | read_declarations(json.loads(declarations))
    except Invalid as e:
        return row | {"error": "bad_structure", "detail": str(e)[:200]}
    except (ValueError, RecursionError) as e:
        return row | {"error": "bad_json", "detail": str(e)[:200]}


@vectorised(SHEET)
def reply_sheet(reply: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_reply(r) for r in reply], columns=NAMES)


@vectorised(SHEET)
def declared_sheet(declarations: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_sheet(d) for d in declarations], columns=NAMES)
