"""Model responses to typed records, with the strictness of a full JSON parser."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.scalar import fenced_json

SCORES = ("success", "efficiency", "self_correction")
#: Keys that act on a page element, and the call each makes; fixed values.
ON_ELEMENT = ("click", "hover", "fill", "select_option", "set_checked")


def _load(text: str | None) -> dict | None:
    try:
        got = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def judgment(text: str | None) -> tuple[float, float, float] | None:
    """The three scores, all present and numbers (true counts as 1); else None."""
    d = _load(text)
    if d is None:
        return None
    values = [d.get(k) for k in SCORES]
    return tuple(map(float, values)) if all(isinstance(v, (int, float)) for v in values) else None


def proposal(text: str | None) -> tuple[str, list[str], list[str]] | None:
    """A task of at least one character with non-empty steps and criteria; else None."""
    d = _load(text)
    if d is None:
        return None
    task, steps, criteria = d.get("proposed_task"), d.get("steps"), d.get("criteria")
    if not (isinstance(task, str) and task and isinstance(steps, list) and steps and isinstance(criteria, list) and criteria):
        return None
    return task, [str(x) for x in steps], [str(x) for x in criteria]


def calls(text: str | None) -> list[tuple[str, str]] | None:
    """Function calls of an action; None where it cannot be read, has arguments of the wrong kind, or makes no call.

    An argument that is absent is printed as the parser's null, as agents were trained on.
    """
    d = _load(text)
    if d is None:
        return None
    key, args, target = d.get("action_key"), d.get("action_kwargs"), d.get("target_element_id")
    out = [("page.locator", f"\"[backend_node_id='{target}']\"")] if target is not None and key in ON_ELEMENT else []
    try:
        if key == "click" and "x" in args and "y" in args:
            out.append(("page.mouse.click", f"{args['x']},{args['y']}"))
        elif key == "scroll":
            out.append(("page.mouse.wheel", f"{args.get('delta_x', 0)},{args.get('delta_y', 0)}"))
        elif key == "goto":
            out.append(("page.goto", f"'{args.get('url')}'"))
        elif key == "stop":
            out.append(("stop", str(args.get("answer"))))
        elif key in ("go_back", "go_forward"):
            out.append(("page.goBack" if key == "go_back" else "page.goForward", ""))
        elif out and key == "click":
            out.append(("click", "{ force: true }"))
        elif out and key == "hover":
            out.append(("hover", ""))
        elif out and key == "fill":
            out.append(("fill", f"'{args.get('value')}'"))
        elif out and key == "select_option":
            out.append(("selectOption", f"'{args.get('label')}'"))
        elif out and key == "set_checked":
            out.append(("setChecked", "true" if args.get("checked") else "false"))
    except (AttributeError, TypeError):
        return None
    return out or None


def keyed(text: str | None) -> tuple[str, str, str] | None:
    """The three keys of an action that makes a call, each as JSON text in its own order; None where one is absent."""
    d = _load(text)
    if d is None or calls(text) is None or not {"action_key", "target_element_id", "action_kwargs"} <= d.keys():
        return None
    return json.dumps(d["action_key"]), json.dumps(d["target_element_id"]), json.dumps(d["action_kwargs"])


def _apply(df: DataFrame, key: str, fields: list[tuple[str, str, pa.DataType]], read) -> DataFrame:
    """(key, parsed_ok, fields…) of ``df`` (key, response)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(t) for t in b.column(1).to_pylist()]
            cols = {key: b.column(0), "parsed_ok": pa.array([g is not None for g in got])}
            for i, (name, _, kind) in enumerate(fields):
                cols[name] = pa.array([None if g is None else g[i] for g in got], kind)
            yield pa.record_batch(cols)

    schema = f"{key} {dict(df.dtypes)[key]}, parsed_ok boolean, " + ", ".join(f"{n} {t}" for n, t, _ in fields)
    return df.select(key, fenced_json(F.col("response")).alias("block")).mapInArrow(run, schema)


def parse_judgments(df: DataFrame, key: str = "judgment_id") -> DataFrame:
    return _apply(df, key, [(k, "double", pa.float64()) for k in SCORES], judgment)


def parse_proposals(df: DataFrame, key: str = "proposal_id") -> DataFrame:
    return _apply(df, key, [("proposed_task", "string", pa.string()), ("steps", "array<string>", pa.list_(pa.string())), ("criteria", "array<string>", pa.list_(pa.string()))], proposal)


def parse_actions(df: DataFrame, key: str = "action_id") -> DataFrame:
    kind = pa.list_(pa.struct([("dotpath", pa.string()), ("args", pa.string())]))

    def read(text: str | None) -> tuple | None:
        got = calls(text)
        return None if got is None else ([{"dotpath": a, "args": b} for a, b in got],)

    return _apply(df, key, [("function_calls", "array<struct<dotpath:string,args:string>>", kind)], read)


def action_keys(df: DataFrame, key: str = "action_id") -> DataFrame:
    """(key, ok, action_key, target_element_id, action_kwargs) as JSON texts, null where the response makes no call or lacks a key."""
    out = _apply(df, key, [(k, "string", pa.string()) for k in ("action_key", "target_element_id", "action_kwargs")], keyed)
    return out.withColumnRenamed("parsed_ok", "ok")


def parse_objects(df: DataFrame, key: str = "action_id") -> DataFrame:
    """(key, parsed_ok, object): the fenced JSON object of a response as text, whatever its keys."""
    return _apply(df, key, [("object", "string", pa.string())], lambda t: None if (d := _load(t)) is None else (json.dumps(d),))
