"""Judging whole nested documents: truth and prediction as JSON text, one pair per row.

A document is judged where it lies: nodes of both sides are addressed by their steps (keys and numbers),
arrays are aligned level by level by rewriting truth prefixes to prediction prefixes, and the two passes are
look-ups by steps. Documents never meet each other, so nothing is shuffled beyond the pairing itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import jsonx
from strataline.functions.text import normal_form

Steps = tuple[str | int, ...]

_FLOAT = re.compile(r"[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[+-]?inf(inity)?", re.I)
_INDEX = re.compile(r"\[\d+\]\.?")
_PART = re.compile(r"[.\[]")


def shown(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def path_of(steps: Steps) -> str:
    out = ""
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else f".{s}" if out else s
    return out


def nodes_of(doc: Any) -> dict[Steps, Any]:
    """All nodes by their steps, in document order; containers hold themselves."""
    out: dict[Steps, Any] = {}
    stack: list[tuple[Steps, Any]] = [((), doc)]
    while stack:
        at, v = stack.pop()
        out[at] = v
        if isinstance(v, dict):
            stack.extend((at + (k,), x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((at + (i,), x) for i, x in reversed(list(enumerate(v))))
    return out


def read_prediction(text: str | None) -> Any:
    """What a model's answer holds; ValueError if there is no complete JSON in it."""
    got = jsonx.read_document(text)
    return json.loads(text or "") if got is None else got


def open_strings(pred: Any, truth: Any) -> Any:
    """``pred`` with JSON inside strings opened, except where the truth has a value in the same place of its own."""
    held = [pred]
    values: set[Steps] | None = None
    stack: list[tuple[Steps, Any, Any]] = [((), held, 0)]
    while stack:
        at, holder, k = stack.pop()
        v = holder[k]
        if isinstance(v, str) and (got := jsonx.open_string(v)) is not v:
            if values is None:  # element numbers count as one
                values = {tuple(0 if isinstance(s, int) else s for s in p) for p, x in nodes_of(truth).items() if not isinstance(x, (dict, list)) and x not in (None, "")}
            if at not in values:
                v = holder[k] = got
        if isinstance(v, dict):
            stack.extend((at + (x,), v, x) for x in v)
        elif isinstance(v, list):
            stack.extend((at + (0,), v, x) for x in range(len(v)))
    return held[0]


def _leaf_norms(item: dict) -> dict[Steps, str]:
    return {at: n for at, v in nodes_of(item).items() if not isinstance(v, (dict, list)) and (n := normal_form(shown(v)))}


def element_pairs(truth: list, pred: list) -> dict[int, int]:
    """truth element -> predicted element. Groups pair by most equal leaves (first come, lowest number on ties), other arrays by place."""
    if not all(isinstance(x, dict) for x in truth):
        return {i: i for i in range(min(len(truth), len(pred)))}
    open_ = [(j, _leaf_norms(x)) for j, x in enumerate(pred) if isinstance(x, dict)]
    out: dict[int, int] = {}
    for i, x in enumerate(truth):
        leaves = _leaf_norms(x).items()
        score, at = max(((len(leaves & other.items()), -n) for n, (_, other) in enumerate(open_)), default=(0, 0))
        if score:
            out[i] = open_.pop(-at)[0]
    return out


def images(truth: dict[Steps, Any], pred: dict[Steps, Any]) -> dict[Steps, Steps | None]:
    """Truth steps -> steps of the aligned prediction node, None where the prediction has no such place."""
    to: dict[Steps, Steps | None] = {(): ()}
    pairs: dict[Steps, dict[int, int]] = {}
    for at, v in truth.items():
        if at:
            up = to[at[:-1]]
            if up is None:
                here = None
            elif isinstance(at[-1], int):
                j = pairs[at[:-1]].get(at[-1])
                here = None if j is None else up + (j,)
            else:
                here = up + (at[-1],) if isinstance(pred.get(up), dict) and up + (at[-1],) in pred else None
            to[at] = here
        if isinstance(v, list):
            other = pred.get(to[at]) if to[at] is not None else None
            pairs[at] = element_pairs(v, other if isinstance(other, list) else [])
    return to


def same_value(a: str, b: str) -> bool:
    if a == b:
        return True
    return bool(_FLOAT.fullmatch(a) and _FLOAT.fullmatch(b) and float(a) == float(b))


def judge(truth: Any, pred: Any, labels: frozenset[str] | None = None) -> list[tuple]:
    """(pass, seq, field, status, error_type, xml, llm_value) of a pair of documents, in order."""
    t, p = nodes_of(truth), nodes_of(pred)
    to = images(t, p)
    rows: list[tuple] = []

    def wanted(field: str) -> bool:
        return labels is None or _INDEX.sub(".", field).rstrip(".") in labels

    for at, v in t.items():
        if isinstance(v, (dict, list)) or not at:
            continue
        a = normal_form(shown(v))
        if not a:
            continue
        got = shown(p[to[at]]) if to[at] is not None and to[at] in p else ""
        b = normal_form(got)
        field = path_of(at)
        if not b:
            if wanted(field):
                rows.append((1, len(rows), field, "not_extracted", None, shown(v), ""))
        elif same_value(a, b):
            rows.append((1, len(rows), field, "correct", None, shown(v), got))
        else:
            rows.append((1, len(rows), field, "incorrect", "partial_match" if a in b or b in a else "wrong_value", shown(v), got))
    for at, v in p.items():
        if isinstance(v, (dict, list)) or not at or not normal_form(shown(v)):
            continue
        if at in t and normal_form(shown(t[at])):
            continue
        field = path_of(at)
        if wanted(field):
            rows.append((2, len(rows), field, "incorrect", "false_positive", "", shown(v)))
    return rows


def judge_documents(pairs: DataFrame, keys: list[str], truth: str, pred: str, labels: list[str] | None = None, unreadable: bool = False, opened: bool = True) -> DataFrame:
    """(keys..., retry_count, pass, seq, field, section, top_section, status, error_type, xml, llm_value).

    pairs: one row per document and run with the two JSON texts. Predictions are read as models write them
    (fences and text around JSON, JSON inside strings if ``opened``); the reserved key ``_metadata`` is taken off first.
    Rows with a null or unreadable side give no leaves; with ``unreadable``, each whose prediction is null,
    cut off or holds no JSON gives one row of that status (pass 0, empty field).
    """
    known = frozenset(labels) if labels is not None else None
    types = [pairs.schema[k].dataType.simpleString() for k in keys]
    names = ["pass", "seq", "field", "section", "top_section", "status", "error_type", "xml", "llm_value"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def judged(b: pa.RecordBatch = b, at: list[int] = at, rows: list[tuple] = rows) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                held = b.select(list(range(len(keys)))).take(pa.array(at, pa.int64()))
                kinds = [pa.int32(), pa.int32(), *[pa.string()] * 7]
                got = pa.RecordBatch.from_arrays([*held.columns, *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=[*keys, *names])
                at.clear()
                rows.clear()
                return got

            for i, (x, y) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                try:
                    a = json.loads(x or "")
                except ValueError:
                    continue
                try:
                    c = open_strings(read_prediction(y), a) if opened else read_prediction(y)
                except (ValueError, RecursionError):
                    if unreadable:
                        rows.append((0, 0, "", "", "", "unreadable", None, None, None))
                        at.append(i)
                    continue
                if isinstance(c, dict):
                    c.pop("_metadata", None)
                for r in judge(a, c, known):
                    parts = _PART.split(r[2])
                    rows.append((r[0], r[1], r[2], ".".join(parts[:2]), parts[0], *r[3:]))
                    at.append(i)
                if len(rows) >= 20_000:  # a batch of records has a hundred times as many leaves
                    yield judged()
            yield judged()

    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, types, strict=True)), "pass int, seq int, field string, section string, top_section string, status string, error_type string, xml string, llm_value string"])
    return pairs.select(*keys, F.col(truth).cast("string"), F.col(pred).cast("string")).mapInArrow(read, schema)
