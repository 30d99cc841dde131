"""Schemas read from records, and what a record breaks of them (relational form).

A schema is a table (label, kind, required): kinds met at a label, and whether every parent object has it. For one
record and its answer, ``json_schema`` and ``problems`` do the same as JSON Schema documents, inside a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import jsonx


def infer(nodes: DataFrame) -> DataFrame:
    """(label, kinds, required) over node rows (doc, node, parent, parent_label, label, kind).

    ``parent`` names the enclosing object; elements of an array share one label. A label is required if it
    occurs in every object at its parent label.
    """
    objects = nodes.where("kind = 'object'").groupBy(F.col("label").alias("parent_label")).agg(F.count("*").alias("n_parents"))
    seen = nodes.where("label <> ''").groupBy("parent_label", "label").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_distinct("doc", "parent").alias("n"))
    return seen.join(objects, "parent_label").select("label", "kinds", (F.col("n") == F.col("n_parents")).alias("required"))


def violations(nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """(doc, location, label, problem): required labels missing in an object, and kinds the schema lacks."""
    want = schema.where("required").select("label", F.regexp_replace("label", r"\.?[^.]*$", "").alias("parent_label"))
    objects = nodes.where("kind = 'object'").select("doc", F.col("node").alias("parent"), F.col("label").alias("parent_label"), F.col("path").alias("location"))
    have = nodes.select("doc", "parent", "label").distinct()
    missing = objects.join(want, "parent_label").join(have, ["doc", "parent", "label"], "left_anti").select("doc", F.expr("coalesce(nullif(location, ''), 'root')").alias("location"), "label", F.lit("missing").alias("problem"))
    wrong = nodes.where("label <> ''").join(schema.select("label", "kinds"), "label").where(~F.array_contains("kinds", F.col("kind"))).select("doc", F.col("path").alias("location"), "label", F.concat(F.lit("kind "), F.col("kind")).alias("problem"))
    return missing.unionByName(wrong)


# --- one record: JSON Schema as a document ---------------------------------------------------------------------

_NAMES = {str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null", dict: "object", list: "array"}


def json_schema(value: Any) -> dict:
    """The JSON Schema that a record follows: objects with properties and the keys all of them have as required,
    arrays with one schema for all elements, several types side by side."""
    return {"$schema": "http://json-schema.org/schema#", **_schema_of([value])}


def _schema_of(values: list) -> dict:
    """One schema for all the values."""
    kinds: dict[str, list] = {}
    for v in values:
        kinds.setdefault(_NAMES[type(v)], []).append(v)
    if "number" in kinds and "integer" in kinds:
        kinds["number"] += kinds.pop("integer")
    plain = sorted(k for k in kinds if k not in ("object", "array"))
    parts: list[dict] = []
    if plain:
        parts.append({"type": plain[0] if len(plain) == 1 else plain})
    if "array" in kinds:
        inner = [x for v in kinds["array"] for x in v]
        parts.append({"type": "array", "items": _schema_of(inner)} if inner else {"type": "array"})
    if "object" in kinds:
        objects = kinds["object"]
        keys = list(dict.fromkeys(k for o in objects for k in o))
        part: dict = {"type": "object"}
        if keys:
            part["properties"] = {k: _schema_of([o[k] for o in objects if k in o]) for k in keys}
        if required := sorted(k for k in keys if all(k in o for o in objects)):
            part["required"] = required
        parts.append(part)
    return parts[0] if len(parts) == 1 else {"anyOf": parts} if parts else {}


def _is(value: Any, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return _NAMES[type(value)] == kind


def problems(value: Any, schema: dict) -> list[tuple[tuple, str]]:
    """(path, message) of everything in which the value breaks the schema, by path."""
    out: list[tuple[tuple, str]] = []
    todo: list[tuple[tuple, Any, dict]] = [((), value, schema)]
    while todo:
        at, v, s = todo.pop()
        if "anyOf" in s:
            if all(problems(v, x) for x in s["anyOf"]):
                out.append((at, f"{v!r} is not valid under any of the given schemas"))
            continue
        kinds = s.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and not any(_is(v, k) for k in kinds):
            out.append((at, f"{v!r} is not of type {', '.join(map(repr, kinds))}"))
            continue
        if isinstance(v, dict):
            out += [(at, f"{k!r} is a required property") for k in s.get("required", []) if k not in v]
            todo += [((*at, k), x, s["properties"][k]) for k, x in v.items() if k in s.get("properties", {})]
        elif isinstance(v, list) and "items" in s:
            todo += [((*at, i), x, s["items"]) for i, x in enumerate(v)]
    return sorted(out, key=lambda e: [(isinstance(x, str), str(x) if isinstance(x, str) else f"{x:09d}") for x in e[0]])


def validate(value: Any, schema: dict) -> None:
    """ValueError that names everything in which the value breaks the schema; the place is a dotted path, or 'root'."""
    if found := problems(value, schema):
        raise ValueError("Schema validation failed:\n" + "\n".join(f"  - {'.'.join(map(str, at)) or 'root'}: {said}" for at, said in found))


def answer_problems(pairs: DataFrame, keys: list[str], record: str, answer: str) -> DataFrame:
    """(keys..., location, message): what each answer breaks of the schema of its own record.

    pairs: one row per answer with the two JSON texts; answers are read as models write them, the reserved key
    ``_metadata`` aside. A null or unreadable answer is one row of location 'root'; a null record gives no rows.
    """
    kinds = [pairs.schema[k].dataType.simpleString() for k in keys]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            where: list[str] = []
            said: list[str] = []
            for i, (x, y) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                truth = jsonx.read_document(x)
                if truth is None:
                    continue
                got = jsonx.read_document(y)
                if isinstance(got, dict):
                    got.pop("_metadata", None)
                found = [((), "no complete JSON")] if got is None else problems(got, json_schema(truth))
                at += [i] * len(found)
                where += [".".join(map(str, p)) or "root" for p, _ in found]
                said += [m for _, m in found]
            held = b.select(list(range(len(keys)))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(where, pa.string()), pa.array(said, pa.string())], names=[*keys, "location", "message"])

    out = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), "location string, message string"])
    return pairs.select(*keys, F.col(record).cast("string"), F.col(answer).cast("string")).mapInArrow(read, out)
