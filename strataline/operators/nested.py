"""Deeply nested records as flat, related node tables.

Method: every node gets an interval label by depth-first traversal (``pre`` when it is entered, ``post``
when it is left). A node lies below another if its interval lies inside the other's; the parent link is
the nearest enclosing interval of an object. All of a record's nodes come from one pass over the record,
so no shuffle is needed to link them; tables per node type are filters over the node table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import jsonx

NODE_SCHEMA = (
    "rec_key string, pre int, post int, parent_pre int, depth int, label string, parent_path string, path string, "
    "kind string, fields map<string,string>"
)
_NODE_ARROW = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
_NODE_NAMES = ["rec_key", "pre", "post", "parent_pre", "depth", "label", "parent_path", "path", "kind", "fields"]


def _array_labels(doc: Any) -> set[str]:
    """Labels at which the record has an array with an object in it."""
    out: set[str] = set()
    stack: list[tuple[str, Any]] = [("", doc)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, str):
            v = jsonx.open_string(v)
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in v.items() if isinstance(x, (dict, list, str)))
        elif isinstance(v, list):
            inner = [jsonx.open_string(x) if isinstance(x, str) else x for x in v]
            if path and any(isinstance(x, dict) for x in inner):
                out.add(path)
            stack.extend((path, x) for x in inner if isinstance(x, (dict, list)))
    return out


def array_label_table(records: DataFrame, data: str) -> DataFrame:
    """(label): labels that hold an array of objects in at least one record of the table, each once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[str] = set()
            for d in b.column(0).to_pylist():
                doc = jsonx.read_document(d)
                if doc is not None:
                    found |= _array_labels(doc)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["label"])

    return records.select(F.col(data).cast("string")).mapInArrow(read, "label string").distinct()


def array_labels(records: DataFrame, data: str) -> set[str]:
    """The labels of ``array_label_table`` as a set: one per distinct label of the schema."""
    return {r["label"] for r in array_label_table(records, data).collect()}


def label_nodes(doc: Any, arrays: set[str], leaves: bool = False, elements: bool = False) -> list[tuple]:
    """(pre, post, label, path, kind, fields) of a record's nodes: objects; with ``elements`` also the
    scalars in arrays, which no object's ``fields`` hold; with ``leaves`` every scalar.

    The root is the first row (empty label and path). An object alone where the table has arrays of
    objects is element [0]. ``fields`` holds an object's own scalars as text, a leaf's value under ''.
    Nodes still open stand on a list, so a record may be nested to any depth.
    """
    out: list[list] = []
    clock = 0
    opened = jsonx.open_string
    todo: list = [("", "", doc, False)]
    if isinstance(doc, list):  # the root is an object all the same
        root = [0, -1, "", "", "object", {}]
        out.append(root)
        clock = 1
        todo = [root, *todo]
    while todo:
        at = todo.pop()
        if type(at) is list:  # an object is left
            at[1] = clock
            clock += 1
            continue
        label, path, v, numbered = at
        if type(v) is dict:
            if path and not numbered and label in arrays:
                path += "[0]"
            fields: dict = {}
            below = []
            for k, x in v.items():
                if type(x) is str:
                    x = opened(x)
                if type(x) is dict or type(x) is list:
                    below.append((f"{label}.{k}" if label else k, f"{path}.{k}" if path else k, x, False))
                else:
                    fields[k] = jsonx.scalar_text(x)
                    if leaves:
                        below.append((f"{label}.{k}" if label else k, f"{path}.{k}" if path else k, x, False))
            row = [clock, -1, label, path, "object", fields]
            clock += 1
            out.append(row)
            todo.append(row)
            below.reverse()
            todo.extend(below)
        elif type(v) is list:
            inner = []
            for i, x in enumerate(v):
                if type(x) is str:
                    x = opened(x)
                if leaves or elements or type(x) is dict or type(x) is list:
                    inner.append((label, f"{path}[{i}]", x, True))
            inner.reverse()
            todo.extend(inner)
        else:
            out.append([clock, clock + 1, label, path, "leaf", {"": jsonx.scalar_text(v)}])
            clock += 2
    return out


def link_by_containment(nodes: list[tuple]) -> list[tuple[int, str, int] | None]:
    """For nodes in pre-order: (pre, path, depth) of the nearest enclosing object's interval, None for the root."""
    links: list[tuple[int, str, int] | None] = []
    open_: list[tuple] = []
    for pre, post, _, path, kind, _ in nodes:
        while open_ and open_[-1][1] < pre:
            open_.pop()
        top = open_[-1] if open_ else None
        links.append((top[0], top[2], len(open_)) if top else None)
        if kind == "object":
            open_.append((pre, post, path))
    return links


#: Array labels up to which they go to the workers as one set; more are looked up per record.
LABELS_AT_ONCE = 50_000


def _lone_labels(records: DataFrame, key: str, data: str, arrays: DataFrame) -> DataFrame:
    """``records`` with ``__arrays``: those of its labels of objects that are in ``arrays`` (label)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, x) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (doc := jsonx.read_document(d)) is not None for x in {n[2] for n in label_nodes(doc, set())}]
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], names=["__key", "label"])

    own = records.select(F.col(key).cast("string"), F.col(data).cast("string")).mapInArrow(read, "__key string, label string").distinct()
    held = own.join(arrays, "label", "left_semi").groupBy("__key").agg(F.collect_set("label").alias("__arrays"))
    return records.join(held, F.col(key).cast("string").eqNullSafe(F.col("__key")), "left").select(F.col(key), F.col(data), "__arrays")


def node_table(records: DataFrame, key: str, data: str, arrays: set[str] | DataFrame | None = None, leaves: bool = False, elements: bool = False) -> DataFrame:
    """All objects of all records as rows with interval labels and parent links.

    ``elements`` adds the scalars in arrays, so that fields and rows hold every value; ``leaves`` all scalars.
    ``arrays``: the array labels, as a set or, where there are very many, as a table (label); they are read from
    ``records`` if not given.

    Null, unreadable or cut-off data gives no rows; text around JSON is ignored, JSON inside strings is
    opened. The root row has a null ``parent_pre``. Keys are read as text; a null key stays null. Records
    of the same key are labelled each for themselves.
    """
    if arrays is None:
        arrays = array_label_table(records, data)
    if isinstance(arrays, DataFrame):
        some = arrays.limit(LABELS_AT_ONCE + 1).collect()
        if len(some) > LABELS_AT_ONCE:
            records = _lone_labels(records, key, data, arrays)
        else:
            arrays = {r["label"] for r in some}
    known = arrays if isinstance(arrays, set) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []

            def held(n: int) -> pa.RecordBatch:
                cols = list(zip(*rows[:n], strict=True)) or [[]] * len(_NODE_NAMES)
                del rows[:n]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _NODE_ARROW, strict=True)], names=_NODE_NAMES)

            own = b.column(2).to_pylist() if known is None else [()] * len(b)
            for k, d, mine in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own, strict=True):
                doc = jsonx.read_document(d)
                if doc is None:
                    continue
                nodes = label_nodes(doc, set(mine or ()) if known is None else known, leaves, elements)
                for (pre, post, label, path, kind, fields), up in zip(nodes, link_by_containment(nodes), strict=True):
                    rows.append((k, pre, post, up and up[0], up[2] if up else 0, label, up[1] if up else None, path, kind, list(fields.items())))
                while len(rows) >= 20_000:  # a batch of records has a hundred times as many nodes
                    yield held(20_000)
            yield held(len(rows))

    more = [] if known is not None else ["__arrays"]
    return records.select(F.col(key).cast("string"), F.col(data).cast("string"), *more).mapInArrow(read, NODE_SCHEMA)


def tables_by_label(nodes: DataFrame, labels: list[str]) -> dict[str, DataFrame]:
    """One flat table per node type; rows of a child table name their parent row by (rec_key, parent_pre)."""
    return {x: nodes.where(F.col("label") == x).drop("label") for x in labels}


def below(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(rec_key, ancestor_pre, pre) for every node inside the interval of an ancestor row of the same record."""
    a = ancestors.select("rec_key", F.col("pre").alias("ancestor_pre"), F.col("post").alias("__post"))
    inside = (F.col("pre") > F.col("ancestor_pre")) & (F.col("post") < F.col("__post"))
    return nodes.join(a, "rec_key").where(inside).select("rec_key", "ancestor_pre", "pre")
