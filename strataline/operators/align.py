"""Pairing the elements of repeated groups: greedy best overlap, one to one.

Scores come from an equi-join of leaves on (group, relative path, normal form), never from all pairs. The greedy
choice is a fold: over a group's score rows, or, without any rows for pairs, over its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.folds import fold


def overlap_scores(truth: DataFrame, pred: DataFrame, group: list[str]) -> DataFrame:
    """(group, truth_idx, pred_idx, score): equal, non-empty leaves that two elements share.

    truth, pred: (group..., idx, rel, norm), one row per leaf of an element. Pairs without an equal leaf
    have no row. Null or empty norms, and null indices, count for nothing.
    """
    t = truth.where("idx is not null and norm <> ''").select(*group, F.col("idx").alias("truth_idx"), "rel", "norm")
    p = pred.where("idx is not null and norm <> ''").select(*group, F.col("idx").alias("pred_idx"), "rel", "norm")
    return t.join(p, [*group, "rel", "norm"]).groupBy(*group, "truth_idx", "pred_idx").agg(F.count("*").alias("score"))


def greedy_pairs(scores: DataFrame, group: list[str]) -> DataFrame:
    """(group, truth_idx, pred_idx): every truth element in order takes the best free prediction.

    Equal scores go to the lowest prediction index; elements without a free overlapping prediction have no
    row. Score rows stream in order; held are the predictions that a group has given away.
    """
    rows = scores.select(*group, "truth_idx", (-F.col("score")).alias("__less"), "pred_idx")

    def take(state: dict, row: tuple) -> list[tuple]:
        truth, _, pred = row
        if truth == state["done"] or pred in state["used"]:
            return []
        state["done"] = truth
        state["used"].add(pred)
        return [(truth, pred)]

    return fold(rows, group, ["truth_idx", "__less", "pred_idx"], "truth_idx int, pred_idx int", lambda _: {"done": None, "used": set()}, take)


def greedy_alignment(truth: DataFrame, pred: DataFrame, doc: list[str], run: list[str]) -> DataFrame:
    """(doc, run, truth_idx, pred_idx): the same pairs straight from the leaves, for every run that has the document.

    truth: (doc..., idx, rel, norm), pred: (doc..., run..., idx, rel, norm). One shuffle of leaves, no row for a pair
    of elements and none for a truth leaf in another run: a leaf is a number (two leaves are equal if the hashes of
    their path and text are), a document's truth is held while its runs stream by. A value that all elements share
    costs no more rows than leaves.
    """
    code = F.xxhash64(*run)
    runs = pred.where("idx is not null").select(*run, code.alias("__run")).distinct()

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.where("idx is not null and norm <> ''").select(*doc, F.lit(n).cast("tinyint").alias("__side"), (code if n else F.lit(0).cast("bigint")).alias("__run"), F.col("idx").cast("int").alias("idx"), F.xxhash64("rel", "norm").alias("__leaf"))

    keys = {f.name: f.dataType.simpleString() for f in truth.schema.fields}
    schema = ", ".join([*(f"`{k}` {keys[k]}" for k in doc), "__run bigint, truth_idx int, pred_idx int"])
    n = len(doc)

    def pairs_of(elements: list[tuple[int, list[int]]], places: dict[int, list[int]]) -> Iterator[tuple[int, int]]:
        used: set[int] = set()
        for at, leaves in elements:
            score: dict[int, int] = {}
            for x in leaves:
                for j in places.get(x, ()):
                    if j not in used:
                        score[j] = score.get(j, 0) + 1
            if score:
                best = min(score, key=lambda j: (-score[j], j))
                used.add(best)
                yield at, best

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at: tuple | None = None
        elements: list[tuple[int, list[int]]] = []
        places: dict[int, list[int]] = {}
        now = None

        def done() -> None:
            if places and elements:
                out.extend((*at, now, i, j) for i, j in pairs_of(elements, places))

        kinds = None
        for b in batches:
            if kinds is None:
                kinds = [b.schema.field(i).type for i in range(n)] + [pa.int64(), pa.int32(), pa.int32()]
            docs = zip(*(b.column(i).to_pylist() for i in range(n)), strict=True)
            for d, s, r, i, x in zip(docs, *(b.column(n + c).to_numpy().tolist() for c in range(4)), strict=True):
                if d != at:
                    done()
                    at, elements, places, now = d, [], {}, None
                if s == 0:
                    if elements and elements[-1][0] == i:
                        elements[-1][1].append(x)
                    else:
                        elements.append((i, [x]))
                    continue
                if r != now:
                    done()
                    places, now = {}, r
                places.setdefault(x, []).append(i)
            if len(out) >= 20_000:
                yield batch(out, kinds)
        done()
        if kinds is not None:
            yield batch(out, kinds)

    def batch(out: list[tuple], kinds: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=[*doc, "__run", "truth_idx", "pred_idx"])

    both = side(truth, 0).unionByName(side(pred, 1)).repartition(*doc).sortWithinPartitions(*doc, "__side", "__run", "idx")
    return both.mapInArrow(match, schema).join(runs, "__run").select(*doc, *run, "truth_idx", "pred_idx")
