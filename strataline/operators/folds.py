"""Folds over sorted groups: rows stream through a worker in order, and only a group's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch given back.
ROWS = 20_000


def fold(df: DataFrame, by: list[str], order: list[str], schema: str, start: Callable[[tuple], object], step: Callable[[object, tuple], list[tuple]], end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """Rows (by..., values of ``schema``) from the rows of every group of ``by`` in the order of ``order``.

    ``start`` makes a group's state from its key, ``step`` takes (state, row without the key) and gives rows to put
    out, ``end`` gives rows when the group is over. ``df`` has the key columns first. Groups never lie in memory: a
    group of any share of all rows costs its worker the state only. Null keys are groups of their own.
    """
    rest = [c for c in df.columns if c not in by]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    full = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), schema])
    spark = df.sparkSession
    arrow = _arrow(spark, full)
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key: tuple | None = None
        state = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != key:
                    if key is not None and end:
                        out += [key + r for r in end(state)]
                    key = row[:n]
                    state = start(key)
                out += [key + r for r in step(state, row[n:])]
            if len(out) >= ROWS:
                yield batch()
        if key is not None and end:
            out += [key + r for r in end(state)]
        yield batch()

    return df.select(*by, *rest).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, full)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)
