"""One row per key for rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep the earliest delivery of each key.

    Rows whose key has a null in it cannot be told apart and are all kept. Ties in ``order`` are
    broken by the remaining columns' hash, so equal rows count once whatever the partitioning.
    An empty table stays empty; columns of any other name are passed through.
    """
    rn = "__delivery"
    while rn in df.columns:
        rn += "_"
    by = [F.col(f"`{c}`").asc_nulls_last() for c in order if c in df.columns]
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in key]).orderBy(*by, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    known = F.lit(True)
    for c in key:
        known = known & F.col(f"`{c}`").isNotNull()
    return df.withColumn(rn, F.when(known, F.row_number().over(w)).otherwise(1)).where(F.col(rn) == 1).drop(rn)
