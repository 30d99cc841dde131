"""Judging leaf tables: every truth leaf against its aligned prediction, every prediction against the truth.

Leaf tables have one row per leaf: (key columns..., doc, idx, rel, fno, value), ``idx`` null outside repeated
groups. Pass 1 follows the content alignment; pass 2 looks at the literal position. Both are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import paths, text
from strataline.operators.align import greedy_alignment


def with_norm(leaves: DataFrame, ascii_only: bool = False) -> DataFrame:
    return leaves.withColumn("norm", text.normal(F.coalesce("value", F.lit("")), ascii_only))


def field_path(idx: Column, rel: Column, root: str = "order", array: str = "lines") -> Column:
    return F.when(idx.isNull(), F.concat(F.lit(f"{root}."), rel)).otherwise(F.concat(F.lit(f"{root}.{array}["), idx.cast("string"), F.lit("]."), rel))


def status_of(truth_norm: Column, pred_norm: Column) -> tuple[Column, Column]:
    """(status, error_type) of a truth leaf whose normal form is not empty."""
    missing = F.coalesce(pred_norm, F.lit("")) == ""
    same = text.same_value(truth_norm, pred_norm)
    status = F.when(missing, "not_extracted").when(same, "correct").otherwise("incorrect")
    return status, F.when(~missing & ~same, text.error_kind(truth_norm, pred_norm))


def alignment(truth: DataFrame, pred: DataFrame, run: list[str]) -> DataFrame:
    """(run, doc, truth_idx, pred_idx) of the documents both sides have. truth has no run columns."""
    return greedy_alignment(truth, pred, ["doc"], run)


def positional(truth: DataFrame, pred: DataFrame, run: list[str]) -> DataFrame:
    """(run, doc, idx, rel, xml, llm_value): every truth leaf of an element with the prediction at the same place, null where there is none."""
    t = truth.where("idx is not null").select("doc", "idx", "rel", F.col("value").alias("xml"))
    return t.join(pred.select(*run, "doc", "idx", "rel", F.col("value").alias("llm_value")), ["doc", "idx", "rel"], "left").select(*run, "doc", "idx", "rel", "xml", "llm_value")


def truth_pass(truth: DataFrame, pred: DataFrame, pairs: DataFrame, run: list[str]) -> DataFrame:
    """Pass 1: one row per truth leaf with a non-empty normal form, for every run that has the document."""
    docs = pred.select(*run, "doc").distinct()
    t = truth.where("norm <> ''").join(docs, "doc").withColumnsRenamed({"norm": "t_norm", "value": "xml"})
    t = t.join(pairs.withColumnRenamed("truth_idx", "idx"), ["doc", "idx", *run], "left")
    # -1 stands for "outside repeated groups" so that the leaf join stays an equi-join; -2 matches nothing
    at = F.when(F.col("idx").isNull(), -1).otherwise(F.coalesce("pred_idx", F.lit(-2)))
    p = pred.select(*run, "doc", F.coalesce("idx", F.lit(-1)).alias("__at"), "rel", F.col("norm").alias("p_norm"), F.col("value").alias("llm_value"))
    j = t.withColumn("__at", at).join(p, ["doc", "__at", "rel", *run], "left")
    status, kind = status_of(F.col("t_norm"), F.col("p_norm"))
    return j.select(*run, "doc", F.lit(1).alias("pass"), "idx", "fno", "rel", status.alias("status"), kind.alias("error_type"), "xml", F.when(status == "not_extracted", "").otherwise(F.col("llm_value")).alias("llm_value"))


def prediction_pass(truth: DataFrame, pred: DataFrame, run: list[str]) -> DataFrame:
    """Pass 2: predicted leaves with a non-empty normal form and no non-empty truth at the same place."""
    t = truth.where("norm <> ''").select("doc", F.coalesce("idx", F.lit(-1)).alias("__at"), "rel")
    known = truth.select("doc").distinct()
    p = pred.where("norm <> ''").withColumn("__at", F.coalesce("idx", F.lit(-1))).join(known, "doc")
    return p.join(t, ["doc", "__at", "rel"], "left_anti").select(
        *run, "doc", F.lit(2).alias("pass"), "idx", "fno", "rel", F.lit("incorrect").alias("status"), F.lit("false_positive").alias("error_type"), F.lit("").alias("xml"), F.col("value").alias("llm_value")
    )


def details(truth: DataFrame, pred: DataFrame, run: list[str], labels: DataFrame | None = None) -> DataFrame:
    """All judged leaves with field, section and top section.

    ``labels``: (label); not-extracted and false-positive rows whose label is in no prediction are left out.
    Documents without predictions in a run, and predictions without a truth document, give no rows.
    """
    pairs = alignment(truth, pred, run)
    rows = truth_pass(truth, pred, pairs, run).unionByName(prediction_pass(truth, pred, run))
    rows = rows.withColumn("field", field_path(F.col("idx"), F.col("rel")))
    if labels is not None:
        asked = F.col("status").isin("not_extracted") | (F.col("error_type") == "false_positive")
        known = labels.select("label").distinct().withColumn("__known", F.lit(True))
        rows = rows.withColumn("label", paths.strip_indices(F.col("field"))).join(known, "label", "left").where(F.col("__known") | ~F.coalesce(asked, F.lit(False))).drop("label", "__known")
    return rows.select(*run, "doc", "pass", "idx", "fno", "field", paths.section(F.col("field")).alias("section"), paths.top_section(F.col("field")).alias("top_section"), "status", "error_type", "xml", "llm_value")
