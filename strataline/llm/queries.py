"""Queries of the operators for training text (problems 2, 4, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.llm import glyphs, leakage, linkage, mixing, quality
from strataline.llm.oracle_sql import ORACLE_SQL  # noqa: F401 - read by the entry
from strataline.operators.dedupe import first_delivery
from strataline.sources.tables import table


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "incorrect_examples").select("example_id", "xml", "llm", "loaded_at")
    return first_delivery(rows, ["example_id"], ["loaded_at"]).select("example_id", "xml", "llm")


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.link(table(spark, sf, "spt_logged"), table(spark, sf, "spt_extracted"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_links(spark, sf).select("spt_id", "ext_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.same_to_the_reader(_examples(spark, sf), "xml", "llm").select("example_id")


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.one_form(_examples(spark, sf), ["xml", "llm"])


def p6_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return leakage.leaks(docs, "doc_id", "text", table(spark, sf, "held_out_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_pairs(p6_runs(spark, sf))


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_documents(p6_runs(spark, sf))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tokens = mixing.count_tokens(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")
    return mixing.mix(tokens, table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_statistics(spark, sf).where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


QUERIES = {
    "p2_found": p2_found, "p2_links": p2_links,
    "p4_found": p4_found, "p4_forms": p4_forms,
    "p6_found": p6_found, "p6_runs": p6_runs, "p6_documents": p6_documents,
    "p7_mix": p7_mix, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_statistics": p8_statistics,
}

