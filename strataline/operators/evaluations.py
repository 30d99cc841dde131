"""Evaluations of runs as tables that can be written, read again and reported from.

An evaluation is three tables: ``summary`` (llm, parse_type, totals and scores), ``sections`` (llm, parse_type,
level, section, counts, scores) and ``examples`` (llm, parse_type, place, file, field, section, error_type, xml,
llm_value), plus ``per_file``. All reports are made from these, whether they were judged now or read from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions import paths
from strataline.functions.text import clean_cell
from strataline.operators import metrics

RUN = ["llm", "parse_type"]
COUNTS = ["correct", "incorrect", "not_extracted"]
SCORES = ["evaluated", "precision", "recall", "f1"]
NAMES = ["summary", "sections", "examples", "per_file"]


def of_details(details: DataFrame, files: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The tables of judged leaves (llm, parse_type, doc, pass, fno, field, ...), judged files (llm, parse_type, doc, retry_count) and all runs."""
    none = metrics.overall(details, files, RUN)
    per_file = files.join(metrics.count_status(details, [*RUN, "doc"]), [*RUN, "doc"], "left").na.fill(0, COUNTS)
    wrong = details.where("status = 'incorrect'")
    place = F.struct(F.col("doc").cast("string").alias("doc"), F.col("pass").cast("int").alias("pass"), F.col("fno").cast("bigint").alias("at"))
    errors = details.where("status = 'incorrect'").groupBy(*RUN, "error_type").agg(F.count("*").alias("n")).groupBy(*RUN).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("error_type_totals"))
    zeros = ["files", *COUNTS, *SCORES, "total_retries", "retried_files"]
    return {
        "summary": runs.select(*RUN).distinct().join(none, RUN, "left").na.fill(0, zeros).join(errors, RUN, "left"),
        "sections": metrics.sections(details, RUN),
        "examples": wrong.select(*RUN, place.alias("place"), F.col("doc").cast("string").alias("file"), "field", "section", "error_type", "xml", "llm_value"),
        "per_file": metrics.with_scores(per_file).withColumnRenamed("doc", "file"),
    }


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """JSON lines under <folder>/<table>/llm=../parse_type=..; a run's examples may be many files."""
    for name in NAMES:
        tables[name].write.mode("overwrite").partitionBy(*RUN).json(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, llms: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables that ``write`` wrote, of all or of some llms."""
    kinds = {
        "summary": f"files bigint, {_COUNTED}, total_retries bigint, retried_files bigint, error_type_totals map<string,bigint>",
        "sections": f"level string, section string, {_COUNTED}",
        "examples": "place struct<doc:string,pass:int,at:bigint>, file string, field string, section string, error_type string, xml string, llm_value string",
        "per_file": f"file string, retry_count int, {_COUNTED}",
    }
    out = {}
    for name, kind in kinds.items():
        t = spark.read.schema(f"{kind}, llm string, parse_type string").json(f"{folder}/{name}")
        out[name] = t.where(F.col("llm").isin(llms)) if llms is not None else t
    return out


_COUNTED = "correct bigint, incorrect bigint, not_extracted bigint, evaluated bigint, precision double, recall double, f1 double"
_STATS = f"struct<{', '.join(x.replace(' ', ':') for x in _COUNTED.split(', '))}>"


def scan_documents(spark: SparkSession, root: str, llms: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of evaluations_<llm>/<parse_type>.json, one document for a run, as evaluation tools write them."""
    totals = "total_files bigint, total_correct bigint, total_incorrect bigint, total_not_extracted bigint, total_evaluated bigint, overall_precision double, overall_recall double, overall_f1 double, total_retries bigint, retried_files bigint, error_type_totals map<string,bigint>"
    nested = f"section_analysis struct<top:map<string,{_STATS}>,sub:map<string,{_STATS}>>, incorrect_examples array<struct<file:string,field:string,error_type:string,xml:string,llm:string>>, per_file array<struct<file:string,retry_count:int,{', '.join(x.replace(' ', ':') for x in _COUNTED.split(', '))}>>"
    d = spark.read.schema(f"{totals}, {nested}").option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{root}/evaluations_*")
    at = F.col("_metadata.file_path")
    d = d.withColumn("llm", F.regexp_extract(at, r"/evaluations_([^/]+)/[^/]+$", 1)).withColumn("parse_type", F.regexp_extract(at, r"/([^/]+)\.json$", 1))
    d = d.where(F.col("llm").isin(llms)) if llms is not None else d
    summary = d.select(
        *RUN, F.col("total_files").alias("files"), *[F.col(f"total_{c}").alias(c) for c in COUNTS], F.col("total_evaluated").alias("evaluated"), *[F.col(f"overall_{c}").alias(c) for c in SCORES[1:]],
        F.coalesce("total_retries", F.lit(0)).cast("bigint").alias("total_retries"), F.coalesce("retried_files", F.lit(0)).cast("bigint").alias("retried_files"), "error_type_totals",
    )
    level = lambda name: d.select(*RUN, F.lit(name).alias("level"), F.explode(f"section_analysis.{name}").alias("section", "s")).select(*RUN, "level", "section", *[F.col(f"s.{c}").alias(c) for c in COUNTS + SCORES])
    ex = d.select(*RUN, F.posexplode("incorrect_examples").alias("at", "e"))
    examples = ex.select(
        *RUN, F.struct(F.lit("").alias("doc"), F.lit(0).alias("pass"), F.col("at").cast("bigint").alias("at")).alias("place"), "e.file", "e.field", paths.section(F.col("e.field")).alias("section"), "e.error_type", "e.xml", F.col("e.llm").alias("llm_value")
    )
    return {"summary": summary, "sections": level("top").unionByName(level("sub")), "examples": examples, "per_file": d.select(*RUN, F.inline("per_file"))}


def reports(tables: dict[str, DataFrame], names: list[str], known: list[str] | None = None, drop: float = 0.2, limit: int = 10) -> dict[str, DataFrame]:
    """The report tables of an evaluation, in their order. ``names``: <llm>_<parse_type> of the runs, columns of the pivot.

    ``known``: llms in the order of the error table, which leaves out others; None keeps all by name.
    """
    summary, sub = tables["summary"], tables["sections"].where("level = 'sub'")
    low = sub.where("evaluated > 0").join(summary.select(*RUN, F.col("precision").alias("__all")), RUN).where(F.col("precision") < F.col("__all") - drop).select(*RUN, "section")
    w = Window.partitionBy(*RUN, "section").orderBy("place", "field")
    bad = tables["examples"].join(low, [*RUN, "section"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    marks = tables["examples"].withColumn("status", F.lit("incorrect"))
    errors = metrics.error_breakdown(marks, summary, known)
    rank = ["llm_rank"] if known is not None else []
    pivot = sub.withColumn("run", F.concat_ws("_", *RUN)).groupBy("section").pivot("run", names).agg(F.first("precision")) if names else sub.select("section").distinct()
    by_f1 = [F.desc("f1"), "llm", F.concat("parse_type", F.lit(".json"))]
    return {
        "overall": summary.select(*RUN, "files", *COUNTS, *SCORES, "total_retries", "retried_files").orderBy(*by_f1),
        "subsection": sub.select(*RUN, "section", *COUNTS, *SCORES).orderBy(F.desc("f1"), "section", *RUN),
        "detail": sub.select(*RUN, "section", *SCORES[1:], *COUNTS, "evaluated").orderBy(*RUN, "section"),
        "pivot": pivot.orderBy("section"),
        "failed_patterns": bad.select(*RUN, "section", "rank", "file", "field", "error_type", clean_cell(F.col("xml")).alias("xml"), clean_cell(F.col("llm_value")).alias("llm_value")).orderBy(*RUN, "section", "rank"),
        "error_types": errors.orderBy((F.col("parse_type") == "全体").cast("int"), *rank, *RUN).drop("llm_rank"),
    }


def sheet_format(names: list[str], llms: int) -> dict[str, dict]:
    """How the tabs of a workbook of the reports look: title, frozen rows and columns, columns with a gradient
    (from, to), percent columns, the column a filter sorts by (descending). Columns count from 0."""
    last = 1 + len(names)
    return {
        "overall": {"title": "Summary", "frozen_rows": 1, "frozen_cols": 2, "gradient_cols": [(2, 5)], "percent_cols": [2, 3, 4]},
        "detail": {"title": "Detail", "frozen_rows": 1, "frozen_cols": 0, "gradient_cols": [(3, 6)], "percent_cols": [3, 4, 5], "sort_col": 3},
        "pivot": {"title": "Precision", "frozen_rows": 1, "frozen_cols": 1, "gradient_cols": [(1, last)], "percent_cols": list(range(1, last))},
        "failed_patterns": {"title": "Failed Patterns", "frozen_rows": 1, "frozen_cols": 0},
        "error_types": {"title": "Error Types", "frozen_rows": 1, "frozen_cols": 0, "gradient_cols": [(3, 5)], "summary_gradient": (3, 5, llms), "percent_cols": [7, 8, 9, 10]},
    }
