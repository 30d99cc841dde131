"""Precision, recall and F1 from judged leaves; report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.text import clean_cell


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds evaluated, precision, recall, f1; 0.0 where a denominator is 0."""
    c, i, n = F.col("correct"), F.col("incorrect"), F.col("not_extracted")
    d = counts.withColumn("evaluated", c + i).withColumn("precision", ratio(c, c + i)).withColumn("recall", ratio(c, c + i + n))
    return d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _number(rows: DataFrame, of: Column) -> Column:
    """How many rows there are ``of``; rows with a column ``leaves`` stand for as many."""
    return F.sum(F.when(of, F.col("leaves")).otherwise(F.lit(0).cast("bigint"))) if "leaves" in rows.columns else F.count_if(of)


def count_status(details: DataFrame, by: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    return details.groupBy(*by).agg(*[_number(details, F.col("status") == s).alias(s) for s in ("correct", "incorrect", "not_extracted", *more)])


def metrics(details: DataFrame, by: list[str]) -> DataFrame:
    return with_scores(count_status(details, by))


def overall(details: DataFrame, files: DataFrame, run: list[str]) -> DataFrame:
    """Micro metrics per run over all its files; files: (run, doc, retry_count), also those without details."""
    each = F.col("leaves") if "leaves" in files.columns else F.lit(1).cast("bigint")
    f = files.groupBy(*run).agg(F.sum(each).alias("files"), F.sum(F.col("retry_count") * each).alias("total_retries"), _number(files, F.col("retry_count") > 0).alias("retried_files"))
    j = f.join(count_status(details, run), run, "left").na.fill(0, ["correct", "incorrect", "not_extracted"])
    return with_scores(j)


def sections(details: DataFrame, run: list[str]) -> DataFrame:
    """Metrics by top section and by section in one scan: (run, level, section, ...)."""
    more = ["leaves"] if "leaves" in details.columns else []
    two = details.select(*run, "status", *more, F.explode(F.array(F.struct(F.lit("top").alias("level"), F.col("top_section").alias("name")), F.struct(F.lit("sub").alias("level"), F.col("section").alias("name")))).alias("x"))
    return metrics(two.select(*run, "status", *more, F.col("x.level").alias("level"), F.col("x.name").alias("section")), [*run, "level", "section"])


def precision_pivot(details: DataFrame, run: list[str], runs: list[str]) -> DataFrame:
    """section x run precision; a section a run lacks is null. ``runs`` are the column names in order."""
    m = metrics(details, [*run, "section"]).withColumn("run", F.concat_ws("_", *run))
    return m.groupBy("section").pivot("run", runs).agg(F.first("precision"))


def failed_patterns(details: DataFrame, run: list[str], drop: float = 0.2, limit: int = 10, sums: DataFrame | None = None) -> DataFrame:
    """The first incorrect leaves of sections whose precision lies more than ``drop`` under the run's.

    With ``sums``, counted leaves, precisions are theirs, and ``details`` need only hold the first incorrect leaves of each section.
    """
    sums = details if sums is None else sums
    o = metrics(sums, run).select(*run, F.col("precision").alias("__all"))
    low = metrics(sums, [*run, "section"]).where("evaluated > 0").join(o, run).where(F.col("precision") < F.col("__all") - drop).select(*run, "section")
    w = Window.partitionBy(*run, "section").orderBy("doc", "pass", F.col("idx").asc_nulls_first(), "fno")
    bad = details.where("status = 'incorrect'").join(low, [*run, "section"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return bad.select(*run, "section", "rank", F.col("doc").alias("file"), "field", "error_type", clean_cell(F.col("xml")).alias("xml"), clean_cell(F.col("llm_value")).alias("llm_value"))


def error_breakdown(details: DataFrame, runs: DataFrame | None = None, known: list[str] | None = None) -> DataFrame:
    """Error kinds per (llm, parse_type), and per llm under the name 全体.

    ``runs``: (llm, parse_type) of all runs; one without errors, or without any details, has a row of zeros. With
    ``known`` other llms are left out, and ``llm_rank`` is the place of the llm in that list.
    """
    kinds = ("false_positive", "partial_match", "wrong_value")
    wrong = F.col("status") == "incorrect"
    per_run = details.groupBy("llm", "parse_type").agg(*[_number(details, wrong & (F.col("error_type") == k)).alias(k) for k in kinds])
    if runs is not None:
        per_run = runs.select("llm", "parse_type").distinct().join(per_run, ["llm", "parse_type"], "left").na.fill(0, list(kinds))
    if known is not None:
        per_run = per_run.where(F.col("llm").isin(known))
    g = per_run.groupingSets([["llm", "parse_type"], ["llm"]], "llm", "parse_type").agg(F.grouping("parse_type").alias("g"), *[F.sum(k).alias(k) for k in kinds])
    total = sum(F.col(k) for k in kinds)
    both = F.col("partial_match") + F.col("wrong_value")
    rank = [] if known is None else [F.array_position(F.array(*map(F.lit, known)), F.col("llm")).alias("llm_rank")]
    return g.select(
        "llm", F.when(F.col("g") == 1, "全体").otherwise(F.col("parse_type")).alias("parse_type"), total.alias("total_incorrect"),
        F.col("false_positive").alias("false_positive_count"), both.alias("partial+wrong count"), F.col("partial_match").alias("partial_match_count"), F.col("wrong_value").alias("wrong_value_count"),
        ratio(F.col("false_positive"), total).alias("false_positive_ratio"), ratio(both, total).alias("partial+wrong ratio"),
        ratio(F.col("partial_match"), total).alias("partial_match_ratio"), ratio(F.col("wrong_value"), total).alias("wrong_value_ratio"), *rank,
    )
