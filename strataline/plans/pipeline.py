"""From folders to reports: labels, judging, evaluations and report tables of every run in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import paths
from strataline.operators import documents, evaluations
from strataline.session import cut
from strataline.sources import files

RUN = ["llm", "parse_type"]
# Llms in the order of the error table.
KNOWN_LLMS = ["gemini", "gemini-3-flash", "gemini-3.1-pro", "claude", "gpt5.4"]


def label_universe(results: DataFrame) -> DataFrame:
    """(label): every index-free leaf label of all results, each once. A string is a leaf whatever it holds; empty objects and arrays have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[str] = set()
            for d in b.column(0).to_pylist():
                try:
                    doc = documents.read_prediction(d)
                except ValueError:
                    continue
                found |= {documents.path_of(at) for at, v in documents.nodes_of(doc).items() if at and not isinstance(v, (dict, list))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["path"])

    leaves = results.select(F.col("data").cast("string")).mapInArrow(read, "path string").distinct()
    return leaves.select(paths.strip_indices(F.col("path")).alias("label")).distinct()


def judged(results: DataFrame, truth: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Details of all runs. Results without truth are left out; truth without a result is not asked for.

    ``labels`` (label) of all runs, those of ``results`` if not given: what is not extracted or not in the truth
    counts only under a label that some run predicts. Strings are compared as they are, not opened.
    """
    labels = label_universe(results) if labels is None else labels
    pairs = results.join(truth.select("file", "record"), "file")
    d = documents.judge_documents(pairs, [*RUN, "file"], "record", "data", opened=False)
    known = labels.select("label").distinct().withColumn("__known", F.lit(True))
    asked = (F.col("status") == "not_extracted") | F.coalesce(F.col("error_type") == "false_positive", F.lit(False))
    d = d.withColumn("label", paths.strip_indices(F.col("field"))).join(known, "label", "left").where(F.col("__known") | ~asked).drop("label", "__known")
    return d.withColumnRenamed("file", "doc").withColumn("idx", F.lit(None).cast("int")).withColumnRenamed("seq", "fno")


def evaluate(spark: SparkSession, root: str, llms: list[str] | None = None) -> dict[str, DataFrame]:
    """The evaluation of results_<llm>/<parse_type>/*.json under ``root`` against xml/*.xml. Labels come from all runs, whatever ``llms``."""
    everything = files.scan_results(spark, root)
    results = everything.where(F.col("llm").isin(llms)) if llms is not None else everything
    truth = files.scan_xml(spark, f"{root}/xml")
    d = cut(judged(results, truth, label_universe(everything)))
    done = results.join(truth.select("file"), "file", "left_semi").select(*RUN, F.col("file").alias("doc"), "retry_count")
    return evaluations.of_details(d, done, files.discover_runs(results))


def run(spark: SparkSession, root: str, out: str, llms: list[str] | None = None, reports: bool = True, skip_evaluate: bool = False, known: list[str] | None = None) -> dict[str, DataFrame]:
    """Judge the results under ``root``, keep the evaluation under ``out``/evaluations, write TSV reports to ``out``.

    With ``skip_evaluate`` the evaluation kept there is read again, or, if there is none, the documents
    evaluations_<llm>/<parse_type>.json under ``root``.
    """
    kept = f"{out}/evaluations"
    if not skip_evaluate:
        evaluations.write(evaluate(spark, root, llms), kept)
        tables = evaluations.read(spark, kept, llms)
    elif files.exists(spark, kept):
        tables = evaluations.read(spark, kept, llms)
    else:
        tables = evaluations.scan_documents(spark, root, llms)
    names = [f"{r['llm']}_{r['parse_type']}" for r in tables["summary"].select(*RUN).distinct().orderBy(*RUN).collect()]
    done = evaluations.reports(tables, names, known)
    if reports:
        for name, t in done.items():
            files.write_tsv(t, f"{out}/{name}")
    return done
