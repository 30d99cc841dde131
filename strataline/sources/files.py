"""Folders of records: XML truth, JSON results, position texts, test lists; and the sinks of reports."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.session import prepare

#: Later kinds win where a stem has several files.
TEXT_KINDS = ["md", "html", "txt"]


def element_value(e: ET.Element) -> Any:
    """Text of a leaf, object of a parent; a repeated tag becomes an array from the second on."""
    if len(e) == 0:
        return (e.text or "").strip()
    out: dict[str, Any] = {}
    many: set[str] = set()
    for child in e:
        v = element_value(child)
        if child.tag in many:
            out[child.tag].append(v)
        elif child.tag in out:
            out[child.tag] = [out[child.tag], v]
            many.add(child.tag)
        else:
            out[child.tag] = v
    return out


def xml_record(text: str | bytes) -> dict:
    """The record of an XML document, without its root tag. A root without children is an error."""
    root = ET.fromstring(text)
    if len(root) == 0:
        raise ValueError("the root element has no children")
    return element_value(root)


def _stem(c: str = "path"):
    return F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")


def scan_xml(spark: SparkSession, folder: str, mode: str = "fail") -> DataFrame:
    """(file, record JSON, error) of every .xml file. ``mode`` 'fail' raises on a bad file, 'keep' reports it."""
    prepare(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).select("path", "content")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((p, json.dumps(xml_record(bytes(c)), ensure_ascii=False), None))
                except (ET.ParseError, ValueError) as e:
                    if mode == "fail":
                        raise ValueError(f"{p}: {e}") from e
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "record", "error"])

    return raw.mapInPandas(read, "path string, record string, error string").select(_stem().alias("file"), "record", "error")


def scan_results(spark: SparkSession, root: str, llms: list[str] | None = None) -> DataFrame:
    """(llm, parse_type, file, data, retry_count) of results_<llm>/<parse_type>/<file>.json."""
    prepare(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/results_*/*")
    d = raw.select(
        F.regexp_extract("path", r"/results_([^/]+)/[^/]+/[^/]+$", 1).alias("llm"), F.regexp_extract("path", r"/results_[^/]+/([^/]+)/[^/]+$", 1).alias("parse_type"),
        _stem().alias("file"), F.decode("content", "UTF-8").alias("data"),
    )
    d = d.withColumn("retry_count", F.coalesce(F.get_json_object("data", "$._metadata.retry_count").try_cast("int"), F.lit(0)))
    return d.where(F.col("llm").isin(llms)) if llms is not None else d


def results_exist(spark: SparkSession, root: str) -> bool:
    """Is there any results folder under ``root``?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/results_*/*")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def discover_runs(results: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(llm, parse_type), each once, sorted; only known llms if given."""
    d = results.select("llm", "parse_type").distinct()
    d = d.where(F.col("llm").isin(known)) if known is not None else d
    return d.orderBy("llm", "parse_type")


def list_inputs(files: DataFrame, tests: DataFrame | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """(stem, kind, ord): one file per stem (txt before html before md), in name or test-list order.

    files: (stem, kind). tests: (stem, ord), blank names dropped; without any test all files are listed.
    """
    rank = F.array_position(F.array(*map(F.lit, TEXT_KINDS)), F.col("kind"))
    best = files.where(rank > 0).groupBy("stem").agg(F.max_by("kind", rank).alias("kind"))
    if tests is not None:
        best = best.join(tests.where(F.trim("stem") != "").select(F.trim("stem").alias("stem"), "ord"), "stem")
        out = best.orderBy("ord", "stem")
    else:
        out = best.orderBy("stem")
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit > 0 else out


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of this name, on whatever file system?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_test_list(spark: SparkSession, path: str) -> DataFrame:
    """(stem, ord) of a text with a name on each line: blanks around names and blank lines go; no file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "stem string, ord int")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("ord", "line"))
    return lines.select(F.trim("line").alias("stem"), "ord").where("stem <> ''")


def write_test_list(stems: DataFrame, folder: str) -> None:
    """(stem, ord) as one text, a name on each line in order."""
    stems.orderBy("ord", "stem").select(F.col("stem").alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def input_dir(root: str, parse_type: str) -> str:
    """Where the inputs of a parse type lie."""
    return f"{root}/pdf" if parse_type in ("pdf", "jpg") else f"{root}/parsed/{parse_type}"


def output_dir(root: str, parse_type: str, llm: str, prompt: str = "simple_schemaless", default: str = "simple_schemaless") -> str:
    """Where results go: another prompt than the default is named in the folder."""
    return f"{root}/results_{llm}/{parse_type if prompt == default else f'{parse_type}_{prompt}'}"


def write_files(rows: DataFrame, root: str) -> int:
    """Write (path, content) rows as files under ``root``, each by the task that has it; gives their number.

    ``root`` is a folder or URI that all executors share. A task that runs again writes the same files.
    """
    import pyarrow as pa

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        n = 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{base}/{path}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as f:
                    f.write(content.encode("utf-8"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("path", "content").where("path is not null and content is not null").mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_tsv(report: DataFrame, folder: str, decimals: int = 4) -> None:
    """One folder of TSV with a header; doubles with fixed decimals, nulls empty."""
    cols = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in report.dtypes]
    report.select(*cols).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(folder)


def write_json(rows: DataFrame, folder: str, partition: list[str] | None = None, append: bool = False) -> None:
    """JSON lines; error logs append, results overwrite."""
    w = rows.write.mode("append" if append else "overwrite")
    (w.partitionBy(*partition) if partition else w).json(folder)


def write_labels(labels: DataFrame, folder: str) -> None:
    """The sorted label list as one JSON array."""
    labels.agg(F.to_json(F.array_sort(F.collect_set("label"))).alias("value")).write.mode("overwrite").text(folder)
