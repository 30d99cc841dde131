"""Parsed texts of documents: where they come from by parse type, how they are kept, and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.html import markdown_html
from strataline.operators import layout
from strataline.sources import files

# Suffix of the parsed texts by type.
SUFFIXES = {"position": ".txt", "position_spatial": ".txt", "pymupdf4llm": ".md", "html": ".html", "pymupdf": ".md", "odl_fast": ".md", "odl_hybrid": ".md"}
#: Markdown types that HTML is made from.
MARKDOWN = ["pymupdf", "pymupdf4llm"]

#: parse type -> function of (spark, folder of documents) that gives (stem, text). Decoders of documents are not part
#: of the package: whoever has one registers it here.
DECODERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(parse_type: str, decoder: Callable[[SparkSession, str], DataFrame]) -> None:
    if parse_type not in SUFFIXES:
        raise ValueError(f"unknown parse type {parse_type}: one of {sorted(SUFFIXES)}")
    DECODERS[parse_type] = decoder


def extract_texts(spark: SparkSession, folder: str, parse_type: str) -> DataFrame:
    """(stem, text) of the documents in ``folder``; HTML is made from Markdown and has no decoder."""
    if parse_type == "html":
        raise ValueError("HTML is made from parsed Markdown: use derive()")
    if parse_type not in DECODERS:
        raise ValueError(f"no decoder for {parse_type}: register one")
    return DECODERS[parse_type](spark, folder).select("stem", "text")


def read_texts(spark: SparkSession, root: str, parse_type: str) -> DataFrame:
    """(stem, text) of the kept texts of a type; none if there are none."""
    folder = f"{root}/parsed/{parse_type}"
    if not files.exists(spark, folder):
        return spark.createDataFrame([], "stem string, text string")
    d = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix_of(parse_type)}")
    return d.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^./]*$", 1).alias("stem"), F.col("value").alias("text"))


def keep(texts: DataFrame, root: str, parse_type: str) -> int:
    """Keep (stem, text) as <root>/parsed/<type>/<stem><suffix>; position texts also as spatial texts. Gives the number of files.

    A text is a file of its own; a later text of a stem replaces an earlier one. A position text without a position
    line is kept, its spatial text is empty.
    """
    rows = texts.where("stem is not null").select("stem", F.coalesce("text", F.lit("")).alias("text"))
    files_ = _paths(rows, parse_type)
    if parse_type == "position":
        spatial = rows.select("stem").join(layout.spatial_text(rows, "stem", "text"), "stem", "left").select("stem", F.coalesce("spatial", F.lit("")).alias("text"))
        files_ = files_.unionByName(_paths(spatial, "position_spatial"))
    return files.write_files(files_, root)


def suffix_of(parse_type: str) -> str:
    return SUFFIXES["html" if parse_type.endswith("_html") else parse_type]


def _paths(rows: DataFrame, parse_type: str) -> DataFrame:
    return rows.select(F.concat(F.lit(f"parsed/{parse_type}/"), "stem", F.lit(suffix_of(parse_type))).alias("path"), F.col("text").alias("content"))


def derive(spark: SparkSession, root: str, parse_type: str) -> int:
    """What is derived from kept texts: 'html' from both Markdown types, 'position_spatial' from 'position'; other types from the documents in <root>/pdf."""
    if parse_type == "html":
        made = 0
        for source in MARKDOWN:
            html = read_texts(spark, root, source).select("stem", markdown_html(F.col("text")).alias("text"))
            made += keep(html, root, f"{source}_html")
        if not made:
            raise FileNotFoundError(f"no Markdown in {root}/parsed: extract {' or '.join(MARKDOWN)} first")
        return made
    if parse_type == "position_spatial":
        return keep(read_texts(spark, root, "position"), root, "position")
    return keep(extract_texts(spark, files.input_dir(root, "pdf"), parse_type), root, parse_type)
