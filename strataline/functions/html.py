"""A small Markdown to HTML conversion: headings, paragraphs, lists and pipe tables."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cells(line: str) -> list[str]:
    return [html.escape(c.strip(), quote=False) for c in line.strip().strip("|").split("|")]


def to_html(text: str | None) -> str | None:
    """HTML of a Markdown text; null stays null, the empty text stays empty."""
    if text is None:
        return None
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text.strip("\n")):
        lines = block.split("\n")
        if not block.strip():
            continue
        if len(lines) > 1 and "|" in lines[0] and re.fullmatch(r"[\s|:-]+", lines[1]) and "-" in lines[1]:
            head = "".join(f"<th>{c}</th>" for c in _cells(lines[0]))
            body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in _cells(x)) + "</tr>" for x in lines[2:])
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
        elif m := re.match(r"(#{1,6})\s+(.*)", lines[0]):
            out.append(f"<h{len(m[1])}>{html.escape(m[2], quote=False)}</h{len(m[1])}>")
            if len(lines) > 1:
                out.append("<p>" + html.escape("\n".join(lines[1:]), quote=False) + "</p>")
        elif all(re.match(r"\s*[-*+]\s+", x) for x in lines):
            out.append("<ul>" + "".join("<li>" + html.escape(re.sub(r"^\s*[-*+]\s+", "", x), quote=False) + "</li>" for x in lines) + "</ul>")
        else:
            out.append("<p>" + html.escape(block, quote=False) + "</p>")
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def markdown_html(s: pd.Series) -> pd.Series:
    return s.map(to_html)
