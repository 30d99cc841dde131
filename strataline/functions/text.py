"""Text functions of the evaluation: normal form, comparison, cells, fences, display width."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of the normal form.
HYPHENS = "‐‑‒–—―−－ｰー"
ANGLE_MARKS = "°′″'\"｡"
BRACKETS = "()[]{}（）［］｛｝【】「」『』〈〉《》〔〕"
LIST_MARKS = "、,，\n"
#: White space as Python's \s sees it.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Numbers as Python's float() reads them (ASCII, without inf and nan).
FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"

_FLOAT, _INF = re.compile(FLOAT, re.A), re.compile(r"^[+-]?inf(inity)?$", re.I | re.A)

_STEPS = [
    (re.compile(f"[{HYPHENS}]"), "-"),
    (re.compile(f"[{re.escape(ANGLE_MARKS)}]"), ""),
    (re.compile(":"), "-"),
    (re.compile(rf"[\s{re.escape(BRACKETS)}]"), ""),
    (re.compile(f"[{LIST_MARKS}]+"), ","),
]


def normal_form(text: str) -> str:
    """The normal form of one text (worker side)."""
    return levelled(unicodedata.normalize("NFKC", text))


def levelled(text: str) -> str:
    """The normal form without NFKC, as ``normal`` has it with ``ascii_only``."""
    for pattern, to in _STEPS:
        text = pattern.sub(to, text)
    return text


def floats(forms: list[str]) -> np.ndarray:
    """What ``as_float`` says of normal forms, nan for null (worker side)."""
    return np.array([float(x) if _FLOAT.search(x) or _INF.search(x) else np.nan for x in forms], np.float64)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def nfkc(x: Column) -> Column:
    """NFKC; plain ASCII stays in the JVM and is not sent to Python."""
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7f]"), x)), x)


def normal(x: Column, ascii_only: bool = False) -> Column:
    """Normal form: NFKC, one hyphen, no angle marks, colon as hyphen, no blanks or brackets, runs of list marks as one comma."""
    raw = x
    if not ascii_only:
        x = nfkc(x)
    x = F.translate(x, HYPHENS + ":", "-" * (len(HYPHENS) + 1))
    x = F.translate(x, ANGLE_MARKS + BRACKETS, "")
    x = F.regexp_replace(x, SPACE, "")
    x = F.regexp_replace(x, f"[{LIST_MARKS}]+", ",")
    return F.when(raw.rlike(r"[^0-9A-Za-z_./+*%-]"), x).otherwise(raw)  # most texts have nothing to level


def as_float(x: Column) -> Column:
    """The number a normal form spells, by Python's grammar; null for anything else and for nan."""
    plain = F.when(x.rlike(FLOAT), F.regexp_replace(x, "_", "").try_cast("double"))
    inf = F.when(F.lower(x).rlike(r"^[+-]?inf(inity)?$"), F.when(x.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(plain, inf)


def same_value(a: Column, b: Column) -> Column:
    """Equal as normal forms, or as numbers."""
    return (a == b) | F.coalesce(as_float(a) == as_float(b), F.lit(False))


def error_kind(truth: Column, found: Column) -> Column:
    """'partial_match' if one text holds the other, else 'wrong_value'."""
    return F.when(F.contains(truth, found) | F.contains(found, truth), "partial_match").otherwise("wrong_value")


def clean_cell(x: Column) -> Column:
    return F.translate(F.coalesce(x, F.lit("")), "\t\n", "  ")


def strip_fence(x: Column) -> Column:
    """Lines between a leading code fence and the next fence line (or the end); other texts unchanged."""
    lines = F.split(x, "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    at = F.array_position(F.transform(rest, lambda v: F.startswith(v, F.lit("```"))), F.lit(True))
    body = F.when(at > 0, F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(rest)
    return F.when(F.startswith(x, F.lit("```")), F.array_join(body, "\n")).otherwise(x)


@F.pandas_udf(T.IntegerType())
def display_width(s: pd.Series) -> pd.Series:
    """Columns a text takes: two for wide characters, one for others; null counts 0."""
    return s.map(lambda t: sum(2 if unicodedata.east_asian_width(ch) in "FW" else 1 for ch in t) if t else 0).astype("int32")
