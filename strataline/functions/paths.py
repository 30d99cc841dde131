"""Expressions over label paths (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_indices(path: Column) -> Column:
    """Index-free label: '[n]' and a dot after it become one dot, trailing dots go ('a[0][1].b' keeps two dots)."""
    return F.regexp_replace(F.regexp_replace(path, r"\[\d+\]\.?", "."), r"\.+$", "")


def section(path: Column) -> Column:
    """First two parts when split at '.' or '[' ('a[0].b' gives 'a.0]')."""
    return F.array_join(F.slice(F.split(path, r"\.|\["), 1, 2), ".")


def top_section(path: Column) -> Column:
    return F.split(path, r"\.|\[")[0]


def plain_label(path: Column) -> Column:
    """A path in any notation as keys joined by dots, element numbers dropped."""
    x = F.regexp_replace(F.trim(path), r"^\$\.?", "")
    x = F.regexp_replace(x, r"\[\s*\d+\s*\]", "")
    x = F.regexp_replace(x, r"""\[\s*['"]|['"]\s*\]""", ".")
    x = F.regexp_replace(x, r"[./]\d+(?=[./]|$)", "")
    return F.regexp_replace(F.regexp_replace(x, r"[./]+", "."), r"^\.|\.$", "")


def notation(path: Column) -> Column:
    """How a path is written: prefix, separator, quoting, place of element numbers ('?' if it has none)."""
    p = F.trim(path)
    prefix = F.when(p.startswith("$"), "$").when(p.startswith("/"), "/").otherwise("")
    quote = F.when(p.rlike(r"\[\s*'"), "'").when(p.rlike(r'\[\s*"'), '"').otherwise("")
    body = F.regexp_replace(p, r"^[$/]", "")
    sep = F.when(quote != "", "[]").when(body.contains("/"), "/").otherwise(".")
    number = F.when(p.rlike(r"\[\s*\d+\s*\]"), "[n]").when(p.rlike(r"[./]\d+([./]|$)"), "n").otherwise("?")
    # outside bare dotted paths the other marks already tell the notation
    return F.concat_ws(" ", prefix, sep, quote, F.when((prefix != "") | (quote != "") | (sep == "/"), F.lit("")).otherwise(number))
