"""SQL that gives the same rows as queries of the operators for training text."""

from __future__ import annotations

import sys
import unicodedata

from strataline.llm import glyphs
from strataline.llm.leakage import RUN

_ONCE = "(select * from (select *, row_number() over (partition by example_id order by loaded_at nulls last) as k from incorrect_examples) where k = 1)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _composed(source: str, table: dict[str, str]) -> str:
    """CTE form (v, f): every text of CTE ``source`` (v) with its characters replaced by the table, then composed."""
    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in table.items())
    return f"""mapped(c, m) as (values {rows}),
parts as (select v, unnest(string_split(v, '')) as c, unnest(range(length(v))) as p from {source} where regexp_matches(v, '[^\\x00-\\x7f]')),
form as (
  select v, nfc_normalize(string_agg(coalesce(m, c), '' order by p)) as f from parts left join mapped using (c) group by v
  union all select v, v from {source} where not regexp_matches(v, '[^\\x00-\\x7f]'))"""


def _forms() -> str:
    one, many, hidden = glyphs.glyph_tables()
    return f"""with texts as (select distinct v from (select xml as v from {_ONCE} union all select llm from {_ONCE}) where v is not null),
{_composed("texts", {**one, **many, **dict.fromkeys(hidden, "")})}"""


def _runs() -> str:
    """All runs of RUN characters of both sides, as NFKC and lower case, letters and digits only.

    NFKC is NFC after every character's own NFKC.
    """
    table = {ch: n for cp in range(0x80, sys.maxunicode + 1) if unicodedata.category(ch := chr(cp)) not in ("Cn", "Co", "Cs") and (n := unicodedata.normalize("NFKC", ch)) != ch}
    runs = f"unnest([substr(t, p, {RUN}) for p in range(1, length(t) - {RUN - 2})])"
    return f"""with texts as (select distinct v from (select text as v from documents union all select text from held_out_items) where v is not null),
{_composed("texts", table)},
kept as (select v, regexp_replace(lower(f), '[^\\p{{L}}\\p{{N}}]', '', 'g') as t from form),
a as (select distinct item_id, {runs} as s from held_out_items join kept on text = v),
b as (select distinct doc_id, {runs} as s from documents join kept on text = v)"""


ORACLE_SQL: dict[str, str] = {
    "p4_found": f"{_forms()} select example_id from {_ONCE} e join form x on e.xml = x.v join form y on e.llm = y.v where xml <> '' and llm <> '' and xml <> llm and x.f = y.f",
    "p4_forms": f"{_forms()} select example_id, xml, llm, x.f as xml_form, y.f as llm_form from {_ONCE} e left join form x on e.xml = x.v left join form y on e.llm = y.v",
    "p6_found": f"{_runs()} select distinct item_id, doc_id from a join b using (s)",
}
