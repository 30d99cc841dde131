"""Text that looks the same in one form.

Method: DuckDB inside Arrow partitions. Each worker keeps one in-memory DuckDB connection; every Arrow
batch is registered as a view and rewritten by embedded SQL of ``nfc_normalize``, ``translate`` and
regular expressions: invisible characters go, compatibility forms (width, presentation, radicals, blanks)
and look-alike letters become one character each, then canonical composition joins marks with their base.
Digits are never taken for letters, case is kept, blanks stay blanks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that readers cannot tell from a Latin one, by alphabet.
LATIN_LOOKALIKES = {
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԛ": "q", "ԝ": "w", "ԁ": "d",
    # Armenian and others
    "ո": "n", "օ": "o", "ѵ": "v", "ӏ": "l", "ɡ": "g", "ı": "i",
}
# Chinese characters drawn like a katakana letter.
KANA_LOOKALIKES = {"二": "ニ", "八": "ハ", "力": "カ", "口": "ロ", "夕": "タ", "工": "エ", "卜": "ト", "千": "チ", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "一": "ー"}
# Marks with one look.
MARK_LOOKALIKES = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "⁃": "-", "－": "-",
    "〜": "~", "～": "~", "∼": "~", "˜": "~", "·": "・", "•": "・", "‧": "・", "∙": "・", "⋅": "・",
    "’": "'", "‘": "'", "ʼ": "'", "′": "'", "“": '"', "”": '"', "″": '"', "∕": "/", "⁄": "/", "∶": ":", "ː": ":", "µ": "μ",
}
#: Decompositions that change the look (circled, raised, lowered, stacked) and so are kept apart.
_OTHER_LOOK = ("<circle>", "<super>", "<sub>", "<fraction>")


@lru_cache(maxsize=1)
def glyph_tables() -> tuple[dict[str, str], dict[str, str], str]:
    """(one-to-one table, one-to-many table, class of invisible characters), from Unicode data and the lists above."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    hidden: list[str] = []
    looks = {**LATIN_LOOKALIKES, **KANA_LOOKALIKES, **MARK_LOOKALIKES}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
            hidden.append(ch)
            continue
        if cat == "Zs":
            one[ch] = " "
            continue
        to = looks.get(ch)
        if to is None:
            kind = unicodedata.decomposition(ch).split(" ")[0]
            if kind.startswith("<") and kind not in _OTHER_LOOK:
                to = unicodedata.normalize("NFKC", ch)
                to = "".join(looks.get(x, x) for x in to)
            elif not kind.startswith("<") and kind:
                full = unicodedata.normalize("NFD", ch)
                if full[0] in looks:
                    to = unicodedata.normalize("NFC", looks[full[0]] + full[1:])
        if ch == "ﾞ":
            to = "゙"
        elif ch == "ﾟ":
            to = "゚"
        if to is not None and to != ch:
            (one if len(to) == 1 else many)[ch] = to
    return one, many, "".join(hidden)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ranges(chars: str) -> str:
    out, codes = [], sorted(map(ord, chars))
    at = 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(f"\\x{{{codes[at]:x}}}" + (f"-\\x{{{codes[end]:x}}}" if end > at else ""))
        at = end + 1
    return "".join(out)


def form_sql(x: str, met: set[str] | None = None) -> str:
    """SQL that gives the one form of expression ``x``; with ``met``, only for texts of these characters.

    ``translate`` builds its table anew for every text, so a batch brings the characters it has.
    """
    one, many, hidden = glyph_tables()
    if met is not None:
        many = {k: v for k, v in many.items() if k in met}
        met = met.union("".join(many.values()))
        one = {k: v for k, v in one.items() if k in met}
        hidden = "".join(ch for ch in hidden if ch in met)
    form = x
    if hidden:
        form = f"regexp_replace({form}, '[{_ranges(hidden)}]', '', 'g')"
    for ch, to in many.items():
        form = f"replace({form}, {_quote(ch)}, {_quote(to)})"
    if one:
        form = f"translate({form}, {_quote(''.join(one))}, {_quote(''.join(one.values()))})"
    if form == x:
        return f"nfc_normalize({x})"
    return f"nfc_normalize(CASE WHEN regexp_matches({x}, '[{_ranges(hidden + ''.join(one) + ''.join(many))}]') THEN {form} ELSE {x} END)"


#: Characters of a batch that the database rewrites at once.
HELD_CHARS = 4_000_000


_CONNECTION = None


def _connection():
    """One DuckDB connection per worker process: one thread, bounded memory."""
    global _CONNECTION
    if _CONNECTION is None:
        import duckdb

        _CONNECTION = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    return _CONNECTION


def one_form(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """``df`` with a column <name><suffix> for each column: its text in the one form.

    Null stays null, the empty text stays empty, a text of invisible characters becomes empty; texts of any
    length are rewritten whole. All other columns are passed through unchanged, whatever their names.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    added = [f"{c}{suffix}" for c in columns]
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = ", ".join([fields, *(f"`{a}` string" for a in added)])

    def formed(lists: list[list[str | None]]) -> list[pa.Array]:
        con = _connection()
        met: set[str] = set()
        for texts in lists:
            for v in texts:
                if v is not None:
                    met.update(v)
        con.register("texts", pa.table([pa.array(v, pa.string()) for v in lists], names=[f"v{i}" for i in range(len(lists))]))
        select = ", ".join(f"{form_sql(f'v{i}', met)} AS f{i}" for i in range(len(lists)))
        got = con.sql(f"SELECT {select} FROM texts").to_arrow_table()  # one thread, no sort: rows stay in order
        con.unregister("texts")
        return [pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in got.column(i).chunks)]) for i in range(len(lists))]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]
            start = size = 0
            for end in range(1, len(b) + 1):
                size += sum(len(v[end - 1] or "") for v in lists)
                if size >= HELD_CHARS or end == len(b):
                    cols = formed([v[start:end] for v in lists])
                    yield pa.RecordBatch.from_arrays([*b.slice(start, end - start).columns, *cols], names=[*b.schema.names, *added])
                    start, size = end, 0

    return df.mapInArrow(rewrite, schema)


def same_to_the_reader(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two texts are non-empty, differ as strings and have one form.

    Rows with a null or empty side, and rows whose sides are equal as strings, are left out.
    """
    keep = df.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != "") & (F.col(right) != "") & (F.col(left) != F.col(right)))
    formed = one_form(keep, [left, right], "__form")
    return formed.where(F.col(f"{left}__form") == F.col(f"{right}__form")).drop(f"{left}__form", f"{right}__form")
