"""Fields that hold several values in one string: one row per value, place kept.

Method: minimum description length. Every distinct cell is parsed under every dialect it allows (which of
the delimiters met in it separate values, and whether quotes enclose values). The code length of a value
comes from distributed counts over all candidate parses: -log2 of its share plus its spelling, shared out
over its uses. Each cell takes the parse that is cheapest to describe. Brackets, digit groups, dates and ratios
are never cut; quotes at the edge of a value protect what they enclose.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import cut

# Delimiters tried (longest first where one begins another), quotes and brackets.
DELIMITERS = [
    "<br />", "<br/>", "<br>", "および", "及び", "並びに", "ならびに", "\\n", "\r\n", "\n", "\t", "　",
    ",", "，", "、", "､", ";", "；", "|", "｜", "/", "／", "・", "･", "+", "＋", "&", "＆",
]
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "＂": "＂"}
PAIRED = {"“": "”", "‘": "’", "「": "」", "『": "』"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】", "〔": "〕", "〈": "〉", "《": "》"}

_DELIM = re.compile("|".join(map(re.escape, DELIMITERS)))
_WHOLE = re.compile(r"(?<![\d.])\d{1,3}(?:[,，]\d{3})+(?![\d])|(?<!\d)\d{4}([/.-])\d{1,2}\1\d{1,2}(?!\d)|(?<![\d./／])\d{1,3}[/／]\d{1,3}(?![\d./／])")
_SPECIAL = re.compile("|".join([*map(re.escape, DELIMITERS), "[" + re.escape("".join([*QUOTES, *BRACKETS])) + "]"]))
_BLANK = " \t\r\n　 "
#: Kinds of delimiter that one dialect mixes.
MIXED = 4
#: Bits for spelling one character: of the Latin block, and any other.
_NARROW_BITS, _WIDE_BITS = 6.0, 11.0
#: Bits for saying that a value is quoted, for naming one delimiter, and for one that stands within a value.
_QUOTE_BITS, _DELIMITER_BITS, _INNER_BITS = 2.0, 5.0, 10.0


def _closing(text: str, at: int, close: str, open_: str | None = None) -> int:
    """Place of the bracket that closes the one at ``at``, or -1."""
    depth = 0
    for i in range(at, len(text)):
        if open_ and text[i] == open_:
            depth += 1
        elif text[i] == close:
            depth -= 1
            if depth == 0:
                return i
    return -1


def unwrap_cell(cell: str) -> str:
    """The cell without blanks and without brackets around the whole of it."""
    t = cell.strip(_BLANK)
    while len(t) > 1 and t[0] in BRACKETS and _closing(t, 0, BRACKETS[t[0]], t[0]) == len(t) - 1:
        t = t[1:-1].strip(_BLANK)
    return t


def _quoted(text: str, at: int, delims: frozenset[str]) -> tuple[str, int] | None:
    """(content, place after it) of a quoted value that starts at ``at`` and ends before a delimiter or the end."""
    close = QUOTES[text[at]]
    i, out = at + 1, []
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text) and text[i + 1] in (close, "\\"):
            out.append(text[i + 1])
            i += 2
        elif ch == close and close in "\"'" and text[i + 1 : i + 2] == close:
            out.append(close)
            i += 2
        elif ch == close:
            j = i + 1
            while j < len(text) and text[j] in _BLANK and not any(text.startswith(d, j) for d in delims):
                j += 1
            if j == len(text) or any(text.startswith(d, j) for d in delims):
                return "".join(out), j
            return None
        else:
            out.append(ch)
            i += 1
    return None


def parse(text: str, delims: frozenset[str], quoting: bool) -> list[tuple[str, bool]]:
    """(value, quoted) of a cell under one dialect; empty places are no values."""
    items: list[tuple[str, bool]] = []
    start, i, n = 0, 0, len(text)
    fresh = True

    def close(end: int) -> None:
        v = unwrap_cell(text[start:end])
        if v:
            items.append((v, False))

    while i < n:
        if fresh and text[i] in _BLANK and not _delim_at(text, i, delims):
            i += 1
            continue
        if fresh and quoting and text[i] in QUOTES and (got := _quoted(text, i, delims)):
            value, i = got
            if value.strip(_BLANK):
                items.append((value.strip(_BLANK), True))
            d = _delim_at(text, i, delims)
            i += len(d)
            start, fresh = i, True
            continue
        if d := _delim_at(text, i, delims):
            if not (m := _WHOLE.search(text, max(start, i - 12), min(n, i + 16))) or not (m.start() < i < m.end()):
                close(i)
                i += len(d)
                start, fresh = i, True
                continue
        pair = BRACKETS.get(text[i]) or (quoting and not fresh and PAIRED.get(text[i]))
        if pair and (j := _closing(text, i, pair, text[i])) > 0:
            i = j + 1
            fresh = False
            continue
        fresh = False
        m = _SPECIAL.search(text, i + 1)  # nothing in between can end a value
        i = m.start() if m else n
    close(n)
    return items


def _delim_at(text: str, i: int, delims: frozenset[str]) -> str:
    m = _DELIM.match(text, i)
    return m[0] if m and m[0] in delims else ""


def candidate_parses(cell: str) -> list[tuple[list[str], list[str], float]]:
    """(values, words to be coded, fixed bits) of every different parse the cell allows, the uncut one first.

    A dialect splits at up to MIXED kinds of delimiter, or at all kinds met in the cell but at most one. So there
    are polynomially many, whatever stands in the cell, and all subsets where it has up to MIXED + 1 kinds.
    """
    text = unwrap_cell(cell)
    if not text:
        return []
    met = sorted({m[0] for m in _DELIM.finditer(text)})
    sizes = sorted({*range(min(len(met), MIXED) + 1), max(0, len(met) - 1), len(met)})
    sets = [frozenset(s) for k in sizes for s in itertools.combinations(met, k)]
    quotes = [True, False] if any(q in text for q in QUOTES) else [True]
    seen: set[tuple] = set()
    out = []
    for delims in sets:
        for quoting in quotes:
            items = parse(text, delims, quoting)
            key = tuple(v for v, _ in items)
            if not items or key in seen:
                continue
            seen.add(key)
            words: list[str] = []
            bits = _DELIMITER_BITS * len(delims)
            for v, q in items:
                if q:
                    bits += _QUOTE_BITS
                    parts = [w for x in _DELIM.split(v) if x and (w := x.strip(_BLANK))]
                    words += parts or [v]
                else:
                    words.append(v)
            out.append((list(key), words, bits))
    return out


def spelling_bits(word: str) -> float:
    return sum(_NARROW_BITS if ch < "ɐ" else _WIDE_BITS for ch in word) + _INNER_BITS * len(_DELIM.findall(word))


#: Uses of a word from which it is looked up in several places at once.
HOT_USES = 200_000


def split_cells(cells: DataFrame, kind: str, cell: str) -> DataFrame:
    """(kind, cell, values array) of every distinct cell, parsed by its cheapest dialect.

    ``kind`` names the vocabulary a cell belongs to (such as its label): code lengths are learnt for each.
    Null or blank cells give no rows; a cell repeated in the input is described once. A word may be in any
    share of all cells: words are counted before they are moved, and those of more than HOT_USES are looked up by
    (word, salt), with a salt for every HOT_USES. Equal lengths go to the parse with more values, then to the
    first in dialect order.
    """
    distinct = cells.where(F.col(cell).isNotNull()).select(F.col(kind).cast("string").alias("__kind"), F.col(cell).cast("string").alias("__cell")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = candidate_parses(c)
                rows += [(k, c, i, len(found), v, w, f, [spelling_bits(x) for x in w]) for i, (v, w, f) in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, arrow, strict=True)], names=names)

    names = ["__kind", "__cell", "__parse", "__n", "__values", "__words", "__bits", "__spelling"]
    arrow = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(pa.float64())]
    parses = distinct.mapInArrow(read, "__kind string, __cell string, __parse int, __n int, __values array<string>, __words array<string>, __bits double, __spelling array<double>")
    # written once: counting, coding and choosing all read it; a number stands for the cell where only parses are told apart
    parses = cut(parses.withColumn("__id", F.xxhash64("__kind", "__cell")))
    settled = parses.where("__n = 1").select("__kind", "__cell", "__values")
    open_ = parses.where("__n > 1")
    words = parses.select(
        "__kind", "__id", "__parse", "__n", F.explode(F.arrays_zip(F.col("__words").alias("w"), F.col("__spelling").alias("s"))).alias("x")
    ).select("__kind", "__id", "__parse", "__n", F.col("x.w").alias("__word"), F.col("x.s").alias("__s"))
    # how often a word is used, each parse of a cell weighing alike
    counts = cut(words.groupBy("__kind", "__word").agg(F.sum(1.0 / F.col("__n")).alias("__c"), F.count("*").alias("__uses")))
    totals = counts.groupBy("__kind").agg(F.sum("__c").alias("__total"))
    salts = F.ceil(F.col("__uses") / HOT_USES).cast("int")
    hot = counts.where(F.col("__uses") > HOT_USES).select("__kind", "__word", salts.alias("__salts"))
    counts = counts.join(totals, "__kind").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__uses")
    coded = words.where("__n > 1")
    if hot.isEmpty():
        coded = coded.withColumn("__salt", F.lit(0))
    else:
        coded = coded.join(hot, ["__kind", "__word"], "left").withColumn("__salt", F.pmod(F.xxhash64("__id", "__parse"), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    coded = coded.join(counts, ["__kind", "__word", "__salt"])
    bits = F.log2(F.col("__total") / F.col("__c")) + F.col("__s") / F.greatest(F.lit(1.0), F.col("__c"))
    length = coded.groupBy("__id", "__parse").agg(F.sum(bits).alias("__len"))
    best = (
        open_.select("__id", "__kind", "__cell", "__parse", "__values", "__bits").join(length, ["__id", "__parse"])
        .groupBy("__kind", "__cell").agg(F.min_by("__values", F.struct(F.round(F.col("__len") + F.col("__bits"), 6), -F.size("__values"), F.col("__parse"))).alias("__values"))
    )
    return settled.unionByName(best).select(F.col("__kind").alias("kind"), F.col("__cell").alias("cell"), F.col("__values").alias("values"))


def unpack(rows: DataFrame, key: str, kind: str, sides: list[str]) -> DataFrame:
    """(key, side, pos, item): one row per value of each cell with two or more values.

    Rows of equal key are taken as they come; null keys are kept as null keys.
    """
    long = rows.select(F.col(key), F.col(kind).alias("kind"), F.explode(F.map_from_arrays(F.array(*map(F.lit, sides)), F.array(*[F.col(s).cast("string") for s in sides]))).alias("side", "cell")).where("cell is not null")
    long = cut(long)  # read twice: for its distinct cells, and for its rows
    split = split_cells(long, "kind", "cell").where(F.size("values") >= 2)
    return long.join(split, ["kind", "cell"]).select(key, "side", F.posexplode("values").alias("__pos", "item")).select(key, "side", (F.col("__pos") + 1).cast("int").alias("pos"), "item")
