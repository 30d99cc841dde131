"""Held-out items whose passages stand in a corpus.

Method: one Aho-Corasick automaton over the normalised items, scanning every text once. The automaton's
words are anchors: pieces of ``anchor`` characters taken every ``run - anchor + 1`` characters of an item,
so any shared run of ``run`` characters holds at least one whole anchor. Each hit is widened to the left
and right as far as text and item agree; runs long enough are leaks, mapped back to places in the original.
The corpus is read once, never shuffled and never gathered. Items go to the executors as broadcast blocks of
bounded size (one, unless there are millions of characters of them); a worker builds an automaton once and keeps
it, or, with several blocks, takes a large piece of the corpus through one after the other.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import cut

#: A leak is a run of at least so many normalised characters.
RUN = 40
#: Length of the anchors; anchors start every RUN - ANCHOR + 1 characters.
ANCHOR = 20
#: Normalised characters of items in one automaton (it takes about 30 bytes for each).
BLOCK_CHARS = 4_000_000
#: Characters of the corpus that a worker holds while it goes through several blocks of items.
HELD_CHARS = 30_000_000

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """NFKC, lower case, letters and digits only. Null gives ''."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def offsets(text: str) -> list[int] | None:
    """Place in ``text`` of every character of ``normalise(text)``; None if pieces don't add up to the whole."""
    out: list[int] = []
    parts: list[str] = []
    at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and (unicodedata.combining(text[end]) or text[end] in "ﾞﾟ" or "ᅠ" <= text[end] <= "ᇿ"):
            end += 1
        piece = normalise(text[at:end])
        parts.append(piece)
        out += [at] * len(piece)
        at = end
    out.append(len(text))
    return out if "".join(parts) == normalise(text) else None


class Scanner:
    """An automaton over items; ``runs`` gives the leaks of one normalised text."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, anchor: int = ANCHOR):
        import ahocorasick

        self.items = items
        self.run = run
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            if len(text) >= run:
                for at in range(0, len(text) - anchor + 1, run - anchor + 1):
                    where.setdefault(text[at : at + anchor], []).append((i, at))
        self.anchor = anchor
        self.automaton = ahocorasick.Automaton()
        for word, places in where.items():
            self.automaton.add_word(word, places)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def runs(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start in text, start in item, length) of every maximal shared run."""
        if self.empty or len(text) < self.run:
            return []
        out = []
        told: dict[tuple[int, int], int] = {}  # (item, diagonal) -> where the last run on it ended
        for last, places in self.automaton.iter(text):
            at = last - self.anchor + 1
            for i, place in places:
                key = (i, at - place)
                if told.get(key, -1) > at:
                    continue
                item = self.items[i][1]
                a, b = at, place
                while a > 0 and b > 0 and text[a - 1] == item[b - 1]:
                    a -= 1
                    b -= 1
                e, f = last + 1, place + self.anchor
                while e < len(text) and f < len(item) and text[e] == item[f]:
                    e += 1
                    f += 1
                told[key] = e
                if e - a >= self.run:
                    out.append((self.items[i][0], a, b, e - a))
        return out


def _item_blocks(items: DataFrame, key: str, text: str, run: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items of at least ``run`` characters in blocks of about ``block_chars``; one block is on the driver at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(n := normalise(t)) >= run]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["k", "t"])

    slim = cut(items.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null").mapInArrow(read, "k bigint, t string"))
    chars = slim.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        rows = slim.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b) if n > 1 else slim
        yield [(r["k"], r["t"]) for r in rows.collect()]


_BUILT: dict[str, Scanner] = {}


def _kept(token: str, make) -> Scanner:
    """The scanner of this token; a worker keeps the last one it built."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = make()
    return _BUILT[token]


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id, doc_start, doc_end, item_start, run_chars) of every maximal shared run of ``run`` characters.

    ``doc_start``/``doc_end`` are places in the original text (null in the rare text whose composition
    cannot be mapped); the other two count normalised characters. Null, empty and short texts share
    nothing; items shorter than ``run`` cannot leak; equal items, and copies of a document, count each.
    """
    names = ["item_id", "doc_id", "doc_start", "doc_end", "item_start", "run_chars"]
    arrow = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    schema = "item_id bigint, doc_id bigint, doc_start int, doc_end int, item_start int, run_chars int"
    slim = docs.select(F.col(doc_key).cast("bigint"), F.col(doc_text).cast("string")).where(F.length(doc_text) >= 1)

    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _item_blocks(items, item_key, item_text, run, block_chars)]
    token = uuid.uuid4().hex

    def found(texts: list[tuple[int, str]], s: Scanner) -> list[tuple]:
        rows: list[tuple] = []
        for k, t in texts:
            got = s.runs(normalise(t))
            if got:
                to = offsets(t)
                rows += [(i, k, to and to[a], to and to[a + n - 1] + 1, at, n) for i, a, at, n in got]
        return rows

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, arrow, strict=True)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size = 0
        for b in batches:
            texts = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            if len(blocks) == 1:
                yield batch(found(texts, _kept(token, lambda: Scanner(blocks[0].value, run, min(ANCHOR, run)))))
                continue
            held += texts
            size += sum(len(t) for _, t in texts)
            if size >= HELD_CHARS:
                yield from through(held)
                held, size = [], 0
        yield from through(held)

    def through(held: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        for i, block in enumerate(blocks if held else []):
            yield batch(found(held, _kept(f"{token} {i}", lambda block=block: Scanner(block.value, run, min(ANCHOR, run)))))
            if len(blocks) > 1 and hasattr(block, "_value"):
                del block._value  # read again from the executor's disk when needed

    return slim.mapInArrow(scan, schema)


def leaked_pairs(runs: DataFrame) -> DataFrame:
    """(item_id, doc_id), each pair once."""
    return runs.select("item_id", "doc_id").distinct()


def leaked_documents(runs: DataFrame) -> DataFrame:
    """One row per document: the items it leaks and how many characters its longest run has."""
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("run_chars").alias("longest_run"))
