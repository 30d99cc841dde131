"""Per-document text statistics, their place in the language's distribution, and the kind of text.

Method: every document gets a row of statistics (one pass, whole text). Each statistic is summed up per
language in a mergeable quantile sketch (KLL, built in the JVM, merged across partitions); the sketches
give medians, quartiles and ranks, with which values become percentiles and robust z-scores, and tails are
flagged. Medians and spreads of z are those of the documents that stand mostly in prose lines, else a large
share of other kinds widens the scale until no value of a bounded statistic lies in a tail. Tails alone
decide the kind of a text: one counts if it also makes up most of the text, that is, if the value lies more
than half of the way from the language's median to the statistic's end (a share of 1, or of 0).
"""

from __future__ import annotations

import re
import statistics
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import cut

# Common English function words.
COMMON_EN = frozenset(
    "a about after all also although an and any are as at be because been before below between both but by can could did do does during each for from "
    "had has have he her here his how however if in into is it its itself may more most near no none not of off on one only or other our out over "
    "per she should since so some such than that the their them then there these they this those through to towards under until up upon was we were "
    "what when where which while who will with within without would you your".split()
)
STATISTICS = [
    "n_chars", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_word_share", "punctuated_line_share",
    "short_line_share", "list_share", "table_share", "row_share", "noise_share", "single_char_share", "packed_ratio",
    "prose_share", "repeated_share",
]
#: Statistics by which a text can differ from prose, and the value they have where all of the text does.
ENDS = {"row_share": 1.0, "symbol_ratio": 1.0, "single_char_share": 1.0, "repeated_share": 1.0, "packed_ratio": 0.0, "common_word_share": 0.0, "prose_share": 0.0}
#: Distance from the median, in robust standard deviations, from which a value lies in a tail.
TAIL = 3.0
#: Least robust standard deviation: this share of the median, and in any case this much.
LEAST_SPREAD = 0.01
#: A share of tokens is told apart from chance by so many tokens more that are not counted.
SHRINK = 4

# Prose of each script, against which a corpus without any prose of its own is measured.
SAMPLE_PROSE = [
    "The crew lost some water near the base of the hole, but they finished it on the same day.",
    "Most of the valley is covered by gravel that came down from the hills to the north of the town.",
    "It is not clear why the second reading was higher than the first, so the test should be done again.",
    "A thin band of grey clay was seen between the two beds of sand, and it could be followed for some way.",
    "昨日の調査では、川の近くで細かい砂の層が見られ、その下には硬い粘土が続いていた。",
    "この地区の地盤は比較的新しい堆積物からなり、場所によって厚さが大きく異なると考えられる。",
    "試料の一部は乾いていたので、結果を解釈するときには注意しなければならない。",
    "雨が続いたあとに水位が上がり、午後の作業は次の日まで延ばすことになった。",
]

_CJK = "぀-ヿ㐀-鿿ｦ-ﾟ々"
_FIGURE = re.compile(r"\d+(?:[.,]\d+)*")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-z]+)?")
_KANA = re.compile(r"[ぁ-ん]")
_HAN = re.compile(rf"[{_CJK}]")
_MARKER = re.compile(r"^\s*(?:[-*+–](?=\s)|[•・●○◯◆◇■□☐☑✓✔✗▪‣※]|\(\d{1,3}\)|（\d{1,3}）|\d{1,3}[)）]|\d{1,3}[.．](?=\s)|[①-⑳]|\([a-zA-Z]\)|[a-zA-Z]\))\s*\S")
_KEYED = re.compile(r"^\s*[^\s:：=][^:：=。]{0,24}[:：=]\s*\S")
_TAGS = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b[^>]*>", re.I)
_COORD = re.compile(r"^\s*(?:\[?\(?\s*x\s*[=:]|=+\s*page\b|[\[(]\s*\d+(?:\.\d+)?\s*,\s*\d+)", re.I)
_RULE = re.compile(r"^[\s|:+\-=_─━┼┬┴│┃]+$")
_NUMBER = re.compile(r"^[-+]?\d[\d.,/%-]*[A-Za-z㎜㎝]{0,3}$")
_DIGIT = re.compile(r"\d")
_SYMBOL = re.compile(r"[^\w\s、。，．,.()（）「」]|_")
_WORDLIKE = re.compile(r"[^\W_]")
_WIDE = re.compile(r"[⺁-\U0010ffff]")
_GAPS = re.compile(r"\S(?:\s{2,}|　+)\S")
#: Marks of lost characters; question marks and tildes only where text goes on at both sides.
_NOISE = re.compile(r"[�■-□〓\x00-\x08\x0b\x0e-\x1f\x80-\x9f-]|(?<=[^\s?~.!)\d])[?~？～〜]+(?=[^\s?~!\d])")
#: Letters left when UTF-8 is read as a one-byte code, followed by a byte of the upper half.
_MOJIBAKE = re.compile(r"[Â-ôÃ][\x80-\xffŒ-ƒˆ˜–-™�]")
_FULL_WIDTH = re.compile("[０-９Ａ-Ｚａ-ｚ]")
_TO_NARROW = {ord(ch): chr(ord(ch) - 0xFEE0) for ch in "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"}
#: Bytes that packing adds to any text.
_PACKED_NOTHING = len(zlib.compress(b"", 1))
_END = ".!?。！？．」』)）"


def _is_prose(line: str) -> bool:
    """A line that reads like a piece of sentences."""
    han = len(_HAN.findall(line))
    words = _LATIN.findall(line)
    if han >= len("".join(words)):
        kana = len(_KANA.findall(line))
        return han >= 8 and kana * 5 >= han
    common = sum(w.lower() in COMMON_EN for w in words)
    return len(words) >= 4 and common * 8 >= len(words)


def line_kind(line: str) -> str:
    """'table', 'list', 'prose', 'entry' or 'other' for one line (not blank).

    An 'entry' is a short line without a mark of its own: part of a list only where others stand next to it.
    """
    if _TAGS.search(line):
        return "table"
    if _COORD.match(line) or (len(line.strip()) > 2 and _RULE.match(line) and ("|" in line or "+" in line or "┼" in line)):
        return "table"
    if line.count("|") >= 2 or line.count("\t") >= 1 or line.count("│") >= 2:
        return "table"
    bare = line.strip()
    if _is_prose(bare):
        return "list" if _MARKER.match(line) and len(bare) + len(_WIDE.findall(bare)) <= 60 else "prose"
    tokens = line.split()
    if tokens and sum(bool(_NUMBER.match(t)) for t in tokens) * 2 > len(tokens) and len(tokens) > 1:
        return "table"
    for sep in (",", ";", "，"):
        if line.count(sep) >= 2 and len(line) / (line.count(sep) + 1) <= 24:
            return "table"
    if len(_GAPS.findall(line)) >= 2:
        return "table"
    if _MARKER.match(line) or _KEYED.match(line):
        return "list"
    return "entry" if len(bare) + len(_WIDE.findall(bare)) <= 60 and _WORDLIKE.search(bare) else "other"


def line_kinds(lines: list[str]) -> list[str]:
    """The kinds of a text's lines; an entry next to another one or to a list line is 'list', alone it is 'other'."""
    met = [line_kind(x) for x in lines]
    near = [k in ("entry", "list") for k in met]
    return [
        k if k != "entry" else "list" if (i and near[i - 1]) or (i + 1 < len(near) and near[i + 1]) else "other"
        for i, k in enumerate(met)
    ]


def repeats_of(text: str) -> float:
    """How often the shortest unit follows itself to make up the text (the last one may be cut off); 1 below two times."""
    n = len(text)
    head = text[: n - n // 2]  # stands again at the place of the second unit
    p = text.find(head, 1)
    while 0 < p <= n // 2:
        if text.startswith(text[: n - p], p):
            return n / p
        p = text.find(head, p + 1)
    return 1.0


def statistics_of(text: str) -> tuple[str, dict[str, float]]:
    """(language by script, statistics) of one text that is not blank. Letters and digits count whatever their width."""
    if _FULL_WIDTH.search(text):
        text = text.translate(_TO_NARROW)
    n = len(text)
    tokens = text.split()
    solid = sum(map(len, tokens))
    lines = [x for x in text.splitlines() if x.strip()]
    latin = _LATIN.findall(text)
    han = len(_HAN.findall(text))
    letters = sum(map(len, latin))
    lang = "ja" if han * 2 >= letters and han else "en" if letters * 3 >= solid else "other"
    if lang == "ja":
        common = len(_KANA.findall(text)) / max(1, solid)
    else:
        common = sum(w.lower() in COMMON_EN for w in latin) / max(1, len(latin))
    share = dict.fromkeys(("table", "list", "prose", "other"), 0)
    short = ends = single = 0
    for x, kind in zip(lines, line_kinds(lines), strict=True):
        size = len(x.strip())
        share[kind] += size
        short += size * (size <= (20 if lang == "ja" else 40))
        ends += x.rstrip()[-1] in _END
        single += size * (size <= 1)
    size = max(1, sum(share.values()))
    alone_share = sum(len(t) == 1 and t.isalpha() for t in tokens) / (len(tokens) + SHRINK)
    noise = sum(map(len, _MOJIBAKE.findall(text)))
    if _NOISE.search(text):  # a mark at the head of a line is a bullet
        noise += sum(sum(map(len, _NOISE.findall(x.lstrip()[1:]))) for x in lines)
    raw = text.encode("utf-8", "surrogatepass")
    symbols = len(_SYMBOL.findall(text))
    return lang, {
        "n_chars": n, "n_lines": len(lines), "n_words": len(latin) + han + len(_FIGURE.findall(text)),
        "mean_word_length": solid / max(1, len(tokens)),
        "symbol_ratio": symbols / max(1, solid), "digit_ratio": len(_DIGIT.findall(text)) / max(1, solid),
        "common_word_share": common, "punctuated_line_share": ends / max(1, len(lines)), "short_line_share": short / size,
        "list_share": share["list"] / size, "table_share": share["table"] / size, "row_share": (share["list"] + share["table"]) / size,
        "noise_share": noise / max(1, solid), "single_char_share": max(single / size, alone_share),
        "packed_ratio": (len(zlib.compress(raw, 1)) - _PACKED_NOTHING) / max(1, len(raw)), "prose_share": share["prose"] / size,
        "repeated_share": 1 - 1 / repeats_of("".join(tokens)),  # wrapping does not hide it
    }


def document_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, script_lang, statistics...) of every document; null and blank texts get no row.

    ``script_lang`` is judged by the script of the text, not by a label that may be wrong.
    """
    names = [key, "script_lang", *STATISTICS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and not t.isspace():
                    lang, s = statistics_of(t)
                    rows.append((k, lang, *(float(s[x]) for x in STATISTICS)))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            types = [pa.int64(), pa.string(), *[pa.float64()] * len(STATISTICS)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

    schema = f"`{key}` bigint, script_lang string, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(read, schema)


def language_sketches(stats: DataFrame, k: int = 400) -> DataFrame:
    """One row per language with a KLL sketch of every statistic (about 1 % rank error at k = 400)."""
    return stats.groupBy("script_lang").agg(F.count("*").alias("n_docs"), *[F.kll_sketch_agg_double(s, F.lit(k)).alias(f"{s}__sketch") for s in STATISTICS])


def _quantiles(sketches: DataFrame, ranks: list[float], suffix: str, *by: str) -> DataFrame:
    at = F.array(*map(F.lit, ranks))
    return sketches.select(*by, *[F.kll_sketch_get_quantile_double(f"{s}__sketch", at).alias(f"{s}{suffix}") for s in STATISTICS])


@lru_cache(maxsize=1)
def sample_quartiles() -> dict[str, list[float]]:
    """Quartiles of the statistics over SAMPLE_PROSE."""
    rows = [statistics_of(t)[1] for t in SAMPLE_PROSE]
    return {s: statistics.quantiles([r[s] for r in rows], n=4, method="inclusive") for s in STATISTICS}


def with_distribution(stats: DataFrame, key: str) -> DataFrame:
    """``stats`` with, per statistic, its percentile and robust z-score in its language, and ``tails``.

    z is the distance from the median over the robust standard deviation of that side (quartile to median /
    0.6745), median and quartiles being those of the language's documents that stand mostly in prose lines; a
    language without such is measured against the prose of all languages, a corpus without any against
    SAMPLE_PROSE. The deviation is at least LEAST_SPREAD, of the median and absolutely. Percentiles are among all
    documents of the language. ``tails`` lists the statistics beyond ``TAIL`` with their side.
    There are as many sketch rows as scripts told apart (three at most), so they are joined by broadcast.
    """
    quartiles = [0.25, 0.5, 0.75]
    prose = language_sketches(stats.where("prose_share > 0.5"))
    pooled = prose.groupBy(F.lit(1)).agg(*[F.kll_merge_agg_double(f"{s}__sketch").alias(f"{s}__sketch") for s in STATISTICS])
    wide = (
        _quantiles(language_sketches(stats), [i / 100 for i in range(101)], "__q", "script_lang")
        .join(F.broadcast(_quantiles(prose, quartiles, "__p", "script_lang")), "script_lang", "left")
        .withColumn("__all", _quantiles(pooled, quartiles, "").select(F.struct(*STATISTICS)).scalar())
    )
    sample = sample_quartiles()
    own = {s: F.coalesce(F.col(f"{s}__p"), F.col("__all")[s], F.array(*map(F.lit, sample[s]))) for s in STATISTICS}
    wide = wide.select("script_lang", *[f"{s}__q" for s in STATISTICS], *[own[s].alias(f"{s}__r") for s in STATISTICS])
    j = stats.join(F.broadcast(wide), "script_lang")

    def z_of(s: str):
        low, mid, high = (F.col(f"{s}__r")[i] for i in range(3))
        side = F.when(F.col(s) >= mid, high - mid).otherwise(mid - low) / 0.6745
        return (F.col(s) - mid) / F.greatest(side, F.abs(mid) * LEAST_SPREAD, F.lit(LEAST_SPREAD))

    def percentile(s: str):
        return F.size(F.filter(f"{s}__q", lambda q: q < F.col(s))) / F.lit(101.0)

    def most(s: str, end: float):
        mid = F.col(f"{s}__r")[1]
        return F.when((F.col(s) - mid) / (F.lit(end) - mid) > 0.5, F.lit(s))

    z = {s: z_of(s) for s in STATISTICS}
    tails = F.array_compact(F.array(*[F.when(z[s] > TAIL, F.lit(f"{s}+")).when(z[s] < -TAIL, F.lit(f"{s}-")) for s in STATISTICS]))
    return j.select(
        key, "script_lang", *STATISTICS,
        *[percentile(s).alias(f"{s}_pct") for s in STATISTICS],
        *[z[s].alias(f"{s}_z") for s in STATISTICS], tails.alias("tails"),
        F.array_compact(F.array(*[most(s, end) for s, end in ENDS.items()])).alias("mostly"),
    )


def kinds(dist: DataFrame) -> DataFrame:
    """``dist`` with ``doc_kind`` (list, table, junk or prose) and ``decided_by``, the tails that made it.

    A tail decides if the statistic is also one that most of the text bears out (``mostly``); for lost
    characters the tail is enough, as a text with some of them can't be read. In this order:
    junk    lost characters; single characters; the same over and over, or text that packs to nothing, unless in rows
    table, list    rows, by the larger part
    junk    symbols, or few common words in what is no prose
    Symbols come before lists, as an entry of symbols tells nothing. A document without such tails is prose.
    """
    def far(s: str):
        side = "-" if ENDS.get(s) == 0.0 else "+"
        told = F.array_contains("tails", s + side)
        return told if s not in ENDS else told & F.array_contains("mostly", s)

    rows, table = far("row_share"), F.col("table_share") >= F.col("list_share")
    steps = [
        ("junk", far("noise_share"), ["noise_share+"]),
        ("junk", far("single_char_share"), ["single_char_share+"]),
        ("junk", far("repeated_share") & ~(rows & table), ["repeated_share+"]),
        ("junk", far("packed_ratio") & ~rows, ["packed_ratio-"]),
        ("table", rows & table, ["row_share+"]),
        ("junk", far("symbol_ratio"), ["symbol_ratio+"]),
        ("list", rows, ["row_share+"]),
        ("junk", far("common_word_share") & far("prose_share"), ["common_word_share-", "prose_share-"]),
    ]
    kind, why = F, F
    for name, cond, by in steps:
        kind, why = kind.when(cond, name), why.when(cond, F.array(*map(F.lit, by)))
    return dist.withColumn("doc_kind", kind.otherwise("prose")).withColumn("decided_by", why.otherwise(F.array().cast("array<string>"))).drop("mostly")


def judge_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Statistics, percentiles, z-scores, tails and kind of every document with a text that is not blank.

    Null and blank texts have no row; texts of any length are read whole; repeated rows count each.
    """
    stats = cut(document_statistics(docs, key, text))
    return kinds(with_distribution(stats, key))
