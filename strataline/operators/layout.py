"""Layout of recognised text: vertical words, rows by position, rendering, overlaps, tables.

All sequences are ordered inside their page; rows and lines are built by folds that stream a page in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.text import display_width
from strataline.operators.folds import fold

#: Characters per point: 120 columns over a page of 595 points.
COLUMN_SCALE = 120.0 / 595.0


def vertical_words(words: DataFrame, page: list[str], x_tolerance: float = 3.0, gap: float = 5.0) -> DataFrame:
    """Single characters one under another joined into words; other words pass through.

    words: (page..., seq, text, x0, top, x1, bottom). Columns of characters are told apart by x0 rounded
    half-even to ``x_tolerance``; a new word begins where the next top lies ``gap`` or more under the last
    bottom. Ties in top keep the order of ``seq``. Null or blank texts are not single characters.
    """
    single = F.length(F.trim("text")) == 1
    cols = [*page, "seq", "text", "x0", "top", "x1", "bottom"]
    rest = words.where(~F.coalesce(single, F.lit(False))).select(*cols, F.lit(1).alias("n_chars"))
    s = words.where(single).withColumn("xkey", F.bround(F.col("x0") / x_tolerance, 0).cast("bigint"))
    w = Window.partitionBy(*page, "xkey").orderBy("top", "seq")
    starts = F.coalesce(F.col("top") - F.lag("bottom").over(w) >= gap, F.lit(True))
    s = s.withColumn("start", starts.cast("int")).withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chars = F.array_sort(F.collect_list(F.struct("top", "seq", "text", "bottom")))
    g = s.groupBy(*page, "xkey", "island").agg(chars.alias("c"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").cast("int").alias("n_chars"))
    first, last = F.col("c")[0], F.element_at("c", -1)
    joined = g.select(*page, first["seq"].alias("seq"), F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"), "x0", first["top"].alias("top"), "x1", last["bottom"].alias("bottom"), "n_chars")
    return rest.unionByName(joined)


# How a position line and the head of a page are written.
POSITION_LINE = r"^\[x=(\d+),y=(\d+)\]\s(.*)"
PAGE_HEAD = "=== Page"


def position_text(words: DataFrame, doc: list[str]) -> DataFrame:
    """(doc..., text): words as position lines under page heads, from (doc..., page, seq, text, x0, top).

    Words of a page stand by top, then x0, then seq; coordinates are rounded half-even to whole points. Pages are
    numbered by ``page``; every page of the input has its head, and lines of a document are joined by line breaks.
    """
    at = lambda c: F.bround(F.col(c), 0).cast("bigint").cast("string")
    line = F.concat(F.lit("[x="), at("x0"), F.lit(",y="), at("top"), F.lit("] "), F.col("text"))
    heads = words.select(*doc, "page").distinct().select(*doc, "page", F.lit(0).alias("k"), F.lit(0.0).alias("top"), F.lit(0.0).alias("x0"), F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit(f"{PAGE_HEAD} "), F.col("page").cast("string"), F.lit(" ===")).alias("line"))
    rows = words.where("text is not null").select(*doc, "page", F.lit(1).alias("k"), F.col("top").cast("double"), F.col("x0").cast("double"), F.col("seq").cast("bigint"), line.alias("line"))
    return fold(heads.unionByName(rows), doc, ["page", "k", "top", "x0", "seq"], "text string", lambda _: [], lambda s, r: s.append(r[-1]) or [], lambda s: [("\n".join(s),)])


def _positioned(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, page, header, x, y, text) of position lines; ``page`` counts the heads above a line."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    is_head = F.col("line").startswith(PAGE_HEAD)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("header", F.coalesce(F.last(F.when(is_head, F.col("line")), ignorenulls=True).over(w), F.lit(""))).withColumn("page", F.count_if(is_head).over(w))
    return lines.where(F.col("line").rlike(POSITION_LINE)).select(
        key, "pos", "page", "header", *[F.regexp_extract("line", POSITION_LINE, i).cast("double").alias(n) for i, n in ((1, "x"), (2, "y"))], F.regexp_extract("line", POSITION_LINE, 3).alias("text")
    )


def position_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, header, x, y, text) of '[x=..,y=..] ...' lines; page headers are carried forward, other lines dropped."""
    return _positioned(texts, key, text).drop("page")


def row_breaks(entries: DataFrame, page: list[str], height: float = 8.0) -> DataFrame:
    """(page..., seq, row_no): a new row begins more than ``height`` under the first entry of the row.

    entries: (page..., seq, x, y). Order is y, x, seq.
    """
    def step(state: dict, row: tuple) -> list[tuple]:
        y, _, seq = row
        if state["anchor"] is None:
            state["anchor"] = y
        elif y - state["anchor"] > height:
            state["anchor"] = y
            state["row"] += 1
        return [(seq, state["row"])]

    rows = entries.select(*page, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("seq").cast("bigint").alias("seq")).where("y is not null")
    return fold(rows, page, ["y", "x", "seq"], "seq bigint, row_no int", lambda _: {"anchor": None, "row": 0}, step)


def render_rows(entries: DataFrame, row: list[str], width: Column) -> DataFrame:
    """(row..., line): texts of a row set at the columns of their x; ``width`` is the width of ``text``.

    entries: (row..., seq, x, text). Order is x, seq.
    """
    def step(state: dict, r: tuple) -> list[tuple]:
        x, _, text, w = r
        target = int(x * COLUMN_SCALE)
        state["line"].append(" " * max(target - state["at"], 0) + text)
        state["at"] = max(target, state["at"]) + w
        return []

    rows = entries.select(*row, F.col("x").cast("double").alias("x"), "seq", "text", width.cast("int").alias("__w")).where("x is not null and text is not null")
    return fold(rows, row, ["x", "seq"], "line string", lambda _: {"at": 0, "line": []}, step, lambda s: [("".join(s["line"]),)])


def spatial_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spatial): position text as pages of rows; texts, and pages, without a position line give nothing."""
    lines = _positioned(texts, key, text).withColumn("seq", F.col("pos").cast("bigint"))
    placed = lines.join(row_breaks(lines, [key, "page"]), [key, "page", "seq"])
    rows = render_rows(placed, [key, "page", "header", "row_no"], display_width(F.col("text")))

    def step(state: dict, r: tuple) -> list[tuple]:
        page, header, _, line = r
        if page != state["page"]:
            state["page"] = page
            if header:
                state["out"].append(header)
        state["out"].append(line)
        return []

    ordered = rows.select(key, "page", "header", "row_no", "line")
    return fold(ordered, [key], ["page", "row_no"], "spatial string", lambda _: {"page": None, "out": []}, step, lambda s: [("\n".join(s["out"]),)])


def overlapping_pages(chars: DataFrame, page: list[str], failed: DataFrame | None = None) -> DataFrame:
    """(page..., has_overlap): do characters of different lines overlap?

    chars: (page..., ch, x0, y0, x1, y1, block, line). Blank characters and boxes thinner than 0.1 are left
    out, as are exact doubles. Boxes stream from the top; held are those that reach down to the present one, and a
    page is settled at its first overlap. Every page of the input has a row; pages of ``failed`` (page...), which
    could not be read, count as overlapping.
    """
    def step(state: dict, row: tuple) -> list[tuple]:
        y0, x0, x1, y1, ch, block, line = row
        if state["hit"] or not ch or not ch.strip() or x1 is None or y1 is None or x1 - x0 <= 0.1 or y1 - y0 <= 0.1:
            return []
        open_ = [o for o in state["open"] if o[3] > y0]
        for oy0, ox0, ox1, oy1, och, oblock, oline in open_:
            if min(x1, ox1) <= max(x0, ox0) or (block == oblock and line == oline):
                continue
            if ch == och and abs(x0 - ox0) + abs(x1 - ox1) < 0.5 and abs(y0 - oy0) + abs(y1 - oy1) < 0.5:
                continue
            state["hit"] = True
            return []
        open_.append(row)
        state["open"] = open_
        return []

    rows = chars.select(*page, "y0", "x0", "x1", "y1", "ch", "block", "line").where("y0 is not null and x0 is not null")
    found = fold(rows, page, ["y0", "x0"], "has_overlap boolean", lambda _: {"open": [], "hit": False}, step, lambda s: [(s["hit"],)])
    found = found.unionByName(chars.select(*page, F.lit(False).alias("has_overlap")))
    if failed is not None:
        found = found.unionByName(failed.select(*page, F.lit(True).alias("has_overlap")))
    return found.groupBy(*page).agg(F.max("has_overlap").alias("has_overlap"))


def outside_tables(blocks: DataFrame, tables: DataFrame, page: list[str], slack: float = 1.0) -> DataFrame:
    """Blocks that lie in no table of their page. tables: (page..., tx0, ty0, tx1, ty1)."""
    inside = (F.col("x0") >= F.col("tx0") - slack) & (F.col("y0") >= F.col("ty0") - slack) & (F.col("x1") <= F.col("tx1") + slack) & (F.col("y1") <= F.col("ty1") + slack)
    same = [F.col(f"b.{c}") == F.col(f"t.{c}") for c in page]
    cond = inside
    for s in same:
        cond = s & cond
    return blocks.alias("b").join(tables.alias("t"), cond, "left_anti")


def table_markdown(grid: Column) -> Column:
    """Markdown of array<array<string>>: empty cells for null, no line breaks, a rule after the first row."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.translate(F.coalesce(c, F.lit("")), "\n", " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(grid[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), row)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.array(row(grid[0]), rule), body), "\n")).otherwise("")


def page_text(parts: DataFrame, doc: list[str]) -> DataFrame:
    """(doc..., text) from (doc..., page, y, kind, seq, text): parts by y, text before tables, pages by a blank line."""
    full = parts.where(F.trim("text") != "")
    p = full.groupBy(*doc, "page").agg(F.array_sort(F.collect_list(F.struct("y", F.when(F.col("kind") == "text", 0).otherwise(1).alias("k"), "seq", "text"))).alias("e"))
    p = p.withColumn("body", F.array_join(F.transform("e", lambda x: x["text"]), "\n"))
    return p.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("p")).select(*doc, F.array_join(F.transform("p", lambda x: x["body"]), "\n\n").alias("text"))
