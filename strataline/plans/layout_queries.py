"""Queries of layout, schema, listing and document operators, with equivalent SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions.html import markdown_html
from strataline.operators import documents, extract, layout, metrics, nested, schema
from strataline.operators.dedupe import first_delivery
from strataline.sources import files
from strataline.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- word boxes ------------------------------------------------------------------------------------------

_WORDS_SQL = """words as (
  select user_id as page, event_id as seq, case when event_id % 5 = 0 then event_type else substr(event_type, 1, 1) end as text,
    cast(cast(floor(value) as int) % 12 as double) as x0, cast(row_number() over (partition by user_id order by ts, event_id) * (case when user_id % 2 = 0 then 4 else 9 end) as double) as top
  from events),
w as (select *, top + 3 as bottom, x0 + 2 as x1 from words)"""


def _words(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    w = e.select(
        F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.substring("event_type", 1, 1)).alias("text"),
        (F.floor("value").cast("int") % 12).cast("double").alias("x0"), (n * F.when(F.col("user_id") % 2 == 0, 4).otherwise(9)).cast("double").alias("top"),
    )
    return w.select("*", (F.col("top") + 3).alias("bottom"), (F.col("x0") + 2).alias("x1"))


@query(f"""with {_WORDS_SQL},
s as (select *, cast(round_even(x0 / 3.0, 0) as bigint) as xkey from w where length(trim(text)) = 1),
b as (select *, case when top - lag(bottom) over (partition by page, xkey order by top, seq) < 5 then 0 else 1 end as start from s),
i as (select *, sum(start) over (partition by page, xkey order by top, seq rows unbounded preceding) as island from b)
select page, seq, text, x0, top, x1, bottom, 1 as n_chars from w where length(trim(text)) <> 1
union all
select page, arg_min(seq, (top, seq)), string_agg(text, '' order by top, seq), min(x0), min(top), max(x1), arg_max(bottom, (top, seq)), count(*) from i group by page, xkey, island""")
def vertical_islands(spark: SparkSession, sf: str) -> DataFrame:
    return layout.vertical_words(_words(spark, sf), ["page"])


# --- positioned entries ------------------------------------------------------------------------------------

_ENTRIES_SQL = """entries as (
  select user_id as page, event_id as seq, cast(cast(floor(value * 10) as int) % 595 as double) as x, cast(extract(hour from ts) * 60 + extract(minute from ts) as double) as y, event_type as text from events)"""
_BREAKS_SQL = f"""{_ENTRIES_SQL},
o as (select *, row_number() over (partition by page order by y, x, seq) as k from entries),
r as (
  select page, seq, x, text, y, k, y as anchor, 0 as row_no from o where k = 1
  union all
  select o.page, o.seq, o.x, o.text, o.y, o.k, case when o.y - r.anchor > 8 then o.y else r.anchor end, r.row_no + case when o.y - r.anchor > 8 then 1 else 0 end
  from r join o on o.page = r.page and o.k = r.k + 1)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("page"), F.col("event_id").alias("seq"), (F.floor(F.col("value") * 10).cast("int") % 595).cast("double").alias("x"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("y"), F.col("event_type").alias("text"),
    )


@query(f"with recursive {_BREAKS_SQL} select page, seq, row_no from r")
def row_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.row_breaks(_entries(spark, sf), ["page"])


@query(f"""with recursive {_BREAKS_SQL},
q as (select page, row_no, text, cast(trunc(x * (120.0 / 595.0)) as int) as target, row_number() over (partition by page, row_no order by x, seq) as j, count(*) over (partition by page, row_no) as n from r),
z as (
  select page, row_no, n, 0 as j, 0 as pos, '' as line from (select distinct page, row_no, n from q)
  union all
  select z.page, z.row_no, z.n, z.j + 1, greatest(q.target, z.pos) + length(q.text), z.line || repeat(' ', greatest(q.target - z.pos, 0)) || q.text from z join q on q.page = z.page and q.row_no = z.row_no and q.j = z.j + 1)
select page, row_no, line from z where j = n""")
def row_render(spark: SparkSession, sf: str) -> DataFrame:
    e = _entries(spark, sf)
    return layout.render_rows(e.join(layout.row_breaks(e, ["page"]), ["page", "seq"]), ["page", "row_no"], F.length("text"))


#: The pattern of a position line, as the operator has it.
_AT = layout.POSITION_LINE


@query(rf"""with l as (
  select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
p as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from l),
h as (select *, coalesce(last_value(case when starts_with(line, '{layout.PAGE_HEAD}') then line end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding), '') as header from p)
select doc_id, cast(pos as int) as pos, header, cast(regexp_extract(line, '{_AT}', 1) as double) as x, cast(regexp_extract(line, '{_AT}', 2) as double) as y,
  regexp_extract(line, '{_AT}', 3) as text from h where regexp_matches(line, '{_AT}')""")
def position_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.position_lines(table(spark, sf, "documents"), "doc_id", "text")


@query()
def spatial_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.spatial_text(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""with {_WORDS_SQL},
p as (select page % 7 as doc, page // 7 + 1 as page, seq, text, x0 + 0.5 as x0, top + 0.5 as top from w where text is not null),
l as (
  select doc, page, 1 as k, top, x0, seq, '[x=' || cast(round_even(x0, 0) as bigint) || ',y=' || cast(round_even(top, 0) as bigint) || '] ' || text as line from p
  union all select distinct doc, page, 0, 0, 0, 0, '=== Page ' || page || ' ===' from p)
select doc, string_agg(line, chr(10) order by page, k, top, x0, seq) as text from l group by doc""")
def position_text(spark: SparkSession, sf: str) -> DataFrame:
    w = _words(spark, sf).select(F.expr("page % 7").alias("doc"), F.expr("page div 7 + 1").alias("page"), "seq", "text", (F.col("x0") + 0.5).alias("x0"), (F.col("top") + 0.5).alias("top"))
    return layout.position_text(w, ["doc"])


# --- character boxes, blocks, tables ----------------------------------------------------------------------

_CHARS_SQL = """chars as (
  select l_orderkey as page, l_returnflag as ch, l_quantity * 10 as x0, l_linenumber * 5.0 as y0, l_quantity * 10 + 8 as x1, l_linenumber * 5.0 + 6 as y1, l_linestatus as block, l_linenumber as line from lineitem),
n as (select *, row_number() over () as id from chars where trim(ch) <> '' and x1 - x0 > 0.1 and y1 - y0 > 0.1),
hit as (select distinct a.page from n a join n b on a.page = b.page and a.id < b.id where not (a.block = b.block and a.line = b.line)
  and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)
  and not (a.ch = b.ch and abs(a.x0 - b.x0) + abs(a.x1 - b.x1) < 0.5 and abs(a.y0 - b.y0) + abs(a.y1 - b.y1) < 0.5)),
ov as (select page, page in (select page from hit) as has_overlap from (select distinct page from chars))"""


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    x, y = F.col("l_quantity") * 10, F.col("l_linenumber") * 5.0
    chars = l.select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("ch"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 6).alias("y1"), F.col("l_linestatus").alias("block"), F.col("l_linenumber").alias("line"))
    return layout.overlapping_pages(chars, ["page"])


@query(f"with {_CHARS_SQL} select * from ov")
def char_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf)


@query(f"with {_CHARS_SQL} select page from ov where not has_overlap order by page limit 100")
def first_n_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred pages without overlap (the list of test documents)."""
    return _overlaps(spark, sf).where("not has_overlap").select("page").orderBy("page").limit(100)


@query("""with b as (select c_nationkey as page, c_custkey as seq, cast(c_custkey % 97 as double) as x0, cast(c_custkey % 89 as double) as y0, cast(c_custkey % 97 + 5 as double) as x1, cast(c_custkey % 89 + 3 as double) as y1 from customer),
t as (select n_nationkey as page, cast(n_nationkey as double) as tx0, cast(n_nationkey * 2 as double) as ty0, cast(n_nationkey + 40 as double) as tx1, cast(n_nationkey * 2 + 30 as double) as ty1 from nation)
select page, seq from b where not exists (select 1 from t where t.page = b.page and x0 >= tx0 - 1 and y0 >= ty0 - 1 and x1 <= tx1 + 1 and y1 <= ty1 + 1)""")
def blocks_outside_tables(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("page"), k.alias("seq"), *[e.cast("double").alias(n) for e, n in ((k % 97, "x0"), (k % 89, "y0"), (k % 97 + 5, "x1"), (k % 89 + 3, "y1"))])
    n = F.col("n_nationkey")
    t = table(spark, sf, "nation").select(n.alias("page"), *[e.cast("double").alias(c) for e, c in ((n, "tx0"), (n * 2, "ty0"), (n + 40, "tx1"), (n * 2 + 30, "ty1"))])
    return layout.outside_tables(b, t, ["page"]).select("page", "seq")


@query("""with r as (select n_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' as line, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation)
select n_regionkey, string_agg(line || case when k = 1 then chr(10) || '| --- | --- |' else '' end, chr(10) order by k) as markdown from r group by n_regionkey""")
def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    grid = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.select("n_regionkey", layout.table_markdown(grid).alias("markdown"))


@query("""with p as (
  select l_orderkey as doc, l_linenumber as page, l_quantity as y, case when l_returnflag = 'A' then 'table' else 'text' end as kind, l_partkey * 100000 + l_suppkey as seq, l_returnflag || l_partkey as text from lineitem),
g as (select doc, page, string_agg(text, chr(10) order by y, case when kind = 'text' then 0 else 1 end, seq, text) as body from p group by all)
select doc, string_agg(body, chr(10) || chr(10) order by page) as text from g group by doc""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    parts = l.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("y"), F.when(F.col("l_returnflag") == "A", "table").otherwise("text").alias("kind"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"),
    )
    return layout.page_text(parts, ["doc"])


# --- records: leaves, schema ---------------------------------------------------------------------------------

_XML_SQL = "(select file, record from (select file, record, row_number() over (partition by file order by loaded_at nulls last) as k from parse_xml) where k = 1)"
_LABEL = r"rtrim(regexp_replace(regexp_replace(replace(fullkey, '\"', ''), '^\$\.?', ''), '\[\d+\]\.?', '.', 'g'), '.')"


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return first_delivery(table(spark, sf, "parse_xml").select("file", "record", "loaded_at"), ["file"], ["loaded_at"])


@query(f"""select file, label, value, count(*) as n from (
  select file, {_LABEL.replace(chr(92) + chr(34), chr(34))} as label, coalesce(json_extract_string(value, '$'), '') as value from (select f.file, j.* from {_XML_SQL} f, json_tree(f.record) j where j.type not in ('OBJECT', 'ARRAY')))
group by all""")
def flatten_records(spark: SparkSession, sf: str) -> DataFrame:
    leaves = nested.node_table(_truth(spark, sf), "file", "record", arrays=set(), leaves=True).where("kind = 'leaf'")
    return leaves.groupBy(F.col("rec_key").alias("file"), "label", F.coalesce(F.col("fields")[""], F.lit("")).alias("value")).agg(F.count("*").alias("n"))


def _schema_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = nested.node_table(_truth(spark, sf), "file", "record", arrays=set(), leaves=True)
    parent = F.regexp_replace("label", r"\.?[^.]*$", "")
    return n.select(
        F.col("rec_key").alias("doc"), F.col("pre").alias("node"), F.col("parent_pre").alias("parent"), parent.alias("parent_label"), "label", "path", F.when(F.col("kind") == "leaf", "string").otherwise("object").alias("kind")
    )


@query(f"""with n as (select f.file, j.id, j.parent, j.type, j.fullkey from {_XML_SQL} f, json_tree(f.record) j),
x as (select a.file, a.id, case when a.type = 'OBJECT' then 'object' else 'string' end as kind, {_LABEL.replace(chr(92) + chr(34), chr(34))} as label,
    case when b.type = 'ARRAY' then b.parent else a.parent end as owner from n a left join (select file, id as bid, type, parent from n) b on a.file = b.file and a.parent = b.bid where a.type <> 'ARRAY'),
o as (select label, count(*) as n_parents from x where kind = 'object' group by all),
s as (select label, regexp_replace(label, '\\.?[^.]*$', '') as parent_label, list_sort(list(distinct kind)) as kinds, count(distinct (file, owner)) as n from x where label <> '' group by all)
select s.label, array_to_string(kinds, ',') as kinds, n = n_parents as required from s join o on s.parent_label = o.label""")
def schema_infer(spark: SparkSession, sf: str) -> DataFrame:
    return schema.infer(_schema_nodes(spark, sf)).withColumn("kinds", F.array_join("kinds", ","))


@query()
def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What each extraction result breaks of the schema of its own sheet's record."""
    r = first_delivery(table(spark, sf, "extraction_result").select("result_id", "file", "data", "loaded_at"), ["result_id"], ["loaded_at"])
    return schema.answer_problems(r.join(_truth(spark, sf), "file"), ["result_id", "file"], "record", "data")


@query(f"""with n as (select f.file, j.* from {_XML_SQL} f, json_tree(f.record) j),
o as (select file, id, {_LABEL.replace(chr(92) + chr(34), chr(34))} as label from n where type = 'OBJECT'),
s as (select file, label, count(*) as objects from o group by all),
k as (select o.file, o.label, c.key, count(*) as n from o join n c on c.file = o.file and c.parent = o.id group by all)
select k.file, k.label, key, n = objects as required from k join s using (file, label)""")
def file_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the objects at each label of each sheet's record, and whether all of them have it."""
    n = _schema_nodes(spark, sf)
    objects = n.where("kind = 'object'").groupBy("doc", F.col("label").alias("parent_label")).agg(F.count("*").alias("objects"))
    keys = n.where("label <> ''").groupBy("doc", "parent_label", F.regexp_extract("label", r"([^.]*)$", 1).alias("key")).agg(F.count_distinct("parent").alias("n"))
    return keys.join(objects, ["doc", "parent_label"]).select(F.col("doc").alias("file"), F.col("parent_label").alias("label"), "key", (F.col("n") == F.col("objects")).alias("required"))


# --- runs, listings ----------------------------------------------------------------------------------------


@query("select llm, parse_type, cast(sum(retry_count) as bigint) as total_retries, count(*) filter (where retry_count > 0) as retried_files, count(*) as files, cast(sum(coalesce(input_tokens, 0)) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from (select distinct result_id, llm, parse_type, retry_count, input_tokens, output_tokens from extraction_result) group by all")
def retry_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "extraction_result").select("result_id", "llm", "parse_type", "retry_count", "input_tokens", "output_tokens").distinct()
    return r.groupBy("llm", "parse_type").agg(
        F.sum("retry_count").alias("total_retries"), F.count_if(F.col("retry_count") > 0).alias("retried_files"), F.count("*").alias("files"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )


@query("select distinct llm, parse_type from extraction_result where llm in ('claude', 'gemini', 'gpt5.4')")
def run_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return files.discover_runs(table(spark, sf, "extraction_result"), ["claude", "gemini", "gpt5.4"])


@query("""select stem, ['md', 'html', 'txt'][max(k)] as kind, max(ord) as ord from (
  select survey_code as stem, cast(doc_id % 3 + 1 as int) as k, null as ord from documents where survey_code is not null) f
join (select distinct survey_code as s, cast(substr(survey_code, 4) as varchar) as ordn from parse_xml where survey_code is not null) t on t.s = f.stem
group by stem""".replace("max(ord) as ord", "max(ordn) as ord"))
def input_listing(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("survey_code is not null")
    f = d.select(F.col("survey_code").alias("stem"), F.element_at(F.array(F.lit("md"), F.lit("html"), F.lit("txt")), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"))
    t = table(spark, sf, "parse_xml").where("survey_code is not null").select(F.col("survey_code").alias("stem"), F.expr("substr(survey_code, 4)").alias("ord")).distinct()
    return files.list_inputs(f, t)


@query()
def html_convert(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", markdown_html(F.col("text")).alias("html"))


@query()
def extract_stub_retry(spark: SparkSession, sf: str) -> DataFrame:
    inputs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return extract.extract(inputs, lambda f: extract.OfflineExtractor(int(f) % 4), ["chars"]).drop("elapsed_seconds")


# --- whole documents -----------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["series_id", "batch_no", "llm", "parse_type", "result_id", "file"]
    r = first_delivery(table(spark, sf, "extraction_result").select(*keys, "data", "loaded_at"), ["result_id"], ["loaded_at"])
    t = _truth(spark, sf).select("file", "record")
    return documents.judge_documents(r.join(t, "file"), keys, "record", "data", unreadable=True)


@query()
def judged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every extraction result against its sheet's record; one without complete JSON is one row of status 'unreadable'."""
    return _judged(spark, sf)


@query()
def judged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every run and the number of its results that could not be read, which the scores leave out."""
    return metrics.with_scores(metrics.count_status(_judged(spark, sf), ["llm", "parse_type"], ("unreadable",))).orderBy(F.desc("f1"), "llm", "parse_type")
