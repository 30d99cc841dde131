"""Queries of the general operators (problems 1, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.paths import plain_label
from strataline.operators import drift, nested, packed
from strataline.operators.dedupe import first_delivery
from strataline.sources.tables import table

#: Label endings whose cells can hold several values.
SERIES_LABELS = ["混入物", "試験項目", "使用機器一覧", "試料番号一覧", "貫入量内訳"]


#: A node's label: its path without '$', quotes and element numbers.
_LABEL = r"""trim(regexp_replace(regexp_replace(replace(j.fullkey, '"', ''), '^\$\.?', ''), '\[\d+\]\.?', '.', 'g'), '.')"""
#: Is the text of a string node JSON of its own?
_OPEN = r"(type = 'VARCHAR' and regexp_matches(text, '^\s*[{\[]') and json_valid(text))"
#: Every JSON text of every result: what ``data`` holds, then what strings in it hold, with the label they stand at.
_WALK_SQL = rf"""with recursive once as (
  select result_id, series_id, batch_no, file, data from (select *, row_number() over (partition by result_id order by loaded_at nulls last) as k from extraction_result) where k = 1),
doc as (
  select result_id, case when json_valid(data) then cast(data as json) when json_valid(body) then cast(body as json) end as doc
  from (select result_id, data, regexp_extract(data, '(?s)[{{\[].*[}}\]]') as body from once where data is not null)),
opened as (select result_id, case when json_type(doc) = 'VARCHAR' then case when json_valid(doc ->> '$') then cast(doc ->> '$' as json) end else doc end as doc from doc),
walk as (
  select result_id, '' as prefix, false as named, doc from opened where json_type(doc) in ('OBJECT', 'ARRAY')
  union all
  select result_id, prefix || case when prefix <> '' and l <> '' then '.' else '' end || l, case when id = 0 then named else not ends_with(fullkey, ']') end, cast(text as json)
  from (select w.result_id, w.prefix, w.named, {_LABEL} as l, j.id, j.fullkey, j.type, j.value ->> '$' as text from walk w, json_tree(w.doc) j where j.type = 'VARCHAR')
  where {_OPEN})"""
_SAID_SQL = rf"""{_WALK_SQL},
node as (
  select result_id, prefix || case when prefix <> '' and l <> '' then '.' else '' end || l as label, {_OPEN} as inner_json,
    case when id = 0 then named else not ends_with(fullkey, ']') end as counts,
    case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'VARCHAR' then 'string' else 'number' end as t
  from (select w.result_id, w.prefix, w.named, {_LABEL} as l, j.id, j.fullkey, j.type, j.value ->> '$' as text from walk w, json_tree(w.doc) j)),
met as (select result_id, label, t, count(*) as m from node where counts and not inner_json and label <> '' group by all),
best as (
  select result_id, label, count(*) as kinds, sum(m) as m, coalesce(arg_min(t, (-m, t)) filter (where t <> 'null'), 'null') as json_type from met group by all),
said as (
  select result_id, label, json_type, kinds > 1 or m > 1 or json_type = 'array' as is_many from best
  union all select distinct result_id, '', 'record', false from walk where prefix = '' and not named)"""


def _below_sql(source: str, lone: str) -> str:
    """The objects and arrays directly in those of ``source``; ``lone`` is what an object alone has after its path."""
    return rf"""
  select rec_key, label, path || case when kind = 'OBJECT' and not numbered then {lone} else '' end as path, numbered, parent_path, doc, kind
  from (select *, json_type(doc) as kind from (
    select w.rec_key, w.label || case when w.kind = 'OBJECT' then case when w.label <> '' then '.' else '' end || j.key else '' end as label,
      w.path || case when w.kind = 'ARRAY' then '[' || j.key || ']' when w.path <> '' then '.' || j.key else j.key end as path, w.kind = 'ARRAY' as numbered,
      case when w.kind = 'OBJECT' then w.path else w.parent_path end as parent_path,
      case when j.type = 'VARCHAR' and regexp_matches(j.value ->> '$', '^\s*[{{\[]') and json_valid(j.value ->> '$') then cast(j.value ->> '$' as json) else j.value end as doc
    from {source} w, json_each(w.doc) j))
  where kind in ('OBJECT', 'ARRAY')"""


def _nodes_sql(once: str, o: str) -> str:
    """CTE <o>_at: objects and arrays of every record with label, path and the path of the nearest object around."""
    return rf"""
{o}_doc as (
  select rec_key, case when json_valid(data) then cast(data as json) when json_valid(body) then cast(body as json) end as doc
  from (select rec_key, data, regexp_extract(data, '(?s)[{{\[].*[}}\]]') as body from {once} where data is not null)),
{o}_root as (
  select rec_key, '' as label, '' as path, true as numbered, cast(null as varchar) as parent_path, doc, json_type(doc) as kind
  from (select rec_key, case when json_type(doc) = 'VARCHAR' then case when json_valid(doc ->> '$') then cast(doc ->> '$' as json) end else doc end as doc from {o}_doc)
  where json_type(doc) in ('OBJECT', 'ARRAY')),
{o}_plain as (select * from {o}_root union all {_below_sql(f"{o}_plain", "''")}),
{o}_arrays as (select distinct label from {o}_plain where numbered and kind = 'OBJECT' and label <> ''),
{o}_at as (select * from {o}_root union all {_below_sql(f"{o}_at", f"case when label in (select label from {o}_arrays) then '[0]' else '' end")})"""


_FOUND_SQL = f"""with recursive
rec as (select file as rec_key, record as data from (select *, row_number() over (partition by file order by loaded_at nulls last) as k from parse_xml) where k = 1),
res as (select cast(result_id as varchar) as rec_key, data from (select *, row_number() over (partition by result_id order by loaded_at nulls last) as k from extraction_result) where k = 1),
{_nodes_sql("rec", "a")},
{_nodes_sql("res", "b")}
select 'parse_xml' as origin, rec_key, parent_path, path from a_at where kind = 'OBJECT' and path <> ''
union all select 'extraction_result', rec_key, parent_path, path from b_at where kind = 'OBJECT' and path <> ''"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return first_delivery(
        table(spark, sf, "extraction_result").select("result_id", "series_id", "batch_no", "file", "data", "loaded_at"), ["result_id"], ["loaded_at"]
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.change_report(table(spark, sf, "extraction_result"), table(spark, sf, "incorrect_examples"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return drift.batchwise(table(spark, sf, "extraction_result"))


def p1_table(spark: SparkSession, sf: str) -> DataFrame:
    records = _batches(spark, sf)
    return drift.consistent_table(records, drift.consistent_columns(records))


def p1_cast_failures(spark: SparkSession, sf: str) -> DataFrame:
    records = _batches(spark, sf)
    return drift.cast_failures(records, drift.consistent_columns(records))


def p1_type_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return drift.type_statistics(_batches(spark, sf))


def p1_file_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """How many records of each file have a label with which type."""
    stats = drift.type_statistics(_results(spark, sf), by=("file",))
    return stats.groupBy("file", "label", "json_type").agg(F.sum("n").alias("n"))


def packed_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "incorrect_examples").select("example_id", "field", "xml", "llm", "loaded_at")
    label = plain_label(F.col("field"))
    kind = F.regexp_extract(label, "(" + "|".join(SERIES_LABELS) + ")$", 1)
    rows = rows.withColumn("kind", kind).where("kind <> ''")
    return first_delivery(rows, ["example_id"], ["loaded_at"]).select("example_id", "kind", "xml", "llm")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.unpack(packed_rows(spark, sf), "example_id", "kind", ["xml", "llm"])


def _record_nodes(spark: SparkSession, sf: str, elements: bool = False) -> list[tuple[str, DataFrame]]:
    """Node tables of both origins. A record delivered twice brings no array label of its own, so those are read without telling deliveries apart."""
    xml, results = table(spark, sf, "parse_xml"), table(spark, sf, "extraction_result")
    once = first_delivery(xml.select("file", "record", "loaded_at"), ["file"], ["loaded_at"])
    return [
        ("parse_xml", nested.node_table(once, "file", "record", nested.array_label_table(xml, "record"), elements=elements)),
        ("extraction_result", nested.node_table(_results(spark, sf), "result_id", "data", nested.array_label_table(results, "data"), elements=elements)),
    ]


def p5_nodes(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (n.withColumn("origin", F.lit(o)) for o, n in _record_nodes(spark, sf, elements=True))
    return a.unionByName(b).select("origin", "rec_key", "pre", "post", "parent_pre", "depth", "label", "parent_path", "path", "kind", "fields")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (n.where("depth > 0").select(F.lit(o).alias("origin"), "rec_key", "parent_path", "path") for o, n in _record_nodes(spark, sf))
    return a.unionByName(b)


def p5_spt_blows(spark: SparkSession, sf: str) -> DataFrame:
    """標準貫入試験 with their 打撃回数, joined over the parent link of the two flat tables.

    A 打撃回数 that is a number in an array and no object gives its number and no span.
    """
    nodes = _record_nodes(spark, sf, elements=True)[0][1]
    tests = nodes.where("label = 'コア情報.標準貫入試験' and kind = 'object'").select("rec_key", F.col("pre").alias("test_pre"), F.col("path").alias("test_path"), F.col("fields")["開始深度"].alias("start_depth"))
    blows = nodes.where("label = 'コア情報.標準貫入試験.打撃回数'").select("rec_key", F.col("parent_pre").alias("test_pre"), F.col("fields")["区間"].alias("span"), F.coalesce(F.col("fields")["回数"], F.col("fields")[""]).alias("blows"))
    return tests.join(blows, ["rec_key", "test_pre"], "left").drop("test_pre")


QUERIES = {
    "p1_found": p1_found,
    "p1_table": p1_table,
    "p1_cast_failures": p1_cast_failures,
    "p1_type_statistics": p1_type_statistics,
    "p1_file_statistics": p1_file_statistics,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_nodes": p5_nodes,
    "p5_spt_blows": p5_spt_blows,
}
ORACLE_SQL: dict[str, str] = {
    "p5_found": _FOUND_SQL,
    "p1_type_statistics": f"{_SAID_SQL} select series_id, cast(batch_no as int) as batch_no, label, json_type, false as is_numeric, is_many, count(*) as n from said join once using (result_id) group by all",
    "p1_file_statistics": f"{_SAID_SQL} select file, label, json_type, count(*) as n from said join once using (result_id) group by all",
}
