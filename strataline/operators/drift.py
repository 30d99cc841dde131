"""Records whose fields drift between batches: change report and one consistent typed table.

Method: every record (one per file and batch) is read as a path-value map with raw JSON types. Statistics of path
and type are taken per file from its map and summed up over the files of a batch inside each task, so what
is shuffled is schema-sized, not records; the maps themselves, several times the size of the JSON, are never
written. The statistics give the change report and the target types; typed columns are then projected from the
maps and values that do not fit are reported as failed casts.

Only schema-sized data (label lists of a batch, the columns of the table) is ever gathered into arrays or on the
driver; records and values stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import jsonx
from strataline.functions.paths import notation
from strataline.operators.dedupe import first_delivery
from strataline.session import cut

#: A label is in force in a batch if at least one in FORCE of its readable records has it.
FORCE = 4
#: Share of agreeing values from which a vanished and a new label are the same thing.
SAME_THING = 0.5


@dataclass(frozen=True)
class Drift:
    """Names of the columns that identify a record, its series, its batch and its file."""

    record: str = "result_id"
    series: str = "series_id"
    batch: str = "batch_no"
    file: str = "file"
    data: str = "data"
    delivered: str = "loaded_at"


def _is_number(v: object) -> bool:
    if isinstance(v, bool):
        return False
    k = jsonx.value_key(v)
    if k is None:
        return False
    try:
        float(k)
    except ValueError:
        return False
    return True


def type_statistics(records: DataFrame, c: Drift = Drift(), values: bool = False, by: tuple[str, ...] | None = None) -> DataFrame:
    """(series, batch, label, json_type, is_numeric, is_many, n): records of a batch by label and raw type.

    ``by`` names other columns to count by (such as the file). ``is_numeric`` (all values of the record can be
    read as numbers) is looked at only with ``values``; then ``is_many`` means more than one scalar in the record,
    and ``has_scalar`` that one of them is not null.

    Label '' carries the number of readable records. A record counts once per label, with the type it
    gives most often, nulls aside (only nulls: type 'null'). Unreadable or null data adds nothing; an
    empty table gives an empty result. Null keys are keys of their own.
    """
    by = (c.series, c.batch) if by is None else by

    def agg(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, int] = {}

        def counted() -> pa.RecordBatch:
            cols = list(zip(*(key + (m,) for key, m in n.items()), strict=True)) or [[]] * len(names)
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, arrow, strict=True)], names=names)

        for b in batches:
            *keys, data = (b.column(i).to_pylist() for i in range(len(by) + 1))
            for *at, d in zip(*keys, data, strict=True):
                doc = jsonx.read_document(d)
                if doc is None:
                    continue
                at = tuple(at)
                key = (*at, "", "record", False, False, *[False] * values)
                n[key] = n.get(key, 0) + 1
                for label, (types, met) in jsonx.path_values(doc).items():
                    if len(types) == 1:
                        kind, m = next(iter(types.items()))
                        many = m > 1 or kind == "array"
                    else:
                        known = {t: m for t, m in types.items() if t != "null"}
                        kind = min(known, key=lambda t: (-known[t], t))
                        many = True
                    numeric, held = False, ()
                    if values:
                        vals = [v for v in met if jsonx.value_key(v) is not None]
                        numeric = bool(vals) and all(map(_is_number, vals))
                        many, held = len(met) > 1, (any(v is not None for v in met),)
                    key = (*at, label, kind, numeric, many, *held)
                    n[key] = n.get(key, 0) + 1
            if len(n) >= 100_000:  # what is held stays small, whatever a task reads
                yield counted()
        yield counted()

    names = [*by, "label", "json_type", "is_numeric", "is_many", *["has_scalar"] * values, "n"]
    kinds = ["int" if k == c.batch else "string" for k in by]
    arrow = [*[pa.int32() if k == "int" else pa.string() for k in kinds], pa.string(), pa.string(), *[pa.bool_()] * (2 + values), pa.int64()]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(by, kinds, strict=True)), f"label string, json_type string, is_numeric boolean, is_many boolean, {'has_scalar boolean, ' * values}n bigint"])
    slim = records.select(*[F.col(k).cast(t) for k, t in zip(by, kinds, strict=True)], F.col(c.data).cast("string"))
    return slim.mapInArrow(agg, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def labels_in_force(stats: DataFrame, c: Drift = Drift()) -> DataFrame:
    """(series, batch, label, json_type, n, n_records) of the labels in force."""
    by = [c.series, c.batch]
    total = stats.where("label = ''").groupBy(*by).agg(F.sum("n").alias("n_records"))
    kinds = stats.where("label <> ''").groupBy(*by, "label", "json_type").agg(F.sum("n").alias("n"))
    known = F.col("json_type") != "null"
    labels = kinds.groupBy(*by, "label").agg(
        F.min_by("json_type", F.struct((~known).cast("int"), -F.col("n"), F.col("json_type"))).alias("json_type"),
        F.sum("n").alias("n"),
    )
    return labels.join(total, by).where(F.col("n") * FORCE >= F.col("n_records"))


def _batch_pairs(stats: DataFrame, c: Drift) -> DataFrame:
    w = Window.partitionBy(c.series).orderBy(c.batch)
    return (
        stats.where("label = ''").select(c.series, c.batch).distinct()
        .withColumn("__prev", F.lag(c.batch).over(w)).where("__prev is not null")
    )


def _renames(records: DataFrame, gone_or_new: DataFrame, c: Drift) -> DataFrame:
    """Pairs (series, batch, old, new) of labels that hold the same values for the same files.

    gone_or_new: (series, batch, __prev, label, side, is_container). Only the labels listed there are
    read again, in only the batches concerned. A pair needs mutual best agreement of at least
    SAME_THING; equal agreement is settled by the closer parent, then by name.
    """
    s, b = c.series, c.batch
    sought = gone_or_new.select(s, F.when(F.col("side") == "old", F.col("__prev")).otherwise(F.col(b)).alias(b), "label")
    wanted = sought.groupBy(s, b).agg(F.collect_set("label").alias("__wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows: list[tuple] = []
            for se, ba, fi, d, w in zip(*(x.column(i).to_pylist() for i in range(5)), strict=True):
                doc = jsonx.read_document(d)
                if doc is not None:
                    rows += [(se, ba, fi, k, v) for k, v in jsonx.values_at(doc, set(w)).items() if v]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, arrow, strict=True)], names=names)

    names = [s, b, "__file", "label", "vals"]
    arrow = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
    slim = records.select(F.col(s).cast("string"), F.col(b).cast("int"), F.col(c.file).cast("string").alias("__file"), F.col(c.data).cast("string").alias("__data")).join(wanted, [s, b])
    held = slim.mapInArrow(read, f"`{s}` string, `{b}` int, __file string, label string, vals array<string>")
    held = held.where("__file is not null").withColumn("vals", F.array_distinct("vals"))

    def side(name: str) -> DataFrame:
        g = gone_or_new.where(F.col("side") == name)
        at = "__prev" if name == "old" else b
        g = g.select(s, F.col(b).alias("__later"), F.col(at).alias("__at"), "label", "is_container")
        h = held.withColumnRenamed(b, "__at")
        return h.join(g, [s, "__at", "label"]).select(
            s, F.col("__later").alias(b), "__file", "is_container", F.col("label").alias(name), F.col("vals").alias(f"{name}_vals")
        )

    both = side("old").join(side("new"), [s, b, "__file", "is_container"])
    most = F.greatest(F.size("old_vals"), F.size("new_vals"))
    scored = both.groupBy(s, b, "old", "new").agg(
        F.avg(F.size(F.array_intersect("old_vals", "new_vals")) / most).alias("score")
    ).where(F.col("score") >= SAME_THING)
    parent = lambda x: F.regexp_replace(x, r"\.?[^.]*$", "")
    leaf = lambda x: F.regexp_extract(x, r"([^.]*)$", 1)
    near = (parent("old") == parent("new")).cast("int") + (leaf("old") == leaf("new")).cast("int")
    rank = [F.desc(F.round("score", 6)), F.desc(near)]
    return (
        scored.withColumn("__a", F.row_number().over(Window.partitionBy(s, b, "old").orderBy(*rank, "new")))
        .withColumn("__b", F.row_number().over(Window.partitionBy(s, b, "new").orderBy(*rank, "old")))
        .where("__a = 1 and __b = 1").select(s, b, "old", "new")
    )


def label_changes(records: DataFrame, c: Drift = Drift(), stats: DataFrame | None = None) -> DataFrame:
    """(series, batch, change_kind, label, detail) against the batch before in the same series.

    added / removed / renamed / retyped as labels come into, go out of force, are replaced by another
    label with the same values for the same files, or change their JSON type. Labels below a reported
    label are left out. A series with one batch, or a table without readable data, has no changes.
    """
    s, b = c.series, c.batch
    stats = cut(type_statistics(records, c)) if stats is None else stats
    pairs = _batch_pairs(stats, c)
    force = labels_in_force(stats, c).select(s, b, "label", "json_type")
    above = force.select(s, b, F.regexp_replace("label", r"\.[^.]*$", "").alias("label")).distinct().withColumn("__c", F.lit(1))
    force = force.join(above, [s, b, "label"], "left").withColumn("is_container", F.col("__c").isNotNull()).drop("__c")
    now = force.join(pairs, [s, b]).withColumnsRenamed({"json_type": "__t1", "is_container": "__c1"})
    was = (
        force.withColumnRenamed(b, "__prev").join(pairs, [s, "__prev"])
        .withColumnsRenamed({"json_type": "__t0", "is_container": "__c0"})
    )
    diff = cut(now.join(was, [s, b, "__prev", "label"], "full_outer").where("__t0 is null or __t1 is null or (__t0 <> __t1 and __t0 <> 'null' and __t1 <> 'null')"))
    gone_or_new = diff.where("__t0 is null or __t1 is null").select(
        s, b, "__prev", "label", F.when(F.col("__t1").isNull(), "old").otherwise("new").alias("side"),
        F.coalesce("__c1", "__c0").alias("is_container"),
    )
    both_sides = gone_or_new.groupBy(s, b).agg(F.count_distinct("side").alias("__n")).where("__n = 2").select(s, b)
    renamed = cut(_renames(records, gone_or_new.join(both_sides, [s, b]), c))
    used = renamed.select(s, b, F.explode(F.array("old", "new")).alias("label"))
    empty = F.lit("")
    plain = diff.join(used, [s, b, "label"], "left_anti").select(
        s, b,
        F.when(F.col("__t0").isNull(), "added").when(F.col("__t1").isNull(), "removed").otherwise("retyped").alias("change_kind"),
        "label", F.when(F.col("__t0").isNull() | F.col("__t1").isNull(), empty).otherwise(F.col("__t1")).alias("detail"),
    )
    found = plain.unionByName(renamed.select(s, b, F.lit("renamed").alias("change_kind"), F.col("old").alias("label"), F.col("new").alias("detail")))
    told = found.select(s, b, F.explode(F.when(F.col("change_kind") == "renamed", F.array("label", "detail")).otherwise(F.array("label"))).alias("label"))
    told = told.groupBy(s, b).agg(F.collect_set("label").alias("__told"))
    return (
        found.join(told, [s, b])
        .where(~F.exists("__told", lambda r: F.col("label").startswith(F.concat(r, F.lit(".")))))
        .select(s, b, "change_kind", "label", "detail")
    )


def notation_changes(paths: DataFrame, series: str, batch: str, field: str) -> DataFrame:
    """(series, batch) from which on most paths are written in another way than in the batch before.

    Paths that do not show how element numbers stand count only where no path of the batch does.
    Null or empty paths count for nothing; ties go to the first notation in code-point order.
    """
    n = paths.where(F.col(field).isNotNull() & (F.trim(field) != "")).groupBy(series, batch, notation(F.col(field)).alias("__way")).count()
    w = Window.partitionBy(series, batch).orderBy(F.col("__way").endswith("?").cast("int"), F.desc("count"), "__way")
    most = n.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    prev = F.lag("__way").over(Window.partitionBy(series).orderBy(batch))
    return most.withColumn("__before", prev).where("__before is not null and __before <> __way").select(series, batch)


def batchwise(results: DataFrame, c: Drift = Drift(), rows_at_once: int = 20_000) -> DataFrame:
    """Each record once, with the records of a batch side by side, about ``rows_at_once`` of them to a task.

    One shuffle serves both, and what is counted per batch is then counted before it is moved again. Larger
    batches, counted from their keys alone, are spread over more tasks by the hash of the record, so the work of
    a task stays the same however large a batch is.
    """
    keys = [c.record, c.series, c.batch, c.file, c.data, c.delivered]
    r = results.select(*keys)
    large = cut(r.groupBy(c.series, c.batch).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_at_once))
    n = large.count()
    at = [c.series, c.batch]
    if n:  # at most one row in so many of the input; sent to all only where that is little
        r = r.join(F.broadcast(large) if n <= 100_000 else large, at, "left")
        salt = F.pmod(F.xxhash64(c.record), F.ceil(F.coalesce("__n", F.lit(1)) / rows_at_once)).cast("int")
        r, at = r.select(*keys, salt.alias("__salt")), [*at, "__salt"]
    return first_delivery(r.repartition(*at), [*at, c.record], [c.delivered]).drop("__salt")


def change_report(results: DataFrame, examples: DataFrame) -> DataFrame:
    """Changes of result records and of the paths in evaluation rows in one table (origin first)."""
    records = batchwise(results)
    a = label_changes(records).select(F.lit("extraction_result").alias("origin"), "series_id", "batch_no", "change_kind", "label", "detail")
    once = first_delivery(examples.select("example_id", "series_id", "batch_no", "field", "loaded_at"), ["example_id"], ["loaded_at"])
    b = notation_changes(once, "series_id", "batch_no", "field").select(
        F.lit("incorrect_examples").alias("origin"), "series_id", F.col("batch_no").cast("int").alias("batch_no"),
        F.lit("notation").alias("change_kind"), F.lit("").alias("label"), F.lit("").alias("detail"),
    )
    return a.unionByName(b)


@dataclass(frozen=True)
class Column:
    label: str
    aliases: tuple[str, ...]
    numeric: bool
    many: bool


def consistent_columns(records: DataFrame, c: Drift = Drift(), max_columns: int = 2_000) -> list[Column]:
    """The columns of the consistent table: labels of scalars, in force or not, renamed ones under one name.

    At most the ``max_columns`` labels with most batches and records; the values of all others stay in the
    table's map of further labels. Read on the driver from schema-sized statistics, one row per label chosen
    and one per rename between two of these.
    """
    stats = cut(type_statistics(records, c, values=True))
    force = labels_in_force(stats, c)
    use = force.groupBy("label").agg(F.count("*").alias("batches"))
    kinds = stats.where("label <> ''").groupBy("label").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_numeric"), F.col("n")).otherwise(0)).alias("numeric"),
        F.sum(F.when(F.col("is_many"), F.col("n")).otherwise(0)).alias("many"),
        F.sum(F.when(F.col("has_scalar"), F.col("n")).otherwise(0)).alias("scalar"),
    ).where("scalar > 0")
    chosen = cut(kinds.join(use, "label", "left").na.fill(0, ["batches"]).orderBy(F.desc("batches"), F.desc("n"), "label").limit(max_columns))
    rows = {r["label"]: r for r in chosen.collect()}
    known = chosen.select("label")
    pairs = label_changes(records, c, stats).where("change_kind = 'renamed'").select("label", "detail").distinct()
    pairs = pairs.join(known, "label", "left_semi").join(known.withColumnRenamed("label", "detail"), "detail", "left_semi").collect()
    head: dict[str, str] = {}

    def find(x: str) -> str:
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for p in sorted((p["label"], p["detail"]) for p in pairs):
        a, b = map(find, p)
        if a != b:
            head[b] = a
    groups: dict[str, list[str]] = {}
    for label in rows:
        groups.setdefault(find(label), []).append(label)
    out = []
    for members in groups.values():
        at = [rows[m] for m in members]
        scalar = sum(r["scalar"] for r in at)
        best = min(at, key=lambda r: (-r["batches"], -r["n"], r["label"]))["label"]
        out.append(Column(best, tuple(sorted(members)), sum(r["numeric"] for r in at) * 10 >= 9 * scalar, any(r["many"] for r in at)))
    return sorted(out, key=lambda x: x.label)


def raw_values(records: DataFrame, columns: list[Column], c: Drift = Drift()) -> DataFrame:
    """Each readable record's ids, ``raw``: column label -> list of (json_type, text), renames applied, and
    ``rest``: label -> the same for every label that is in no column. Together they hold every scalar."""
    to = {a: col.label for col in columns for a in col.aliases}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, maps, rests = [[] for _ in range(b.num_columns - 1)], [], []
            for *key, d in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                doc = jsonx.read_document(d)
                if doc is None:
                    continue
                m: dict[str, list] = {}
                rest: dict[str, list] = {}
                for label, (_, vals) in jsonx.path_values(doc).items():
                    if vals:
                        name = to.get(label)
                        put = rest.setdefault(label, []) if name is None else m.setdefault(name, [])
                        put.extend({"json_type": jsonx.json_type(v), "text": jsonx.scalar_text(v)} for v in vals)
                for x, v in zip(ids, key, strict=True):
                    x.append(v)
                maps.append(list(m.items()))
                rests.append(list(rest.items()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(ids, arrow, strict=True)), pa.array(maps, held), pa.array(rests, held)], names=names)

    held = pa.map_(pa.string(), pa.list_(pa.struct([("json_type", pa.string()), ("text", pa.string())])))
    names = [c.record, c.series, c.batch, c.file, "raw", "rest"]
    arrow = [pa.int64(), pa.string(), pa.int32(), pa.string()]
    slim = records.select(F.col(c.record).cast("bigint"), F.col(c.series).cast("string"), F.col(c.batch).cast("int"), F.col(c.file).cast("string"), F.col(c.data).cast("string"))
    map_ = "map<string,array<struct<json_type:string,text:string>>>"
    return slim.mapInArrow(read, f"`{c.record}` bigint, `{c.series}` string, `{c.batch}` int, `{c.file}` string, raw {map_}, rest {map_}")


def column_names(columns: list[Column], taken: tuple[str, ...] = ("result_id", "series_id", "batch_no", "file", "further_labels")) -> dict[str, str]:
    """Label -> column name: dots become '__'; names that differ only in case, or clash with an id, get a number."""
    used, out = {x.lower() for x in taken}, {}
    for col in columns:
        base = name = col.label.replace(".", "__")
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        out[col.label] = name
    return out


def _clean(x):
    return F.trim(F.translate(x, "０１２３４５６７８９．－＋", "0123456789.-+"))


def consistent_table(records: DataFrame, columns: list[Column], c: Drift = Drift()) -> DataFrame:
    """One row per readable record, the same typed columns for all batches, named by ``column_names``.

    Numbers are double, everything else string; labels of which a record has several values become arrays in
    document order. A value that does not fit its type is null here and counted by ``cast_failures``, as are
    the values after the first where a record has several only under an old and a new name. ``further_labels``
    holds what is in no column: label -> its values as text.
    """
    raw = raw_values(records, columns, c)
    cols, names = [], column_names(columns)
    for col in columns:
        got = F.col("raw")[col.label]
        if col.numeric:
            got = F.transform(got, lambda v: _clean(v["text"]).try_cast("double"))
        else:
            got = F.transform(got, lambda v: v["text"])
        cols.append((got if col.many else F.try_element_at(got, F.lit(1))).alias(names[col.label]))
    rest = F.transform_values("rest", lambda _, got: F.transform(got, lambda v: v["text"]))
    return raw.select(c.record, c.series, c.batch, c.file, *cols, rest.alias("further_labels"))


def cast_failures(records: DataFrame, columns: list[Column], c: Drift = Drift()) -> DataFrame:
    """(label, target_type, json_type, n_values, n_failed, n_unheld, example) for every label and raw type.

    ``n_unheld`` counts values after the first of a record in a column that is no array. Labels without a column
    have the target type 'further'; their values are kept as text.
    """
    single = F.array(*[F.lit(x.label) for x in columns if not x.many]).cast("array<string>")
    numeric = F.array(*[F.lit(x.label) for x in columns if x.numeric]).cast("array<string>")
    raw = raw_values(records, columns, c)
    rows = raw.select(F.lit(True).alias("held"), F.explode("raw").alias("label", "vals")).unionByName(raw.select(F.lit(False).alias("held"), F.explode("rest").alias("label", "vals")))
    rows = rows.select("held", "label", F.posexplode("vals").alias("at", "v"))
    is_num = F.col("held") & F.array_contains(numeric, F.col("label"))
    text = _clean(F.col("v.text"))
    bad = is_num & (text != "") & text.try_cast("double").isNull()
    target = F.when(~F.col("held"), "further").when(is_num, "double").otherwise("string")
    return rows.groupBy("label", target.alias("target_type"), F.col("v.json_type").alias("json_type")).agg(
        F.count("v.text").alias("n_values"), F.count(F.when(bad, 1)).alias("n_failed"),
        F.count(F.when(F.col("held") & (F.col("at") > 0) & F.array_contains(single, F.col("label")), F.col("v.text"))).alias("n_unheld"), F.min(F.when(bad, F.col("v.text"))).alias("example"),
    )
