"""Drift, packed fields, nested records."""

import json
import random

from strataline.functions import jsonx
from strataline.operators import drift, nested, packed
from strataline.operators.dedupe import first_delivery
from strataline.plans import core_queries


def records(spark, rows):
    return spark.createDataFrame([(i, s, b, f, json.dumps(d, ensure_ascii=False) if isinstance(d, (dict, list)) else d, None) for i, (s, b, f, d) in enumerate(rows)],
                                 "result_id long, series_id string, batch_no int, file string, data string, loaded_at timestamp")


def changes(spark, rows):
    return sorted((r.series_id, r.batch_no, r.change_kind, r.label, r.detail) for r in drift.label_changes(records(spark, rows)).collect())


def test_changes(spark):
    rows = []
    for f in "pqr":
        rows.append(("s", 1, f, {"h": {"a": f + "1", "b": "2", "n": "3", "gone": "z" + f}}))
        rows.append(("s", 2, f, {"h": {"b": {"v": "2"}, "n": 3, "new": "y"}, "k": {"alpha": f + "1"}}))
    got = changes(spark, rows)
    assert ("s", 2, "renamed", "h.a", "k.alpha") in got
    assert ("s", 2, "retyped", "h.b", "object") in got and ("s", 2, "retyped", "h.n", "number") in got
    assert ("s", 2, "removed", "h.gone", "") in got and ("s", 2, "added", "h.new", "") in got
    assert ("s", 2, "added", "k", "") in got
    assert not any(r[3].startswith("h.b.") for r in got)


def test_changes_edge_cases(spark):
    assert changes(spark, [("s", 1, "f", None), ("s", 2, "f", "{broken"), ("s", 3, "f", "")]) == []
    assert drift.label_changes(records(spark, [("s", 1, "f", {"a": 1})]).limit(0)).count() == 0
    # a container that moves is reported once, not with what is below it
    rows = [("s", b, f, {("old" if b == 1 else "new"): [{"x": f, "y": "7" + f}]}) for b in (1, 2) for f in "abc"]
    assert changes(spark, rows) == [("s", 2, "renamed", "old", "new")]
    # a null value keeps a label in force and does not retype it
    assert changes(spark, [("s", 1, "f", {"a": "1"}), ("s", 2, "f", {"a": None})]) == []


def test_notation_change(spark):
    rows = [("s", 1, "a.b[0].c"), ("s", 1, "a.b"), ("s", 2, "a.b[1].c"), ("s", 2, "['a']['b']"), ("s", 3, "['a']['b'][0]"), ("s", 3, "['a']['c']"), ("s", 3, None), ("s", 4, "a/b/0")]
    df = spark.createDataFrame(rows, "series_id string, batch_no int, field string")
    assert sorted(tuple(r) for r in drift.notation_changes(df, "series_id", "batch_no", "field").collect()) == [("s", 3), ("s", 4)]


def test_consistent_table(spark):
    rows = [("s", b, f, {("a" if b == 1 else "alpha"): {"p": 1.5, "q": "2,5x"}[f], "l": [{"v": "１"}, {"v": 2}]}) for b in (1, 2) for f in "pq"]
    r = records(spark, rows * 1)
    cols = drift.consistent_columns(r)
    assert {c.label: c.many for c in cols} == {"a": False, "l.v": True} or {c.label for c in cols} == {"alpha", "l.v"}
    out = drift.consistent_table(r, cols).collect()
    assert len(out) == 4 and all(x["l__v"] == [1.0, 2.0] for x in out)
    clash = [drift.Column(x, (x,), False, False) for x in ("file", "a.b", "A.b")]
    assert drift.column_names(clash) == {"file": "file_2", "a.b": "a__b", "A.b": "A__b_2"}
    assert sum(x.n_failed for x in drift.cast_failures(r, cols).collect()) == 0


def test_columns_of_labels_never_in_force(spark):
    rows = [("s", b, f"f{i}", {"a": str(i), **({"rare": {"n": "7" if i else "x7"}} if i < 1 or (b, i) == (2, 1) else {})}) for b in (1, 2) for i in range(20)]
    r = records(spark, rows)
    cols = drift.consistent_columns(r)
    assert [c.label for c in cols] == ["a", "rare.n"]
    assert sorted(x.rare__n for x in drift.consistent_table(r, cols).collect() if x.rare__n) == ["7", "x7", "x7"]
    assert {x.label: x.n_values for x in drift.cast_failures(r, cols).collect()} == {"a": 40, "rare.n": 3}


def test_columns_hold_every_value(spark):
    rows = [("s", b, f"f{i}", {"few": ["1", "2"] if (b, i) == (2, 0) else "1", "list": [f"x{i}", "y"], "one": [i], "kind": {"z": "q"} if i else "plain"}) for b in (1, 2) for i in range(20)]
    r = records(spark, rows)
    cols = drift.consistent_columns(r)
    assert {c.label: (c.numeric, c.many) for c in cols} == {"few": (True, True), "kind": (False, False), "kind.z": (False, False), "list": (False, True), "one": (True, False)}
    out = {(x.batch_no, x.file): x for x in drift.consistent_table(r, cols).collect()}
    assert out[2, "f0"].few == [1.0, 2.0] and out[1, "f3"].list == ["x3", "y"] and out[1, "f3"].one == 3.0 and out[1, "f0"].kind == "plain"
    report = drift.cast_failures(r, [drift.Column("list", ("few", "list"), False, False)]).collect()
    assert {(x.label, x.n_values, x.n_unheld) for x in report if x.target_type != "further"} == {("list", 121, 81)}
    assert {(x.label, x.n_values) for x in report if x.target_type == "further"} == {("kind", 2), ("kind.z", 38), ("one", 40)}


def test_table_and_report_hold_every_value(spark):
    """Values in = values of the table + values reported, whatever the number of columns."""
    rng = random.Random(8)

    def make(d=0):
        r = rng.random()
        if d < 3 and (r < 0.5 or d == 0):
            return {rng.choice("abcdef") + str(rng.randint(0, 2)): make(d + 1) for _ in range(rng.randint(0, 4))}
        if d < 3 and r < 0.7:
            return [make(d + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(["x", "7", 7, 2.5, True, '{"q": [1, "2"]}', "７"])

    docs = [make() for _ in range(150)]
    r = records(spark, [("s", i % 3, f"f{i}", d) for i, d in enumerate(docs)])
    want = {}
    for i, d in enumerate(docs):
        for label, (_, met) in jsonx.path_values(d).items():
            for v in met:
                want[i] = want.get(i, 0) + (v is not None)
    for most in (2_000, 5, 1):
        cols = drift.consistent_columns(r, max_columns=most)
        assert len(cols) <= most
        failed = {(x.label, x.target_type, x.json_type): (x.n_failed, x.n_unheld, x.n_values) for x in drift.cast_failures(r, cols).collect()}
        held = 0
        for row in drift.consistent_table(r, cols).collect():
            for k, v in row.asDict().items():
                if k == "further_labels":
                    held += sum(y is not None for x in v.values() for y in x)
                elif k not in ("result_id", "series_id", "batch_no", "file"):
                    held += sum(y is not None for y in v) if isinstance(v, list) else v is not None
        assert held + sum(a + b for a, b, _ in failed.values()) == sum(want.values()) == sum(n for _, _, n in failed.values())


def test_large_batches_are_spread(spark):
    rows = [("s", 1 if i % 3 else 2, f"f{i}", {"a": i}) for i in range(300)]
    r = records(spark, rows + rows[:0])
    got = drift.batchwise(r.unionByName(r), rows_at_once=40)
    assert got.count() == 300 and got.select("result_id").distinct().count() == 300
    assert sorted((x.batch_no, x.label, x.n) for x in drift.type_statistics(got).collect()) == [(1, "", 200), (1, "a", 200), (2, "", 100), (2, "a", 100)]


def test_records_nested_to_any_depth(spark):
    deep = '{"a":' * 5000 + '{"b": [{"c": "1"}]}' + "}" * 5000
    r = spark.createDataFrame([(1, "s", 1, "f", "text " + deep + " more", None), (2, "s", 1, "g", deep[:-1], None)], "result_id long, series_id string, batch_no int, file string, data string, loaded_at timestamp")
    stats = drift.type_statistics(r).where("label <> ''").collect()
    assert len(stats) == 5002 and {x.json_type for x in stats} == {"object", "array", "string"}


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 1), (None, "x", 1)], "k int, v string, t int")
    assert sorted((r.k or 0, r.v) for r in first_delivery(df, ["k"], ["t"]).collect()) == [(0, "x"), (0, "x"), (1, "a")]


def test_read_document():
    assert jsonx.read_document('text ```json\n{"a": 1}\n``` more') == {"a": 1}
    assert jsonx.read_document('see {the} record: {"a": [1]} end') == {"a": [1]}
    assert jsonx.read_document('{"a": [1, {"b": 2}') is None
    assert jsonx.read_document('"{\\"a\\": 1}"') == {"a": 1}
    assert jsonx.read_document(None) is None and jsonx.read_document("") is None and jsonx.read_document("12") is None


def items(spark, cells, kind="k"):
    df = spark.createDataFrame([(i, kind, c, None) for i, c in enumerate(cells)], "id long, kind string, xml string, llm string")
    out = {}
    for r in packed.unpack(df, "id", "kind", ["xml", "llm"]).collect():
        out.setdefault(r.id, []).append((r.pos, r.item))
    return [[v for _, v in sorted(out.get(i, []))] for i in range(len(cells))]


def test_packed(spark):
    rng = random.Random(1)
    words = ["円礫", "木片", "貝殻片", "酸化鉄", "軽石粒", "粘土塊"]
    noise = ["、".join(rng.sample(words, rng.randint(2, 4))) for _ in range(60)] + [rng.choice([" / ", ",", "・", "\n"]).join(rng.sample(words, 2)) for _ in range(60)]
    special = {
        "(円礫, 木片)": ["円礫", "木片"], '["円礫", "木片\\"大\\""]': ["円礫", '木片"大"'], "「円礫、木片」": [], "「円礫/木片」/「酸化鉄」": ["円礫/木片", "酸化鉄"],
        "木片（黄褐、細粒）、円礫": ["木片（黄褐、細粒）", "円礫"], "、円礫、、木片、": ["円礫", "木片"], '"木片""大"""|円礫': ['木片"大"', "円礫"], "円礫": [], "": [],
        "円礫\\n木片, 酸化鉄": ["円礫", "木片", "酸化鉄"], "木片（黄褐、細粒）": [],
    }
    got = items(spark, noise + list(special))[len(noise):]
    assert dict(zip(special, got, strict=True)) == special


def test_packed_numbers_and_round_trip(spark):
    rng = random.Random(3)
    lists = [[f"{rng.randint(1, 30)}.{rng.randint(0, 9)}" for _ in range(rng.randint(2, 5))] for _ in range(80)]
    cells = [rng.choice([", ", "; ", " / ", "|", "および", "\t", "<br>"]).join(x) for x in lists]
    got = items(spark, cells + ["7.4;6,820", "8,349"])
    assert got[:80] == lists and got[80] == ["7.4", "6,820"] and got[81] == []


def test_packed_cell_with_many_kinds_of_delimiter(spark):
    rng = random.Random(5)
    words = ["円礫", "木片", "貝殻片", "酸化鉄", "軽石粒", "粘土塊", "雲母片", "火山灰"]
    noise = ["、".join(rng.sample(words, rng.randint(2, 4))) for _ in range(80)] + [rng.choice(["，", ";", "|", "・", "\n", "/", "+"]).join(rng.sample(words, 3)) for _ in range(140)]
    seven = "円礫、木片;貝殻片|酸化鉄・軽石粒/粘土塊+雲母片，火山灰"
    got = items(spark, noise + [seven])
    assert got[-1] == ["円礫", "木片", "貝殻片", "酸化鉄", "軽石粒", "粘土塊", "雲母片", "火山灰"]
    assert len(packed.candidate_parses("a;b|c・d/e+f，g、h")) == 1 + 7 + 21 + 35 + 35 + 7 + 1
    assert len(packed.candidate_parses("、".join(["a"] * 3) + "".join(f"{d}a" for d in packed.DELIMITERS if d not in "+&"))) < 30_000


def test_packed_empty(spark):
    df = spark.createDataFrame([], "id long, kind string, xml string, llm string")
    assert packed.unpack(df, "id", "kind", ["xml", "llm"]).count() == 0


def brute_paths(doc, arrays):
    out = []

    def walk(label, path, up, v):
        if isinstance(v, str):
            v = jsonx.open_string(v)
        if isinstance(v, dict):
            if path:
                out.append((up, path))
            for k, x in v.items():
                y = jsonx.open_string(x) if isinstance(x, str) else x
                lab = f"{label}.{k}" if label else k
                p = f"{path}.{k}" if path else k
                walk(lab, p + "[0]" if isinstance(y, dict) and lab in arrays else p, path, y)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(label, f"{path}[{i}]", up, x)

    walk("", "", "", doc)
    return out


def test_nested(spark):
    rng = random.Random(4)

    def make(d=0):
        r = rng.random()
        if d < 4 and r < 0.5:
            return {k: make(d + 1) for k in rng.sample(["a", "b", "c[", "d"], rng.randint(0, 3))}
        if d < 4 and r < 0.7:
            return [make(d + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(["x", "", None, 1, '{"q": {"r": 1}}', '[{"s": 2}]', "{cut"])

    docs = [{"a": make(1), "b": make(1)} for _ in range(200)]
    rows = [(str(i), json.dumps(d)) for i, d in enumerate(docs)] + [("null", None), ("cut", '{"a": {"b": 1}, "c": [')]
    df = spark.createDataFrame(rows, "k string, data string")
    arrays = nested.array_labels(df, "data")
    nodes = nested.node_table(df, "k", "data").collect()
    got = sorted((n.rec_key, n.parent_path, n.path) for n in nodes if n.depth > 0)
    assert got == sorted((str(i), a, b) for i, d in enumerate(docs) for a, b in brute_paths(d, arrays))
    by = {(n.rec_key, n.pre): n for n in nodes}
    for n in nodes:
        if n.parent_pre is not None:
            up = by[n.rec_key, n.parent_pre]
            assert up.pre < n.pre and n.post < up.post
    assert nested.node_table(df.limit(0), "k", "data", arrays=set()).count() == 0


def test_scalars_in_arrays_are_rows(spark):
    doc = {"a": {"n": [1, None, "x", [2.5]], "m": '["y", {"z": 3}]', "k": True}, "b": ["q"]}
    rows = nested.node_table(spark.createDataFrame([("r", json.dumps(doc))], "k string, data string"), "k", "data", elements=True).collect()
    leaves = {n.path: n for n in rows if n.kind == "leaf"}
    assert {p: n.fields[""] for p, n in leaves.items()} == {"a.n[0]": "1", "a.n[1]": None, "a.n[2]": "x", "a.n[3][0]": "2.5", "a.m[0]": "y", "b[0]": "q"}
    up = {n.pre: n for n in rows if n.kind == "object"}
    assert all(up[n.parent_pre].path == n.parent_path and up[n.parent_pre].pre < n.pre < n.post < up[n.parent_pre].post for n in leaves.values())
    assert {n.parent_path for p, n in leaves.items() if p[0] == "a"} == {"a"} and leaves["b[0]"].parent_path == ""


def test_flat_tables_hold_every_value(spark, tmp_path):
    test = {"開始深度": "1.15", "打撃回数": [{"区間": "10", "回数": "3"}]}
    xml = {"コア情報": {"標準貫入試験": [test, {"開始深度": "2.15", "打撃回数": ["4", "6"]}], "備考": ["盛土", "埋土"]}}
    result = {"コア情報": {"標準貫入試験": {"開始深度": [1.15]}}}
    spark.createDataFrame([("f", json.dumps(xml), "1")], "file string, record string, loaded_at string").write.parquet(f"{tmp_path}/parse_xml.parquet")
    spark.createDataFrame([(1, "s", 1, "f", json.dumps(result), "1")], "result_id long, series_id string, batch_no int, file string, data string, loaded_at string").write.parquet(f"{tmp_path}/extraction_result.parquet")
    values = sorted(v for n in core_queries.p5_nodes(spark, str(tmp_path)).collect() for v in n.fields.values())
    assert values == sorted(["1.15", "10", "3", "2.15", "4", "6", "盛土", "埋土", "1.15"])
    blows = {(r.start_depth, r.span, r.blows) for r in core_queries.p5_spt_blows(spark, str(tmp_path)).collect()}
    assert blows == {("1.15", "10", "3"), ("2.15", None, "4"), ("2.15", None, "6")}
    assert core_queries.p5_found(spark, str(tmp_path)).where("origin = 'extraction_result'").count() == 2


def test_nodes_nested_to_any_depth(spark):
    n = 5000
    deep = '{"a":' * n + '{"b": [{"c": "1"}, "x"]}' + "}" * n
    df = spark.createDataFrame([("k", deep)], "k string, data string")
    rows = nested.node_table(df, "k", "data", elements=True).select("pre", "post", "parent_pre", "depth", "kind").collect()
    assert len(rows) == n + 3 and max(r.depth for r in rows) == n + 1
    at = {r.pre: r for r in rows}
    assert all(at[r.parent_pre].pre < r.pre < r.post < at[r.parent_pre].post for r in rows if r.parent_pre is not None)


def test_array_labels_looked_up_per_record(spark, monkeypatch):
    docs = [("1", '{"a": {"x": 1}, "b": {"y": {"z": 2}}}'), ("2", '{"a": [{"x": 1}], "b": {"y": [{"z": 2}, {"z": 3}]}}'), (None, '{"a": {"x": 5}}')]
    df = spark.createDataFrame(docs, "k string, data string")
    want = sorted((str(r.rec_key), r.path) for r in nested.node_table(df, "k", "data").collect())
    monkeypatch.setattr(nested, "LABELS_AT_ONCE", 1)
    assert sorted((str(r.rec_key), r.path) for r in nested.node_table(df, "k", "data").collect()) == want
    assert ("1", "b.y[0]") in want and ("None", "a[0]") in want
