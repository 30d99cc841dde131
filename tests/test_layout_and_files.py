"""Layout folds, schema, folders, extraction."""

import json

import pytest
from pyspark.sql import functions as F

from strataline.functions.html import to_html
from strataline.functions.text import display_width
from strataline.operators import extract, layout, schema
from strataline.sources import files


def test_vertical_words(spark):
    rows = [("p", 0, "縦", 10.0, 0.0, 12.0, 3.0), ("p", 1, "書", 10.4, 4.0, 12.5, 7.0), ("p", 2, "き", 10.0, 12.0, 12.0, 15.0), ("p", 3, "word", 0.0, 1.0, 9.0, 2.0)]
    w = spark.createDataFrame(rows, "page string, seq int, text string, x0 double, top double, x1 double, bottom double")
    got = {(r.text, r.x0, r.top, r.x1, r.bottom, r.n_chars) for r in layout.vertical_words(w, ["page"]).collect()}
    assert got == {("縦書", 10.0, 0.0, 12.5, 7.0, 2), ("き", 10.0, 12.0, 12.0, 15.0, 1), ("word", 0.0, 1.0, 9.0, 2.0, 1)}


def test_spatial_text(spark):
    t = "=== Page 1 ===\n[x=0,y=10] 深度\n[x=100,y=12] N\n[x=0,y=25] 1\nnoise\n=== Page 2 ===\n=== Page 3 ===\n[x=50,y=1] z"
    df = spark.createDataFrame([(1, t), (2, "none"), (3, None)], "k int, t string")
    got = {r.k: r.spatial for r in layout.spatial_text(df, "k", "t").collect()}
    assert got == {1: "=== Page 1 ===\n深度" + " " * 16 + "N\n1\n=== Page 3 ===\n" + " " * 10 + "z"}


def test_row_anchor_not_last(spark):
    df = spark.createDataFrame([("p", i, 0.0, float(y)) for i, y in enumerate((0, 5, 8, 9, 17, 18))], "page string, seq long, x double, y double")
    assert [r.row_no for r in layout.row_breaks(df, ["page"]).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2]


def test_overlap(spark):
    rows = [("a", "x", 0.0, 0.0, 5.0, 5.0, 0, 0), ("a", "y", 4.0, 4.0, 9.0, 9.0, 0, 1), ("b", "x", 0.0, 0.0, 5.0, 5.0, 0, 0), ("b", "x", 0.1, 0.0, 5.1, 5.0, 0, 1), ("c", " ", 0.0, 0.0, 5.0, 5.0, 0, 0)]
    df = spark.createDataFrame(rows, "page string, ch string, x0 double, y0 double, x1 double, y1 double, block int, line int")
    assert {r.page: r.has_overlap for r in layout.overlapping_pages(df, ["page"]).collect()} == {"a": True, "b": False, "c": False}


def test_table_and_width(spark):
    df = spark.createDataFrame([([["a", None], ["b\nc", "d"]],), ([],)], "g array<array<string>>")
    assert [r[0] for r in df.select(layout.table_markdown(F.col("g"))).collect()] == ["| a |  |\n| --- | --- |\n| b c | d |", ""]
    w = spark.createDataFrame([("aｂ漢",), (None,)], "t string")
    assert [r[0] for r in w.select(display_width(F.col("t"))).collect()] == [5, 0]


def test_schema(spark):
    n = "doc string, node int, parent int, parent_label string, label string, path string, kind string"
    rows = [("a", 0, None, "", "", "", "object"), ("a", 1, 0, "", "x", "x", "string"), ("a", 2, 0, "", "y", "y", "string"), ("b", 0, None, "", "", "", "object"), ("b", 1, 0, "", "x", "x", "object")]
    df = spark.createDataFrame(rows, n)
    assert {(r.label, tuple(r.kinds), r.required) for r in schema.infer(df).collect()} == {("x", ("object", "string"), True), ("y", ("string",), False)}
    own = schema.infer(df.where("doc = 'a'"))
    assert {(r.doc, r.location, r.label, r.problem) for r in schema.violations(df, own).collect()} == {("b", "root", "y", "missing"), ("b", "x", "x", "kind object")}


def test_folders(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/f1.xml").write_text("<r><a> 01 </a><l><v>1</v></l><l><v>2</v></l><e/></r>")
    got = files.scan_xml(spark, str(tmp_path / "xml")).collect()
    assert [(r.file, json.loads(r.record)) for r in got] == [("f1", {"a": "01", "l": [{"v": "1"}, {"v": "2"}], "e": ""})]
    (tmp_path / "xml/bad.xml").write_text("<r/>")
    assert sorted((r.file, r.error is None) for r in files.scan_xml(spark, str(tmp_path / "xml"), "keep").collect()) == [("bad", False), ("f1", True)]
    d = tmp_path / "results_m1/p1"
    d.mkdir(parents=True)
    (d / "f1.json").write_text('{"_metadata": {"retry_count": 2}, "a": 1}')
    (d / "f2.json").write_text('{"a": 1}')
    r = files.scan_results(spark, str(tmp_path))
    assert sorted((x.llm, x.parse_type, x.file, x.retry_count) for x in r.collect()) == [("m1", "p1", "f1", 2), ("m1", "p1", "f2", 0)]
    assert files.scan_results(spark, str(tmp_path), ["other"]).count() == 0
    assert [tuple(x) for x in files.discover_runs(r, ["m1"]).collect()] == [("m1", "p1")]
    files.write_tsv(spark.createDataFrame([("m", 0.5, None)], "llm string, f1 double, n int"), str(tmp_path / "tsv"))
    assert next((tmp_path / "tsv").glob("*.csv")).read_text() == "llm\tf1\tn\nm\t0.5000\t\n"
    files.write_labels(spark.createDataFrame([("b",), ("a",)], "label string"), str(tmp_path / "labels"))
    assert next((tmp_path / "labels").glob("part*.txt")).read_text().strip() == '["a","b"]'
    for _ in range(2):
        files.write_json(spark.createDataFrame([("f", "e")], "file string, error string"), str(tmp_path / "err"), append=True)
    assert spark.read.json(str(tmp_path / "err")).count() == 2


def test_listing(spark):
    f = spark.createDataFrame([("a", "md"), ("a", "txt"), ("b", "html"), ("c", "pdf")], "stem string, kind string")
    assert [tuple(r) for r in files.list_inputs(f).collect()] == [("a", "txt"), ("b", "html")]
    t = spark.createDataFrame([("b", 0), ("", 1), ("a", 2)], "stem string, ord int")
    assert [r.stem for r in files.list_inputs(f, t).collect()] == ["b", "a"]
    assert [r.stem for r in files.list_inputs(f, t, offset=1, limit=1).collect()] == ["a"]


def test_extract_keeps_parts_and_retries(spark):
    seen = []

    class Fake(extract.OfflineExtractor):
        def ask(self, parts):
            seen.append(list(parts))
            return super().ask(parts)

    r = extract.extract_one(Fake(1), ["text"], ["chars"])
    assert r["retry_count"] == 1 and len(seen) == 2 and seen[1][0] == "text" and len(seen[1]) == 2
    with pytest.raises(ValueError):
        extract.extract_one(Fake(9), ["text"], [])
    df = spark.createDataFrame([("0", "t"), ("3", "t"), ("1", None)], "file string, text string")
    out = {x.file: x for x in extract.extract(df, lambda f: extract.OfflineExtractor(int(f)), ["chars"]).collect()}
    assert out["0"].error is None and out["1"].retry_count == 1 and out["3"].data is None and out["3"].error


def test_html():
    assert to_html("# A\n\n| a | b |\n|---|---|\n| 1 | <2 |\n\ntext") == "<h1>A</h1>\n<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>&lt;2</td></tr></tbody></table>\n<p>text</p>"
    assert to_html(None) is None and to_html("") == ""


def test_json_schema_and_problems():
    record = {"h": {"a": "1", "n": 2}, "l": [{"x": "1", "y": "2"}, {"x": "3", "z": {"q": "4"}}], "m": ["a", {"b": "c"}], "e": []}
    got = schema.json_schema(record)
    assert got["required"] == ["e", "h", "l", "m"] and got["properties"]["l"]["items"]["required"] == ["x"]
    assert got["properties"]["l"]["items"]["properties"]["z"] == {"type": "object", "properties": {"q": {"type": "string"}}, "required": ["q"]}
    assert got["properties"]["m"]["items"]["anyOf"][0] == {"type": "string"} and got["properties"]["e"] == {"type": "array"}
    assert schema.problems(record, got) == []
    wrong = {"h": {"a": 1}, "l": [{"y": "2"}, "s"], "m": [1], "e": []}
    assert [(".".join(map(str, at)), said) for at, said in schema.problems(wrong, got)] == [
        ("h", "'n' is a required property"), ("h.a", "1 is not of type 'string'"), ("l.0", "'x' is a required property"), ("l.1", "'s' is not of type 'object'"), ("m.0", "1 is not valid under any of the given schemas")]
    with pytest.raises(ValueError, match="^Schema validation failed:\n  - root: 'b' is a required property$"):
        schema.validate({}, schema.json_schema({"b": "1"}))


def test_extraction_checks_the_answer(spark, tmp_path):
    class Scripted:
        """Answers in turn, and keeps what it was asked."""

        def __init__(self, *answers):
            self.answers, self.asked = list(answers), []

        def ask(self, parts):
            self.asked.append(list(parts))
            return self.answers.pop(0), 10, 1

    s = Scripted("not json", '```json\n{"a": 1}\n```', '{"a": "x"}')
    r = extract.extract_checked(s, "body", schema.json_schema({"a": "1"}), extract.Prompts("S {schema} T {text}", "retry {errors}"))
    assert (r["retry_count"], r["input_tokens"], r["output_tokens"], r["data"]) == (2, 30, 3, '{"a": "x"}')
    assert s.asked[0][0].startswith("S {") and s.asked[0][0].endswith("T body") and s.asked[1][0] == s.asked[0][0] and len(s.asked[1]) == 4 and "not of type 'string'" in s.asked[2][3]
    (tmp_path / "p").mkdir()
    for n, t in (("text_prefix.txt", "P\n"), ("simple_schemaless.txt", "C\n\n"), ("retry.txt", "R")):
        (tmp_path / "p" / n).write_text(t)
    assert extract.Prompts.load(str(tmp_path / "p")) == extract.Prompts("P\nC", "R")
    rows = [("f1", "t", '{"a": "1"}'), ("f2", "t", '{"a": "1"}'), ("f3", "t", None)]
    df = spark.createDataFrame(rows, "file string, text string, record string")
    make = lambda f: Scripted(*(['{"a": "ok"}'] if f == "f1" else ["{}"] * 3))
    for _ in range(2):
        total = extract.run_extraction(df, str(tmp_path), "m", "position", make).first()
    assert (total.files, total.failed, total.input_tokens) == (1, 2, 10)
    assert json.loads((tmp_path / "results_m/position/f1.json").read_text()) == {"_metadata": {"retry_count": 0}, "a": "ok"}
    errors = spark.read.json(str(tmp_path / "errors_m/position")).collect()
    assert sorted(e.file for e in errors) == ["f2", "f2", "f3", "f3"] and any("required property" in e.error for e in errors)
    assert extract.extract(df, make).where("file = 'f2'").first().input_tokens == 30
    assert extract.extract(df.drop("record"), "offline", ["chars"]).where("error is null").count() == 3
    assert extract.extract(df.drop("record"), "claude", []).where("error like 'no backend%'").count() == 3


def test_parsed_texts(spark, tmp_path):
    from strataline.sources import parsed

    root = str(tmp_path)
    texts = spark.createDataFrame([("a", "=== Page 1 ===\n[x=0,y=1] t"), ("b", None)], "stem string, text string")
    parsed.register("position", lambda spark, folder: texts)
    assert parsed.derive(spark, root, "position") == 4
    assert (tmp_path / "parsed/position/a.txt").read_text().endswith("t") and (tmp_path / "parsed/position_spatial/a.txt").read_text() == "=== Page 1 ===\nt" and (tmp_path / "parsed/position_spatial/b.txt").read_text() == ""
    with pytest.raises(FileNotFoundError):
        parsed.derive(spark, root, "html")
    parsed.keep(spark.createDataFrame([("a", "# T")], "stem string, text string"), root, "pymupdf")
    assert (tmp_path / "parsed/pymupdf/a.md").read_text() == "# T" and parsed.derive(spark, root, "html") == 1
    assert (tmp_path / "parsed/pymupdf_html/a.html").read_text() == "<h1>T</h1>"
    for kind in ("html", "pymupdf4llm"):
        with pytest.raises(ValueError):
            parsed.extract_texts(spark, root, kind)
    assert files.input_dir("r", "jpg") == "r/pdf" and files.input_dir("r", "position") == "r/parsed/position"
    assert files.output_dir("r", "pdf", "m") == "r/results_m/pdf" and files.output_dir("r", "pdf", "m", "balanced") == "r/results_m/pdf_balanced"
    (tmp_path / "list.txt").write_text(" b \n\na\n")
    assert [tuple(r) for r in files.read_test_list(spark, f"{root}/list.txt").orderBy("ord").collect()] == [("b", 0), ("a", 2)] and files.read_test_list(spark, f"{root}/none.txt").count() == 0
    files.write_test_list(files.read_test_list(spark, f"{root}/list.txt"), f"{root}/out")
    assert next((tmp_path / "out").glob("part*.txt")).read_text() == "b\na\n"


def test_pages_that_cannot_be_read_count_as_overlapping(spark):
    chars = spark.createDataFrame([("a", "x", 0.0, 0.0, 1.0, 1.0, 0, 0)], "page string, ch string, x0 double, y0 double, x1 double, y1 double, block int, line int")
    failed = spark.createDataFrame([("b",)], "page string")
    assert {r.page: r.has_overlap for r in layout.overlapping_pages(chars, ["page"], failed).collect()} == {"a": False, "b": True}


def test_answers_against_the_schema_of_their_record(spark):
    rows = [(1, '{"a": {"b": "1", "c": "2"}}', 'so: {"a": {"b": 1}, "_metadata": {}}'), (2, '{"a": "1"}', '{"a": "2"}'), (3, '{"a": "1"}', '{"a": '), (4, '{"a": "1"}', None), (5, None, "{}")]
    df = spark.createDataFrame(rows, "id int, record string, data string")
    got = sorted((r.id, r.location, r.message) for r in schema.answer_problems(df, ["id"], "record", "data").collect())
    assert got == [(1, "a", "'c' is a required property"), (1, "a.b", "1 is not of type 'string'"), (3, "root", "no complete JSON"), (4, "root", "no complete JSON")]
