"""Folders to reports end to end, the command line, and the stream."""

import json

from strataline import cli
from strataline.plans import pipeline
from strataline.streaming.incremental import judge_stream


def folder(tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/f1.xml").write_text("<r><h><a>1</a><b>x</b><c>never</c></h><l><v>1</v></l><l><v>2</v></l></r>")
    (tmp_path / "xml/f2.xml").write_text("<r><h><a>5</a></h></r>")
    for llm, data in (("m1", {"h": {"a": "1", "b": "y"}, "l": [{"v": "2"}, {"v": "1"}]}), ("m2", {"h": {"a": "1.0", "b": "x", "z": "extra"}, "l": []})):
        d = tmp_path / f"results_{llm}/p1"
        d.mkdir(parents=True)
        (d / "f1.json").write_text(json.dumps({"_metadata": {"retry_count": 1}, **data}))
        (d / "gone.json").write_text("{}")


def test_pipeline(spark, tmp_path):
    folder(tmp_path)
    t = pipeline.run(spark, str(tmp_path), str(tmp_path / "out"))
    got = {r.llm: (r.files, r.correct, r.incorrect, r.not_extracted, r.total_retries) for r in t["overall"].collect()}
    # h.c is predicted by nobody and so is not asked for
    assert got == {"m1": (1, 3, 1, 0, 1), "m2": (1, 2, 1, 2, 1)}
    assert next((tmp_path / "out/overall").glob("*.csv")).read_text().startswith("llm\tparse_type\tfiles\tcorrect")
    assert {r.section for r in t["pivot"].collect()} == {"h.a", "h.b", "h.z", "l.0]", "l.1]"}
    assert {(r.llm, r.parse_type, r.total_incorrect) for r in t["error_types"].collect()} == {("m1", "p1", 1), ("m1", "全体", 1), ("m2", "p1", 1), ("m2", "全体", 1)}


def test_evaluation_is_kept_and_read_again(spark, tmp_path):
    folder(tmp_path)
    out = str(tmp_path / "out")
    first = {n: sorted(map(str, t.collect())) for n, t in pipeline.run(spark, str(tmp_path), out).items()}
    again = {n: sorted(map(str, t.collect())) for n, t in pipeline.run(spark, str(tmp_path), out, skip_evaluate=True).items()}
    assert first == again and all(first[n] for n in ("overall", "subsection", "error_types"))
    # labels come from all runs, whatever is asked for: m1 is asked for nothing less when it stands alone
    alone = pipeline.run(spark, str(tmp_path), str(tmp_path / "one"), ["m1"])["overall"].collect()
    assert [(r.llm, r.correct, r.incorrect, r.not_extracted) for r in alone] == [("m1", 3, 1, 0)]
    # a run without errors, without truth, or of an llm that is not known
    known = pipeline.run(spark, str(tmp_path), out, skip_evaluate=True, known=["m2"])["error_types"].collect()
    assert [(r.llm, r.parse_type) for r in known] == [("m2", "p1"), ("m2", "全体")]


def test_documents_of_other_tools_are_read(spark, tmp_path):
    stats = {"correct": 1, "incorrect": 3, "not_extracted": 0, "evaluated": 4, "precision": 0.25, "recall": 0.25, "f1": 0.25}
    good = {"correct": 9, "incorrect": 1, "not_extracted": 0, "evaluated": 10, "precision": 0.9, "recall": 0.9, "f1": 0.9}
    doc = {
        "total_files": 2, "total_correct": 10, "total_incorrect": 4, "total_not_extracted": 0, "total_evaluated": 14, "overall_precision": 10 / 14, "overall_recall": 10 / 14, "overall_f1": 10 / 14, "total_retries": 1, "retried_files": 1,
        "error_type_totals": {"wrong_value": 4}, "section_analysis": {"top": {"h": good}, "sub": {"h.a": good, "h.b": stats}},
        "incorrect_examples": [{"file": f"f{i}", "field": "h.b", "error_type": "wrong_value", "xml": "1\t2", "llm": str(i)} for i in range(3)] + [{"file": "f9", "field": "h.a", "error_type": "wrong_value", "xml": "x", "llm": "y"}],
        "per_file": [{"file": "f0", "retry_count": 1, **stats}],
    }
    (tmp_path / "evaluations_gemini").mkdir()
    (tmp_path / "evaluations_gemini/p1.json").write_text(json.dumps(doc, indent=2, ensure_ascii=False))
    t = pipeline.run(spark, str(tmp_path), str(tmp_path / "out"), skip_evaluate=True, known=pipeline.KNOWN_LLMS)
    assert [(r.llm, r.parse_type, r.files, r.total_retries, round(r.f1, 4)) for r in t["overall"].collect()] == [("gemini", "p1", 2, 1, 0.7143)]
    assert [(r.section, r.rank, r.file, r.xml, r.llm_value) for r in t["failed_patterns"].collect()] == [("h.b", 1, "f0", "1 2", "0"), ("h.b", 2, "f1", "1 2", "1"), ("h.b", 3, "f2", "1 2", "2")]
    assert [(r.parse_type, r.total_incorrect, r.wrong_value_count) for r in t["error_types"].collect()] == [("p1", 4, 4), ("全体", 4, 4)]
    assert t["pivot"].columns == ["section", "gemini_p1"]


def test_command_line(spark, tmp_path, capsys):
    folder(tmp_path)
    assert cli.main(["xml", str(tmp_path / "xml/f2.xml")]) == 0
    assert json.loads(capsys.readouterr().out) == {"h": {"a": "5"}}
    assert cli.main(["evaluate", str(tmp_path), str(tmp_path / "o"), "--llms", "other"]) == 1


def test_stream(spark, tmp_path):
    truth = spark.createDataFrame([("f", '{"a": "1"}')], "file string, record string")
    schema = "llm string, file string, data string"
    spark.createDataFrame([("m", "f", '{"a": "1"}'), ("m", "none", "{}")], schema).write.parquet(str(tmp_path / "in"))
    q = judge_stream(spark, str(tmp_path / "in"), schema, truth, ["llm", "file"], str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert [(r.llm, r.field, r.status) for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == [("m", "a", "correct")]
