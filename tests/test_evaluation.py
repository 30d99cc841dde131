"""Normal form, alignment and the two passes, against golden cases and a recursion of their own."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strataline.functions import paths, text
from strataline.operators import align, documents, judge, metrics
from strataline.plans import layout_queries


def col(spark, f, values, names="x"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(f(*[F.col(n) for n in names])).collect()]


NORMS = [
    ("標準ー貫入（１）", "標準-貫入1"), ("12°34′56″", "123456"), ("JIS:A 1219", "JIS-A1219"), ("a、,b", "a,b"), ("()", ""), ("㍍", "メ-トル"), ("a b c\x1cd", "abcd"), ("", ""),
]


def test_normal_form(spark):
    assert col(spark, text.normal, [a for a, _ in NORMS]) == [b for _, b in NORMS]
    assert [text.normal_form(a) for a, _ in NORMS] == [b for _, b in NORMS]
    assert col(spark, text.normal, [None]) == [None]


def test_numbers(spark):
    got = col(spark, text.same_value, [("1.50", "1.5"), ("1_000", "1000"), ("1d", "1"), ("nan", "nan2"), ("1,000", "1000"), ("inf", "Infinity"), ("", "x")], "ab")
    assert got == [True, True, False, False, False, True, False]


def test_fence(spark):
    assert col(spark, text.strip_fence, ["```json\n{}\n```\nx", "```\na\nb", " ```\na", "plain", "```", None]) == ["{}", "a\nb", " ```\na", "plain", "", None]


def test_paths(spark):
    assert col(spark, paths.strip_indices, ["a[0][1].b", "a[3]", "a.b"]) == ["a..b", "a", "a.b"]
    assert col(spark, paths.section, ["a[0].b", "a.b.c", "a"]) == ["a.0]", "a.b", "a"]
    assert col(spark, paths.plain_label, ["$.a.b[0].c", "['a']['b'][0]['c']", "a/b/0/c", "a.b.0.c", "a.b[0].c"]) == ["a.b.c"] * 5
    kinds = col(spark, paths.notation, ["$.a[0]", "['a'][0]", "a/0", "a.0", "a[0]"])
    assert len(set(kinds)) == 5


GOLDEN = [
    ({"r": [{"a": "1"}]}, {"r": [{"a": "2"}]}, ["not_extracted r[0].a"]),
    ({"a": ""}, {"a": "", "b": "x"}, ["false_positive b"]),
    ({"r": [{"a": "1"}]}, {"r": [{"a": "1"}, {"a": "1"}]}, ["correct r[0].a", "false_positive r[1].a"]),
    ({"r": [{"a": "1"}, {"a": "2"}]}, {"r": [{"a": "2"}, {"a": "1"}]}, ["correct r[0].a", "correct r[1].a"]),
    ({"r": [{"a": "1"}, {"b": "2"}]}, {"r": [{"b": "2"}, {"a": "1"}]}, ["correct r[0].a", "correct r[1].b", "false_positive r[0].b", "false_positive r[1].a"]),
    ({"l": {"a": "1"}}, {"l": [{"a": "1"}]}, ["not_extracted l.a", "false_positive l[0].a"]),
    ({"a": "1"}, {"a": {"b": "1"}}, ["partial_match a", "false_positive a.b"]),
    ({"a": {"b": "1"}}, {"a": "1"}, ["not_extracted a.b"]),
    ({"a": ["1", "2"]}, {"a": ["2", "1"]}, ["wrong_value a[0]", "wrong_value a[1]"]),
    ({"a": "()"}, {"a": "x"}, ["false_positive a"]),
    ({"a": "1.50"}, {"a": 1.5}, ["correct a"]),
    ({"a": "a、b"}, {"a": "b,a"}, ["wrong_value a"]),
]


@pytest.mark.parametrize("truth,pred,want", GOLDEN)
def test_golden(truth, pred, want):
    got = [f"{kind or status} {field}" for _, _, field, status, kind, _, _ in documents.judge(truth, pred)]
    assert got == want


def brute(truth, pred):
    """The two passes as plain recursion over both documents."""
    out = []

    def n(v):
        return text.normal_form("" if v is None else str(v))

    def flat(v, p=()):
        if isinstance(v, dict):
            return {k: x for key, y in v.items() for k, x in flat(y, p + (key,)).items()}
        if isinstance(v, list):
            return {k: x for i, y in enumerate(v) for k, x in flat(y, p + (i,)).items()}
        return {p: v}

    def first(t, q, p):
        if isinstance(t, dict):
            for k, v in t.items():
                first(v, q.get(k) if isinstance(q, dict) else None, p + (k,))
        elif isinstance(t, list):
            q = q if isinstance(q, list) else []
            if t and all(isinstance(x, dict) for x in t):
                left = [(j, flat(x)) for j, x in enumerate(q) if isinstance(x, dict)]
                for i, x in enumerate(t):
                    fx = flat(x)
                    best, score = None, 0
                    for j, fy in left:
                        s = sum(1 for k, v in fx.items() if n(v) and k in fy and n(fy[k]) == n(v))
                        if s > score:
                            best, score = j, s
                    left = [z for z in left if z[0] != best]
                    first(x, q[best] if best is not None else None, p + (i,))
            else:
                for i, x in enumerate(t):
                    first(x, q[i] if i < len(q) else None, p + (i,))
        elif n(t):
            a, b = n(t), n(q)
            out.append((1, documents.path_of(p), "not_extracted" if not b else "correct" if documents.same_value(a, b) else "partial_match" if a in b or b in a else "wrong_value"))

    def second(t, q, p, there=True):
        if isinstance(q, dict):
            for k, v in q.items():
                has = isinstance(t, dict) and k in t
                second(t[k] if has else None, v, p + (k,), has)
        elif isinstance(q, list):
            for i, v in enumerate(q):
                has = isinstance(t, list) and i < len(t)
                second(t[i] if has else None, v, p + (i,), has)
        elif n(q) and not (there and n(t)):
            out.append((2, documents.path_of(p), "false_positive"))

    first(truth, pred, ())
    second(truth, pred, ())
    return out


def random_doc(rng, depth=0):
    r = rng.random()
    if depth < 3 and r < 0.35:
        return {k: random_doc(rng, depth + 1) for k in rng.sample("abc", rng.randint(0, 3))}
    if depth < 3 and r < 0.6:
        if rng.random() < 0.6:
            return [{k: random_doc(rng, depth + 2) for k in rng.sample("abc", rng.randint(1, 3))} for _ in range(rng.randint(0, 3))]
        return [random_doc(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(["1", "2", "12", "", "()", None, 1, 2.0, True, "x"])


def test_documents_against_recursion():
    rng = random.Random(5)
    for _ in range(4000):
        t = {k: random_doc(rng) for k in rng.sample("abc", 2)}
        p = {k: random_doc(rng) for k in rng.sample("abc", 2)}
        got = [(a, f, kind or status) for a, _, f, status, kind, _, _ in documents.judge(t, p)]
        assert got == brute(t, p), (t, p)


def test_results_as_models_write_them(spark, tmp_path):
    truth = {"h": {"a": "1", "note": "[1]"}, "l": [{"v": "x"}, {"v": "y"}], "n": ["p", "q"]}
    whole = json.dumps(truth)
    nested = json.dumps({"h": json.dumps(truth["h"]), "l": json.dumps([json.dumps(x) for x in truth["l"]]), "n": json.dumps(truth["n"])})
    data = {"plain": whole, "fence": f"```json\n{whole}\n```", "prose": f"Here it is: {whole} Done.", "strings": nested, "cut": whole[:-9], "none": None, "scalar": "5"}
    spark.createDataFrame([("f", whole, "1")], "file string, record string, loaded_at string").write.parquet(f"{tmp_path}/parse_xml.parquet")
    rows = [("s", 1, m, "p", i, "f", d, "1") for i, (m, d) in enumerate(data.items())]
    schema = "series_id string, batch_no int, llm string, parse_type string, result_id long, file string, data string, loaded_at string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/extraction_result.parquet")
    got = {r.llm: (r.correct, r.incorrect, r.not_extracted, r.unreadable) for r in layout_queries.judged_runs(spark, str(tmp_path)).collect()}
    assert got == {**dict.fromkeys(("plain", "fence", "prose", "strings"), (6, 0, 0, 0)), **dict.fromkeys(("cut", "none"), (0, 0, 0, 1)), "scalar": (0, 0, 6, 0)}
    assert {r.llm for r in layout_queries.judged_documents(spark, str(tmp_path)).where("status = 'unreadable'").collect()} == {"cut", "none"}


def test_greedy_ties_and_order(spark):
    rows = [("d", 0, 0, 2), ("d", 0, 1, 2), ("d", 1, 0, 3), ("d", 1, 1, 1), ("d", 2, 0, 1)]
    s = spark.createDataFrame(rows, "doc string, truth_idx int, pred_idx int, score long")
    got = {(r.truth_idx, r.pred_idx) for r in align.greedy_pairs(s, ["doc"]).collect()}
    assert got == {(0, 0), (1, 1)}
    assert align.greedy_pairs(s.limit(0), ["doc"]).count() == 0


def test_relational_judge_agrees_with_documents(spark):
    rng = random.Random(2)
    t_rows, p_rows, pairs = [], [], []
    for d in range(40):
        t = {"order": {"head": {"s": rng.choice("AB"), "c": rng.choice(["1", ""])}, "lines": [{k: rng.choice("123") for k in "xyz"} for _ in range(rng.randint(0, 4))]}}
        p = {"order": {"head": {"s": rng.choice("AB")}, "lines": [{k: rng.choice("123") for k in rng.sample("xyz", 2)} for _ in range(rng.randint(0, 4))], "extra": {"n": "e"}}}
        pairs.append((d, t, p))
        for side, doc in ((t_rows, t), (p_rows, p)):
            for sec in ("head", "extra"):
                side += [(d, None, f"{sec}.{k}", 1, v) for k, v in doc["order"].get(sec, {}).items()]
            side += [(d, i, k, 2, v) for i, x in enumerate(doc["order"]["lines"]) for k, v in x.items()]
    leaf = "doc long, idx int, rel string, fno int, value string"
    truth = judge.with_norm(spark.createDataFrame(t_rows, leaf))
    pred = judge.with_norm(spark.createDataFrame([("m", *r) for r in p_rows], "run string, " + leaf))
    got = sorted((r["doc"], r["pass"], r["field"], r["error_type"] or r["status"]) for r in judge.details(truth, pred, ["run"]).collect())
    want = sorted((d, a, f, kind or status) for d, t, p in pairs for a, _, f, status, kind, _, _ in documents.judge(t, p))
    assert got == want


def test_metrics_without_rows(spark):
    d = spark.createDataFrame([("m", "not_extracted")], "run string, status string")
    r = metrics.metrics(d, ["run"]).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    files = spark.createDataFrame([("m", 1, 0), ("k", 2, 1)], "run string, doc int, retry_count int")
    o = {r.run: r for r in metrics.overall(d, files, ["run"]).collect()}
    assert o["k"].files == 1 and o["k"].f1 == 0.0 and o["k"].retried_files == 1


def test_labels_filter(spark):
    t = judge.with_norm(spark.createDataFrame([(1, None, "a.b", 1, "x"), (1, None, "a.c", 1, "y")], "doc long, idx int, rel string, fno int, value string"))
    p = judge.with_norm(spark.createDataFrame([("m", 1, None, "a.b", 1, "x")], "run string, doc long, idx int, rel string, fno int, value string"))
    labels = spark.createDataFrame([("order.a.b",)], "label string")
    assert [r.field for r in judge.details(t, p, ["run"], labels).collect()] == ["order.a.b"]


def test_normal_form_is_nfkc_first():
    for s in ("Ａ①", "ﾎﾟｰﾄ", "½"):
        assert text.normal_form(s) == re.sub("ー", "-", unicodedata.normalize("NFKC", s))


def test_alignment_from_leaves_is_the_greedy_choice(spark):
    rng = random.Random(11)
    rows = lambda n: [(d, i, rng.choice("ab"), rng.choice(["1", "2", "3", ""])) for d in range(6) for i in range(n) for _ in range(3)]
    truth = spark.createDataFrame(rows(7), "doc int, idx int, rel string, norm string")
    pred = spark.createDataFrame([(d, f"r{r}", *x) for r in range(3) for d, *x in rows(6) if (d, r) != (2, 1)], "doc int, run string, idx int, rel string, norm string")
    per_run = truth.join(pred.select("run", "doc").distinct(), "doc")
    want = align.greedy_pairs(align.overlap_scores(per_run, pred, ["doc", "run"]), ["doc", "run"]).collect()
    got = align.greedy_alignment(truth, pred, ["doc"], ["run"]).collect()
    assert {(r.doc, r.run, r.truth_idx, r.pred_idx) for r in got} == {(r.doc, r.run, r.truth_idx, r.pred_idx) for r in want} and len(got) == len(want) > 50
    assert align.greedy_alignment(truth, pred.limit(0), ["doc"], ["run"]).count() == 0


def test_error_kinds_of_runs_without_errors(spark):
    """One row for every run and one for its llm, zeros where nothing is wrong, in the order of the known llms."""
    d = spark.createDataFrame([("b", "p", "incorrect", "wrong_value"), ("b", "p", "incorrect", "false_positive"), ("b", "q", "correct", None), ("x", "p", "incorrect", "wrong_value")], "llm string, parse_type string, status string, error_type string")
    runs = spark.createDataFrame([("a", "p"), ("b", "p"), ("b", "q"), ("x", "p")], "llm string, parse_type string")
    got = metrics.error_breakdown(d, runs, ["b", "a"]).orderBy(F.col("parse_type") == "全体", "llm_rank", "parse_type").collect()
    assert [(r.llm, r.parse_type, r.total_incorrect, r.false_positive_count, r.wrong_value_count, r.wrong_value_ratio) for r in got] == [
        ("b", "p", 2, 1, 1, 0.5), ("b", "q", 0, 0, 0, 0.0), ("a", "p", 0, 0, 0, 0.0), ("b", "全体", 2, 1, 1, 0.5), ("a", "全体", 0, 0, 0, 0.0)]


def test_spatial_text_of_pages_with_equal_heads(spark):
    text = "=== Page 1 ===\n[x=0,y=10] a\n=== Page 1 ===\n[x=0,y=10] b\n=== Page 2 ===\n=== Page 3 ===\n[x=0,y=0] c"
    from strataline.operators import layout

    df = spark.createDataFrame([(1, text), (2, "no lines"), (3, None), (4, "[x=0,y=5] d")], "k int, t string")
    got = {r.k: r.spatial for r in layout.spatial_text(df, "k", "t").collect()}
    assert got == {1: "=== Page 1 ===\na\n=== Page 1 ===\nb\n=== Page 3 ===\nc", 4: "d"}
