"""Look-alikes, leaks, quality, mixing, linkage: against brute force and small cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from strataline.llm import glyphs, leakage, linkage, mixing, quality


# --- one form -----------------------------------------------------------------------------------------------


def reference_form(t):
    """The same mapping character by character in Python."""
    one, many, hidden = glyphs.glyph_tables()
    t = "".join(many.get(c, c) for c in t)
    return unicodedata.normalize("NFC", "".join(one.get(c, c) for c in t if c not in hidden))


SAME = [("Ｔ．Ｐ．＋４５", "T.P.+45"), ("Τ.Ρ.", "T.P."), ("ﾎﾟｰﾀﾌﾞﾙ", "ポータブル"), ("Höhe", "Höhe"), ("腐植⼟", "腐植土"), ("a b", "a b"), ("盛\U000e0100土", "盛土"), ("ロ­ータ", "口ータ"), ("㎜", "mm"), ("ӧ", "ö"), ("1–2", "1-2")]
OTHER = [("1", "l"), ("0", "O"), ("a b", "ab"), ("A", "a"), ("①", "1"), ("m²", "m2"), ("ハ", "パ"), ("黄褐", "黄灰")]


def test_one_form(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(SAME + OTHER)] + [(100, None, "x"), (101, "", "x"), (102, "x", "x"), (103, "​", "‌")]
    df = spark.createDataFrame(rows, "id int, xml string, llm string")
    got = {r.id for r in glyphs.same_to_the_reader(df, "xml", "llm").collect()}
    assert got == set(range(len(SAME))) | {103}
    formed = glyphs.one_form(df, ["xml", "llm"]).collect()
    assert all(r.xml_form == (None if r.xml is None else reference_form(r.xml)) for r in formed)
    assert glyphs.one_form(df.limit(0), ["xml"]).count() == 0
    with pytest.raises(ValueError):
        glyphs.one_form(df.withColumn("xml_form", F.lit(1)), ["xml"])


def test_one_form_random(spark):
    rng = random.Random(1)
    alphabet = "aｂ漢ｶﾞОΡ㍍é́​　 -−ー二'\"\\[]^"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["長" * 100_000 + "ｶﾞ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in glyphs.one_form(df, ["t"]).collect():
        assert r.t_form == reference_form(r.t)


# Pairs by eye, independent of the tables of the package.
BY_EYE = {
    "Ｎｏ．４": "No.4", "㎝": "cm", "㍍": "メートル", "ﬁne": "fine", "ｶﾞｽ": "ガス", "Сhеck": "Check", "ΑΒΕ": "ABE", "x​y": "xy", "a\u00a0b": "a b", "e\u0301": "é", "－": "-", "〜": "~", "２５％": "25%",
    "": "", "​": "", "plain text": "plain text", "①": "①", "m²": "m²", "砂　礫": "砂 礫", "Ⅲ": "III",
}


def test_forms_by_eye(spark, monkeypatch):
    df = spark.createDataFrame(list(BY_EYE.items()), "t string, want string")
    got = glyphs.one_form(df, ["t"]).collect()
    assert {r.t: r.t_form for r in got} == BY_EYE
    monkeypatch.setattr(glyphs, "HELD_CHARS", 3)  # batches of long texts are rewritten in pieces
    assert {r.t: r.t_form for r in glyphs.one_form(df.coalesce(1), ["t"]).collect()} == BY_EYE


# --- leaks --------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, run):
    out = set()
    for i, x in items:
        x = leakage.normalise(x)
        for d, t in docs:
            t = leakage.normalise(t)
            if any(x[a : a + run] in t for a in range(len(x) - run + 1)):
                out.add((i, d))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc漢字ｶ ,") for _ in range(n))
    items = [(i, word(rng.randint(20, 150))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        i, x = rng.choice(items[:12])
        a = rng.randint(0, max(0, len(x) - 10))
        docs.append((d, word(rng.randint(0, 60)) + x[a : a + rng.randint(20, 80)].upper() + "\n" + word(rng.randint(0, 60))))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    D, I = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string")
    runs = leakage.leaks(D, "d", "t", I, "i", "t")
    got = {(r.item_id, r.doc_id) for r in leakage.leaked_pairs(runs).collect()}
    assert got == brute_leaks(docs, [x for x in items if x[1]], 40) and got
    # blocks of items give the same
    again = leakage.leaks(D, "d", "t", I, "i", "t", block_chars=100)
    assert {(r.item_id, r.doc_id) for r in leakage.leaked_pairs(again).collect()} == got
    assert again._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one pass over the corpus, whatever the items
    text = dict(docs)
    for r in runs.collect():
        if r.doc_start is not None:
            assert leakage.normalise(text[r.doc_id][r.doc_start : r.doc_end]).count("") >= 40
    assert leakage.leaks(D, "d", "t", I.limit(0), "i", "t").count() == 0


def test_exact_boundary(spark):
    item = "".join(chr(0x4E00 + i) for i in range(100))
    docs = spark.createDataFrame([(1, "x" + item[30:69] + "y"), (2, "x" + item[31:71] + "y")], "d long, t string")
    r = leakage.leaks(docs, "d", "t", spark.createDataFrame([(5, item)], "i long, t string"), "i", "t").collect()
    assert [(x.doc_id, x.doc_start, x.doc_end, x.item_start, x.run_chars) for x in r] == [(2, 1, 41, 31, 40)]


# --- quality --------------------------------------------------------------------------------------------------

PROSE_EN = "The crew lost some drilling fluid near the base of the hole but finished it on the same day. "
PROSE_JA = "深度四十二メートル付近から茶褐色を呈する粗砂に変わり、貝殻片を混入していると推定した。"


def test_kinds(spark):
    rng = random.Random(2)
    rows = [(i, (PROSE_EN if i % 2 else PROSE_JA) * rng.randint(1, 6)) for i in range(60)]
    special = {
        100: ("list", "Check list\n" + "\n".join(f"- sandy silt {i}" for i in range(8))), 101: ("list", "\n".join(f"項目{i}: 粒度試験" for i in range(8))),
        102: ("table", "| a | b |\n| --- | --- |\n" + "| 1.15 | 盛土 |\n" * 6), 103: ("table", "\n".join("12.3  4.56  7.8  9.0" for _ in range(8))),
        104: ("junk", "\n".join(PROSE_JA)), 105: ("junk", "page " * 120), 106: ("junk", PROSE_JA.encode().decode("latin-1")),
        107: (None, PROSE_EN.replace("drilling", "drilling\n") * 2), 108: (None, "# 朝坂\n" + PROSE_JA * 3), 109: (None, PROSE_JA * 4 + "\n- 盛土\n- 粗砂\n" + PROSE_JA),
    }
    df = spark.createDataFrame(rows + [(k, t) for k, (_, t) in special.items()] + [(200, None), (201, " \n"), (202, "")], "id long, t string")
    got = {r.id: r for r in quality.judge_documents(df, "id", "t").collect()}
    assert {k: got[k].doc_kind for k in special} == {k: v or "prose" for k, (v, _) in special.items()}
    assert not {200, 201, 202} & got.keys()
    assert all(got[i].doc_kind == "prose" for i in range(60))
    assert all(0 <= r.n_chars_pct <= 1 for r in got.values())


def test_junk_where_a_third_is_not_prose(spark):
    rng = random.Random(5)
    encoded = lambda: "\n".join("".join(rng.choice("ABCDEFGHIJKLMabcdefghijklm0189+/") for _ in range(76)) for _ in range(rng.randint(3, 9)))
    scrambled = lambda: " ".join("".join(rng.choice("bcdfghlmnprstvw") for _ in range(rng.randint(3, 8))) for _ in range(40))
    made = [lambda: "page " * rng.randint(22, 200), encoded, scrambled, lambda: "mica flakes " * 7 + "mica flakes", lambda: "\n".join(["shell fragments " * 5] * 9)]
    words = [w.strip(".") for w in PROSE_EN.split()]
    prose = {i: PROSE_EN + " ".join(rng.sample(words, rng.randint(9, 18))) + "." for i in range(80)}
    junk = {1000 + i: made[i % 5]() for i in range(40)}
    rows = [*prose.items(), *junk.items(), *[(2000 + i, "\n".join(f"- sandy silt {n}" for n in range(5))) for i in range(10)]]
    got = {r.id: r for r in quality.judge_documents(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert {got[i].doc_kind for i in prose} == {"prose"} and {got[i].doc_kind for i in junk} == {"junk"}
    assert "common_word_share-" in got[1002].tails
    alone = [(i, t) for i, t in junk.items() if i % 5 != 2]  # nothing to compare with: only what shows by itself
    assert {r.doc_kind for r in quality.judge_documents(spark.createDataFrame(alone, "id long, t string"), "id", "t").collect()} == {"junk"}


def test_repeats():
    assert [round(quality.repeats_of(t), 2) for t in ("", "a", "aaaa", "abab", "ababa", "abcd", "aab")] == [1, 1, 4, 2, 2.5, 1, 1]


def test_statistics_empty(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert quality.judge_documents(df, "id", "t").count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------


def brute_seats(shares, seats, caps):
    got = [0] * len(shares)
    for _ in range(seats):
        can = [i for i in range(len(shares)) if got[i] < caps[i] and shares[i] > 0]
        if not can:
            break
        got[max(can, key=lambda i: (shares[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 7)
        shares = [rng.choice([0, 1, 2, 0.5, rng.random()]) for _ in range(n)]
        caps = [rng.choice([0, 2, 30, 500]) for _ in range(n)]
        seats = rng.randint(0, 150)
        if any(shares):
            assert mixing.sainte_lague(shares, seats, caps) == brute_seats(shares, seats, caps)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(20, 60)) for i, s in enumerate(["big"] * 900 + ["small"] * 60 + ["other"] * 50)] + [(5000, None, 30), (5001, "big", 0)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1.0), ("small", 0.4, 2.5), ("none", 0.1, 2.0)], "source string, target_share double, max_repeats double")
    chosen, report = mixing.mix(tokens, targets)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].reached_share - 5 / 9) < 0.01 and abs(r["small"].reached_share - 4 / 9) < 0.01 and r["none"].used_tokens == 0
    assert r["small"].reached_repeats <= 2.5 and r["big"].reached_repeats <= 1.0
    c = chosen.collect()
    assert {x.source for x in c} == {"big", "small"} and max(x.repeats for x in c if x.source == "small") <= 3 and all(x.repeats == 1 for x in c if x.source == "big")
    again = {(x.doc_id, x.repeats) for x in mixing.mix(tokens.repartition(5), targets)[0].collect()}
    assert again == {(x.doc_id, x.repeats) for x in c}
    assert mixing.mix(tokens.limit(0), targets)[0].count() == 0


def test_blocks_are_drawn_to_the_quotas(spark):
    rng = random.Random(6)
    rows = [(i, "a" if i % 3 else "b", rng.randint(5, 40)) for i in range(3000)] + [(9000, "b", 2_000)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1.0), ("b", 0.6, 3.0)], "source string, target_share double, max_repeats double")
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in "ab"}
    picks = {}
    for seed in (1, 2):
        chosen, report = mixing.mix(tokens, targets, seed=seed, block_tokens=100)
        got, told = chosen.collect(), {r.source: r for r in report.collect()}
        for s in "ab":
            blocks = {}
            for r in got:
                if r.source == s:
                    blocks.setdefault(r.block, set()).add(r.repeats)
            assert all(len(x) == 1 for x in blocks.values())  # a block is taken as a whole
            used = sum(r.n_tokens * r.repeats for r in got if r.source == s)
            quota = told[s].blocks * 100
            assert used == told[s].used_tokens <= quota <= size[s] * targets.where(f"source = '{s}'").first().max_repeats
            assert used >= quota - 100 - 2_000 * (s == "b")
        picks[seed] = {(r.doc_id, r.repeats) for r in got}
    assert picks[1] != picks[2]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "s", "hello world"), (2, "s", None), (3, None, " "), (4, "s", "漢字" * 1000)], "doc_id long, source string, text string")
    n = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df, "doc_id", "source", "text").collect()}
    assert n[2] == n[3] == 0 and 1 < n[1] < 6 and n[4] > 500


# --- linkage ------------------------------------------------------------------------------------------------------


def test_parsing():
    assert [linkage.depth_of(x) for x in ("２．15", "GL-2.15m", "215cm", "2.15～2.45", None, "-")] == [2.15, 2.15, 2.15, 2.15, None, None]
    assert [linkage.date_of(x) for x in ("H30.3.1", "2016年1月5日", "R1.11.3", "2019/4/3", None, "x")] == ["2018-03-01", "2016-01-05", "2019-11-03", "2019-04-03", None, None]
    assert [linkage.label_of(x) for x in ("BV-2孔", "2号孔", "R4ーBー2", "Ｎo.4", None)] == [("bv", 2), ("", 2), ("r4b", 2), ("", 4), (None, None)]
    assert linkage.blows_of("9,12,23") == ([9, 12, 23], 44) and linkage.blows_of("計42") == (None, 42) and linkage.blows_of(None) == (None, None)
    assert linkage.number_of("T.P.+115.89m") == 115.89 and linkage.number_of("-") is None


def test_row_step_is_the_minimum():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 5))
        m, w, v = rng.random(n), rng.random(n) * 5 + 0.1, rng.random(n) * 1.5
        x = linkage._by_row(m, w, v, np.array([0]), 4.0)
        f = lambda y: (w * (y - m) ** 2 + 2 * (y - v) ** 2).sum()
        assert x.sum() <= 1 + 1e-6 and (x >= 0).all()
        for _ in range(300):
            y = rng.random(n)
            if y.sum() <= 1:
                assert f(x) <= f(y) + 1e-6


LOG = "spt_id long, survey_name string, hole_name string, lat double, lon double, collar_elev double, test_date date, start_depth double, blows_10 int, blows_20 int, blows_30 int, n_value int, penetration_cm int, soil_name string"
EXT = "ext_id long, sheet_title string, hole_label string, lat double, lon double, elev_text string, date_text string, depth_text string, blows_text string, n_text string, penetration_text string, soil_text string"


def test_link(spark):
    import datetime as dt

    day = dt.date(2018, 3, 1)
    log = [(1, "菱沢台第一共同溝築造工事", "BV-1", 41.7, 143.8, 52.49, day, 1.15, 7, 9, 2, 18, 30, "細砂"), (2, "菱沢台第一共同溝築造工事", "BV-1", 41.7, 143.8, 52.49, day, 2.15, 3, 7, 2, 12, 30, "細砂"),
           (3, "菱沢台第一共同溝築造工事", "BV-2", 41.7004, 143.8, 55.38, dt.date(2016, 1, 5), 1.15, 0, 1, 0, 1, 30, None), (4, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    ext = [(10, "菱沢台第一共同溝築造工亊", "BV-1孔", None, None, "52.5", "H30.3.1", "1.16", "7/9/2", "N=18", None, "細砂"), (11, "柱状図", "1号孔", 41.7, 143.8, "-", None, "215cm", None, "12回", "30cm", None),
           (12, "菱沢台第一共同溝築造工事", "BV-9", 41.7010, 143.8, "60.1", "2011/1/1", "1.15", "1,1,1", "3", None, None), (13, None, None, None, None, None, None, None, None, None, None, None), (14, "菱沢台第一共同溝築造工事", "BV-1", 41.7, 143.8, "52.49", None, "1.15", None, "18", None, None)]
    L, E = spark.createDataFrame(log, LOG), spark.createDataFrame(ext, EXT)
    got = linkage.link(L, E).collect()
    assert {(r.spt_id, r.ext_id) for r in got} == {(1, 10), (2, 11), (1, 14)}
    assert all(0.5 < r.confidence <= 1 for r in got)
    assert linkage.link(L.limit(0), E).count() == 0 and linkage.link(L, E.limit(0)).count() == 0


def test_tails_decide_the_kind(spark):
    rng = random.Random(9)
    words = [w.strip(".") for w in PROSE_EN.split()]
    rows = [(i, PROSE_EN + " ".join(rng.sample(words, rng.randint(6, 18))) + ".") for i in range(60)]
    special = {
        100: ("junk", "no no no no"), 101: ("junk", "\n".join(["sandy silt below"] * 7)), 102: ("table", "\n".join("12.3\t4.5\t7.8" for _ in range(9))), 103: ("prose", "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in PROSE_EN)),
        104: ("list", "fill\nsandy silt\ngravel"), 105: ("prose", "# Title\n" + PROSE_EN), 106: ("junk", "a b c d e f g h i j k l"), 107: ("table", "a | b | c\n1 | 2 | 3\n4 | 5 | 6"),
    }
    df = spark.createDataFrame(rows + [(k, t) for k, (_, t) in special.items()], "id long, t string")
    got = {r.id: r for r in quality.judge_documents(df, "id", "t").collect()}
    assert {k: got[k].doc_kind for k in special} == {k: v for k, (v, _) in special.items()}
    for r in got.values():
        assert bool(r.decided_by) == (r.doc_kind != "prose") and set(r.decided_by) <= set(r.tails)
    assert {got[i].doc_kind for i in range(60)} == {"prose"}


def _tests_and_readings(n, rng):
    import datetime as dt

    places, works = [a + b for a in "菱楓朝鶴鳩雲柳椿" for b in "沢原崎島町谷"], ["共同溝築造工事", "斜面対策工設計", "倉庫棟増築計画", "堤防補強計画"]
    log, ext = [], []
    for i in range(n):
        site = rng.choice(places) + "第" + rng.choice("一二三四五") + rng.choice(works) + str(i // 8)
        hole, z, blows, elev, day = rng.randint(1, 9), 1.15 + rng.randint(0, 11), [rng.randint(0, 20) for _ in range(3)], round(rng.random() * 60, 2), dt.date(2010, 1, 1) + dt.timedelta(rng.randint(0, 900))
        log.append((i, site, f"B-{hole}", 40.0 + rng.random(), 140.0 + rng.random(), elev, day, z, *blows, sum(blows), 30, "細砂"))
        ext.append((10_000_000 + i, site.replace("第", "弟"), f"B-{hole}", None, None, str(elev) if i % 3 else None, day.isoformat() if i % 2 else None, str(z), ",".join(map(str, blows)), str(sum(blows)), None, None))
    return log, ext


def test_candidates_grow_with_the_rows(spark):
    n = {}
    for size in (400, 4000):
        log, ext = _tests_and_readings(size, random.Random(size))
        got = linkage.partial_keys(linkage.logged_rows(spark.createDataFrame(log, LOG)), linkage.extracted_rows(spark.createDataFrame(ext, EXT))).collect()
        n[size] = len(got)
        assert sum(r.ext_id - 10_000_000 == r.spt_id for r in got) == size
    assert n[4000] <= 10 * 1.5 * n[400]


def test_a_third_of_the_rows_alike(spark):
    log, ext = _tests_and_readings(300, random.Random(1))
    same = log[0][1:]
    log += [(1000 + i, *same) for i in range(150)]  # copies of one test
    log += [(2000 + i, *same[:4], None, None, *same[6:10], same[10], 30, f"土{i}") for i in range(100)]  # alike, and not told apart by a reading
    ext += [(20_000_000 + i, *ext[0][1:]) for i in range(150)]
    got = {r.ext_id: r.spt_id for r in linkage.link(spark.createDataFrame(log, LOG), spark.createDataFrame(ext, EXT)).collect()}
    assert sum(got.get(10_000_000 + i) == i for i in range(1, 300)) >= 297
    assert {got.get(20_000_000 + i) for i in range(150)} == {got.get(10_000_000)}


def test_runs_share_their_edges(spark):
    rng = random.Random(4)
    rows = [(e, s, rng.random(), 4.0, (e % 5, 1.0, "d", 3, 2)) for s in range(3) for e in range(s * 20, s * 20 + 30)]
    pairs = spark.createDataFrame(rows, "ext_id long, spt_id long, m double, w double, sig struct<e_hole_no:int,e_elev:double,e_test_date:string,e_n:int,e_total:int>")
    exact = linkage.Rules(tolerance=1e-5, rounds=200)
    whole = {(r.ext_id, r.spt_id): r.confidence for r in linkage.solve(pairs, exact).collect()}
    import dataclasses

    split = {(r.ext_id, r.spt_id): r.confidence for r in linkage.solve(pairs, dataclasses.replace(exact, run=7)).collect()}
    assert whole.keys() == split.keys() == {(r[0], r[1]) for r in rows} and max(abs(whole[k] - split[k]) for k in whole) < 1e-3


def test_no_side_of_a_link_is_broadcast(spark, tmp_path, monkeypatch):
    log, ext = _tests_and_readings(60, random.Random(5))
    spark.createDataFrame(log, LOG).write.parquet(f"{tmp_path}/log")  # small files, so all sides are guessed to be small
    spark.createDataFrame(ext, EXT).write.parquet(f"{tmp_path}/ext")
    (tests, _), (readings, members) = linkage.classes(spark.read.parquet(f"{tmp_path}/log"), "spt_id", linkage.LOGGED[1:]), linkage.classes(spark.read.parquet(f"{tmp_path}/ext"), "ext_id", linkage.EXTRACTED[1:])
    plans, cut = [], linkage.cut
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(linkage, "cut", lambda df: cut(seen(df)))
    seen(members), seen(linkage.candidate_pairs(linkage.logged_rows(tests), linkage.extracted_rows(readings)))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_a_key_of_many_tests_keeps_the_right_one(spark, monkeypatch):
    import datetime as dt

    # six tests of one day, depth and N value; only the title's beginning and the soil tell them apart, which are no keys
    day, soils = dt.date(2018, 3, 1), ["細砂", "粘土", "砂礫", "盛土", "粗砂", "腐植土"]
    log = [(i, "菱楓朝鶴鳩雲"[i] + "沢台第一共同溝築造工事地盤調査業務", None, 40.0 + i, 140.0, None, day, 1.15, 3, i, 9 - i, 12, 30, soils[i]) for i in range(6)]
    ext = [(100 + i, "菱楓朝鶴鳩雲"[i] + "沢台第一共同溝", None, None, None, None, "2018/3/1", "1.15", None, "12", "30", soils[i]) for i in range(6)]
    L, E = linkage.logged_rows(spark.createDataFrame(log, LOG)), linkage.extracted_rows(spark.createDataFrame(ext, EXT))
    got = {(r.ext_id, r.spt_id) for r in linkage.partial_keys(L, E).collect()}
    assert got >= {(100 + i, i) for i in range(6)}
    monkeypatch.setattr(linkage, "_BLOCK", 2)
    assert {(r.ext_id, r.spt_id) for r in linkage.partial_keys(L, E).collect()} == got
