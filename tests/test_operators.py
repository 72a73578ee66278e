"""Edge semantics of operators on hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import align, bootstrap, compiler, expect, features, govern, graph, metrics, ranking, rules, tune
from glossmill.sources import files
from glossmill.streaming import state_mix


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_std_of_one_value_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", None)], "k string, v double")
    got = {r["k"]: (r["mean"], r["std"], r["n"]) for r in metrics.mean_by_key(df, ["k"], ["v"]).collect()}
    assert got == {"a": (1.0, 0.0, 1), "b": (2.0, round(math.sqrt(2), 6), 2)}


def test_majority_tie_goes_to_first(spark):
    df = spark.createDataFrame([(1, "g", "y"), (2, "g", "x"), (3, "g", "x"), (4, "g", "y"), (5, "h", None)], "o int, k string, l string")
    assert {r["k"]: r["majority"] for r in ranking.majority_label(df, ["k"], "l", "o").collect()} == {"g": "y"}


def test_label_sets_differ(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), ("c", None)], "gold string, prediction string")
    union = one(metrics.union_label_metrics(df, [], "a"))
    fixed = one(metrics.fixed_label_metrics(df.withColumn("k", F.lit(1)), ["k"], ["a", "b", "z"], "a"))
    assert union["macro_f1"] == round((2 / 3 + 0) / 2, 6) and fixed["macro_f1"] == round(2 / 9, 6)
    assert union["accuracy"] == fixed["accuracy"] == 0.5 and union["hard_negative_accuracy"] == 0.5


def test_mcnemar_values(spark):
    from math import comb

    cases = [(0, 0), (5, 1), (3, 3), (10, 2), (400, 350), (0, 7)]
    df = spark.createDataFrame(cases, "b long, c long").withColumn("p", metrics.binomial_two_sided(F.col("b"), F.col("c")))
    for r in df.collect():
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
        assert r["p"] == pytest.approx(want, abs=1e-9)


def test_kappa_of_identical_raters(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert one(metrics.cohen_kappa(df, [], "a", "b"))["kappa"] == 1.0
    r = spark.createDataFrame([(i, l) for i in range(3) for l in ("x", "x", "y" if i else "x")], "i int, l string")
    assert one(metrics.fleiss_ac1(r, ["i"], "l", 3))["n_items"] == 3


def test_budget_rounds_half_to_even(spark):
    df = spark.createDataFrame([(50,), (30,), (1,), (70,)], "n int")
    assert [r[0] for r in df.select(ranking.budget_size(F.col("n"), 0.05)).collect()] == [2, 2, 1, 4]


def test_group_rank_equals_sorted(spark):
    rows = [(k, float((i * 7919) % 13), i) for i in range(400) for k in ("hot" if i % 3 else "b",)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1000)], "k string, s double, i int")
    got = {(r["k"], r["i"]): (r["rank"], r["group_rows"]) for r in ranking.group_rank(df, ["k"], [F.desc("s"), F.asc("i")], 7).collect()}
    for k in ("hot", "b", None):
        want = [i for kk, s, i in sorted([r for r in rows + [(None, 1.0, 1000)] if r[0] == k], key=lambda r: (-r[1], r[2]))]
        assert [got[(k, i)] for i in want] == [(n + 1, len(want)) for n in range(len(want))]
    g = ranking.global_rank(df.where("k is not null"), "s", "i", 5).orderBy("rank").select("i").collect()
    assert [r[0] for r in g] == [i for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_dedup_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "c"), ("b", 3, None), ("b", 4, None)], "k string, o int, clue string")
    got = {r["k"]: r["o"] for r in ranking.dedup_prefer(df, ["k"], F.col("clue").isNotNull(), "o").collect()}
    assert got == {"a": 2, "b": 3}
    assert {r["k"]: r["o"] for r in ranking.last_wins(df, ["k"], "o").collect()} == {"a": 2, "b": 4}
    new = spark.createDataFrame([("a", 9)], "k string, o int")
    assert sorted((r["k"], r["o"]) for r in ranking.upsert_by_key(df, new, "k").collect()) == [("a", 9), ("b", 3), ("b", 4)]


def test_margin_and_greedy(spark):
    df = spark.createDataFrame([("p", 1, 10.0, ["a"]), ("p", 2, 7.0, ["a"]), ("p", 3, 2.0, ["b"]), ("q", 4, 5.0, ["a"]), ("p", 5, 1.0, ["a"])], "point string, page int, score double, words array<string>")
    top = {r["point"]: (r["page"], r["margin"]) for r in ranking.top_with_margin(df, ["point"], "score", [F.desc("score"), F.asc("page")]).collect()}
    assert top == {"p": (1, 3.0), "q": (4, 5.0)}
    pages = {r["point"]: r["pages"] for r in ranking.greedy_pages(df, ["point"]).collect()}
    assert pages == {"p": [1, 3], "q": [4]}


BOOK = rules.RuleBook({"p": rules.Binding("把", "把.{2,}", ("P1", "P2"), ("W1",), ("S1", "S2"), ("一把",))}, ("例句",), {"u": ("请",)})


@pytest.mark.parametrize("limit", [64, 0])
def test_rule_semantics(spark, monkeypatch, limit):
    monkeypatch.setattr(rules, "LADDER_LIMIT", limit)
    rows = [
        (1, "他把书放下", "把书放下", "p"), (2, "他把", "把", "p"), (3, "一把大伞", "一把大伞", "p"), (4, "他来", "", "p"), (5, "别的", "把书放下", "p"), (6, "例句：把书放", "例句把书放", "p"),
        (7, "请坐下", "请坐", "u"), (8, "请", "请", "u"), (9, "天气", "雨天", "u"), (10, None, None, None),
    ]
    df = spark.createDataFrame(rows, "row_id int, sentence string, span string, label string")
    got = {r["row_id"]: r for r in rules.evaluate(df, BOOK).collect()}
    assert (got[1]["state"], got[1]["score"], got[1]["accepted"]) == ("accept", 2, True)
    assert got[2]["weak_ids"] == ["W1"] and got[2]["diagnosis"] == "weak_reject" and not got[2]["accepted"]
    assert got[3]["strong_ids"] == ["S2"] and got[3]["state"] == "strong"
    assert "GLOBAL-EMPTY-CANDIDATE" in got[4]["strong_ids"]
    assert got[5]["accepted"] and got[5]["weak_reject"] and got[5]["diagnosis"] == "weak_reject"
    assert got[6]["strong_ids"] == ["S1"]
    assert got[7]["accepted"] and got[7]["positive_ids"] == []
    assert not got[8]["structure_hit"] and got[9]["weak_ids"] == ["GLOBAL-OFFSET-MISMATCH"]
    assert got[10]["strong_reject"]
    src = spark.createDataFrame([("P1", "s2；s1"), ("P2", "s1")], "rule_id string, sources string")
    t = {r["row_id"]: r["trace"] for r in rules.with_sources(rules.evaluate(df, BOOK), src).collect()}
    assert t[1][-2:] == ["source:s1", "source:s2"] and t[1][2:4] == ["rule:P1", "rule:P2"]


def test_bootstrap_forms_agree(spark):
    rows = [(f"g{i % 40}", "s", "a" if i % 3 else "b", "a" if i % 5 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, system string, gold string, prediction string")
    cells = bootstrap.group_cells(df, ["system"], "g")
    h = one(bootstrap.interval(bootstrap.hash_replicates(cells, ["system"], "g", 300), ["system"], "accuracy"))
    n = one(bootstrap.interval(bootstrap.numpy_replicates(cells, ["system"], "g", ["a", "b"], 600), ["system"], "accuracy"))
    true = sum(r[2] == r[3] for r in rows) / len(rows)
    assert h["low"] <= true <= h["high"] and n["low"] <= true <= n["high"] and abs(h["mean"] - n["mean"]) < 0.02
    both = df.unionByName(df.withColumn("system", F.lit("t")))
    r = bootstrap.hash_replicates(bootstrap.group_cells(both, ["system"], "g"), ["system"], "g", 50)
    d = one(bootstrap.paired_delta(r, [], "system", "s", "t", "macro_f1"))
    assert d["delta"] == 0.0 and d["p_value"] == 1.0


def test_reliability_grades(spark):
    rows = [("A", 1)] * 25 + [("B", 1)] * 6 + [("D", 0)] * 6 + [("few", 1)]
    got = {r["rule"]: r["grade"] for r in tune.rule_reliability(spark.createDataFrame(rows, "r string, ok int"), "r", "ok").collect()}
    assert got == {"A": "A", "B": "B", "D": "D", "few": "insufficient"}


def test_graph_checks(spark):
    n = spark.createDataFrame([("a", "T", "x"), ("a", "T", "x"), ("b", "T", "y"), ("b", "T", "z")], "id string, type string, label string")
    assert [r["id"] for r in graph.node_conflicts(n, ["type", "label"]).collect()] == ["b"]
    e = spark.createDataFrame([("a", "R", "b", None), ("a", "R", "b", None), ("a", "R", "q", None), (None, "R", "b", None), ("b", "S", "c", None)], "source string, relation string, target string, properties_json string")
    assert sorted((r["relation"], r["side"], r["n"]) for r in graph.dangling(e, n).collect()) == [("R", "target", 1), ("S", "target", 1)]
    assert [(r["start"], r["stop"], r["n_paths"]) for r in graph.path_counts(e, ["R", "S"]).collect()] == [("a", "c", 1)]
    assert graph.degree_integrity(e.limit(0), ["R"]).count() == 0


def test_compiler_pieces(spark):
    d = spark.createDataFrame([(1, "总说1.甲2.乙"), (2, "只有1.一个"), (3, None), (4, "（1）甲（2）乙")], "k int, t string")
    got = [(r["k"], r["path"], r["unit"]) for r in compiler.split_units(d, "k", "t").orderBy("k", "unit_no").collect()]
    assert got == [(1, "01", "总说 甲"), (1, "02", "总说 乙"), (2, "01", "只有1.一个"), (4, "01", "甲"), (4, "02", "乙")]
    c = spark.createDataFrame([("k", "f", "a", "b", True), ("k", "f", "a", "c", True), ("z", "f", "a", "", True), ("y", "f", "a", "b", None)], "key string, field string, old string, new string, verified boolean")
    assert sorted((r["key"], r["reason"]) for r in compiler.reject_corrections(c).collect()) == [("k", "duplicate"), ("y", "unverified"), ("z", "empty")]
    p = compiler.patch(spark.createDataFrame([("y", "a", "q"), ("n", "a", None)], "id string, f string, g string"), spark.createDataFrame([("y", "f", "a", "b"), ("n", "f", "other", "b"), ("n", "g", None, "w")], "key string, field string, old string, new string"), "id", ["f", "g"])
    assert sorted((r["id"], r["f"], r["g"], r["patched"]) for r in p.collect()) == [("n", "a", "w", 1), ("y", "b", "q", 1)]


def test_alignment(spark):
    pts = align.best_cues(spark.createDataFrame([("p", "s", "把 字", 1.0), ("p", "s", "把字", 3.0), ("q", "s", "", 1.0), ("q", "s", "没有的", 2.0)], "point string, source string, cue string, weight double"), ["point", "source"])
    pages = spark.createDataFrame([("s", 1, "讲把字句"), ("s", 2, "无关"), ("t", 3, "把字")], "source string, page int, text string")
    want = [("s", 1, "把字"), ("t", 3, "把字")]
    assert sorted(tuple(r) for r in align.cue_hits(pages, pts, "page", "text", "source").collect()) == want
    limit, align.CUE_LIMIT = align.CUE_LIMIT, 0
    try:
        assert sorted(tuple(r) for r in align.cue_hits(pages, pts, "page", "text", "source").collect()) == want
    finally:
        align.CUE_LIMIT = limit
    m = spark.createDataFrame([("L", 1, 5), ("L", 2, 3), ("L", 2, 7), ("L", 3, 6), ("L", 4, 9)], "level string, o int, page int")
    assert [(r["o"], r["page"]) for r in align.monotone_pages(m, "level", "o", "page").orderBy("o").collect()] == [(1, 5), (2, 7), (4, 9)]


def test_verbatim_leaks(spark):
    t = spark.createDataFrame([(1, "xx needle one yy needle two"), (2, "nothing"), (3, None), (4, "needle two")], "doc long, t string")
    n = spark.createDataFrame([(7, "needle two"), (5, "needle one"), (9, "needle one"), (6, "no")], "id long, n string")
    got = govern.verbatim_leaks(t, n, "doc", "t", "id", "n", 5)
    assert sorted((r["doc"], r["id"]) for r in got.collect()) == [(1, 5), (4, 7)]
    assert govern.verbatim_leaks(t, n.limit(0), "doc", "t", "id", "n").count() == 0


def test_features(spark):
    d = spark.createDataFrame([(1, "abab"), (2, "ab"), (3, ""), (4, None)], "k int, t string")
    w = features.tfidf_weights(d, "k", "t", 2)
    assert {(r["k"], r["gram"]) for r in w.collect()} == {(1, "ab"), (2, "ab")}
    assert all(r["weight"] == 1.0 for r in w.collect())


def test_expectations(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for bad in (lambda: expect.expect_unique(d, ["k"]), lambda: expect.expect_rows(d, 3), lambda: expect.expect_domain(d, "v", ["a"]), lambda: expect.expect_columns(d, ["k"]), lambda: expect.exactly_one(d)):
        with pytest.raises(expect.ExpectationError):
            bad()
    with pytest.raises(expect.ExpectationError):
        expect.expect_reference(d, "v", d.where("v = 'a'").withColumnRenamed("v", "w"), "w")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id, name \n1,"two\nlines"\n2,  x  \n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [("1", "two\nlines"), ("2", "x")]
    assert not files.write_csv(got.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert files.read_csv(spark, str(tmp_path / "missing.csv"), missing_ok=True).count() == 0
    files.write_csv(got, str(tmp_path / "out"), ["name"], ["id"][:0] or ["name"], single=True)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1
    (tmp_path / "j.json").write_text('{"rows": [{"a": 1}, {"a": 2}]}')
    assert files.read_json(spark, str(tmp_path / "j.json"), ("candidates", "rows")).count() == 2
    (tmp_path / "page-7.txt").write_text("seven")
    assert [tuple(r) for r in files.read_text_pages(spark, str(tmp_path / "page-*.txt")).collect()] == [(7, "seven")]
    h = {r["file"]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path / "page-7.txt")).collect()}
    import hashlib

    assert h == {"page-7.txt": hashlib.sha256(b"seven").hexdigest()}
    assert "| id |" in files.markdown_table(got, ["id"], ["id"])


def test_executor_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("他把书放下", "把书放下", "p", "2027-01-01 10:00:00"), ("x", "", "p", "2027-01-02 10:00:00")], "sentence string, span string, label string, t string").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    state_mix.run_once(rules.evaluate(src, BOOK).select("ts", "state"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = state_mix.state_mix(spark.read.parquet(str(tmp_path / "out")), "ts", "state")
    assert sorted((r["state"], r["n"]) for r in got.collect()) == [("accept", 1), ("strong", 1)]


def test_text_forms(spark):
    d = spark.createDataFrame([(" ＡB，c　d ",), (None,)], "t string")
    r = d.select(T.squeeze_sentence("t"), T.without_formatting("t"), T.strip_unicode("t")).collect()
    assert tuple(r[0]) == ("ａb,cd", "ａbcd", "ＡB，c　d") and tuple(r[1]) == ("", None, "")


def test_pattern_helpers(spark):
    from glossmill.functions import patterns as P

    assert P.repair_pattern('"(?P<a>x)\\Qa.b\\E……"') == "(?<a>x)a\\.b.{0,12}"
    assert P.literal_fallback(["a", "bb", "a", "c.d", ""]) == "c\\.d|bb|a"
    v = {r["p"]: r["valid"] for r in P.pattern_validity(spark.createDataFrame([("a(b",), ("(?P<x>a)",), ("",), (None,)], "p string"), "p").collect()}
    assert v == {"a(b": False, "(?P<x>a)": True, "": False, None: False}
    d = spark.createDataFrame([("名：值", [1.0, 1.0], {"a": 3.0})], "t string, m array<double>, p map<string,double>")
    r = d.select(P.label_head(F.col("t")), P.softmax_confidence(F.col("m")), P.margin_confidence(F.lit(0.0)), P.aligned_probabilities(F.col("p"), ["a", "b"]), P.clean_speaker(F.lit("· 老周：去 \t 湖边"))).collect()[0]
    assert r[0] == "名" and r[1] == 0.5 and r[2] == 0.5 and r[3][0] == pytest.approx(1.0) and r[4] == "去 湖边"


def test_stratified_groups(spark, monkeypatch):
    from glossmill.operators import grouping

    monkeypatch.setattr(grouping, "BUCKET_GROUPS", 60)
    rows = [(f"g{i % 150}", "a" if i % 4 else "b") for i in range(3000)] + [("big", "a")] * 200 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "grp string, y string")
    folds = {r["grp"]: r["fold"] for r in grouping.stratified_group_folds(df, "grp", "y", 5).collect()}
    assert set(folds) == {g or "" for g, _ in rows} and set(folds.values()) == set(range(5))
    sizes = [sum(folds[g or ""] == k for g, _ in rows) for k in range(5)]
    assert max(sizes) < 1.5 * min(sizes)
    split = {r["grp"]: r["split"] for r in grouping.three_way_split(df, "grp", "y").collect()}
    assert set(split) == set(folds) and set(split.values()) == {"train", "dev", "test"}


def test_full_bootstrap_equals_brute_force(spark, monkeypatch):
    from glossmill.plans import base, eval_plans

    rows = [(i, i % 2, f"g{i % 13}", s, "支持" if i % 3 else "不支持", "支持" if (i * 7 + k) % 4 else "不支持") for i in range(120) for k, s in enumerate(("model", "cues"))]
    df = spark.createDataFrame(rows, "row_id int, seed int, gkey string, system string, gold string, prediction string")
    monkeypatch.setattr(base, "systems", lambda spark, d: df)
    monkeypatch.setattr(bootstrap, "WEIGHT_ROWS", 4)
    draws = 5000
    w = {g: np.random.default_rng([42, *g.encode()]).poisson(1.0, draws) for g in {r[2] for r in rows}}

    def scores(part):
        f1 = []
        for x in base.LABELS:
            tp, both = np.zeros(draws), np.zeros(draws)
            for r in part:
                tp += w[r[2]] * (r[4] == x == r[5])
                both += w[r[2]] * ((r[4] == x) + (r[5] == x))
            f1.append(np.divide(2 * tp, both, out=np.zeros(draws), where=both > 0))
        n = sum(w[r[2]] for r in part)
        right = sum(w[r[2]] * (r[4] == r[5]) for r in part)
        return sum(f1) / 3, np.divide(right, n, out=np.zeros(draws), where=n > 0)

    def bounds(d):
        return [round(float(x), 4) for x in (d.mean(), *np.quantile(d, [0.025, 0.975]), min(1, 2 * min((d <= 1e-10).mean(), (d >= -1e-10).mean())))]

    at = lambda s, *seeds: [r for r in rows if r[3] == s and r[1] in seeds]
    got = one(eval_plans.paired_bootstrap_full(spark, ""))
    assert [round(got[c], 4) for c in ("delta", "low", "high", "p_value")] == bounds(scores(at("model", 0, 1))[0] - scores(at("cues", 0, 1))[0])
    got = one(eval_plans.pooled_bootstrap_full(spark, ""))
    assert [round(got[c], 4) for c in ("delta", "low", "high", "p_value")] == bounds(sum(scores(at("model", k))[1] - scores(at("cues", k))[1] for k in (0, 1)) / 2)
    ci = {r["system"]: r["n_draws"] for r in eval_plans.numpy_bootstrap_ci(spark, "").collect()}
    assert ci == {"model": 5000, "cues": 5000}


def test_leak_scan_full_takes_all_sentences(spark, monkeypatch):
    from glossmill.plans import text_plans

    tables = {
        "documents": spark.createDataFrame([(1, "前文。这是试题里的第二个句子没有错。后文"), (2, "前文，候选句子也要在文档里找出来，后文"), (3, "又短。也短。还短。再短。"), (4, "无关"), (5, None)], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(7, "第一句。这是试题里的第二个句子没有错。"), (8, "又短。也短。还短。再短。"), (9, None)], "item_id long, text string"),
        "author_written_244": spark.createDataFrame([(4, "候选句子也要在文档里找出来"), (5, "无关")], "row_id long, sentence string"),
    }
    monkeypatch.setattr(text_plans, "table", lambda spark, d, name: tables[name])
    got = sorted(tuple(r) for r in text_plans.leak_scan_full(spark, "").collect())
    assert got == [(1, "benchmark", 7), (2, "author_written_244", 4), (3, "benchmark", 8)]


def test_greedy_choice_keeps_pages_with_other_cues(spark, monkeypatch):
    from glossmill.plans import text_plans

    points = spark.createDataFrame([("p", "s", "甲甲", 30.0), ("p", "s", "乙乙", 9.0), ("p", "s", "丙丙", 8.5)], "point string, source string, cue string, weight double")
    hits = spark.createDataFrame([("s", 1, "甲甲"), ("s", 2, "乙乙"), ("s", 3, "丙丙"), ("s", 4, "丙丙")], "source string, page_id long, cue string")
    monkeypatch.setattr(text_plans, "_scored", lambda spark, d: align.page_scores(points, hits))
    assert [tuple(r) for r in text_plans.greedy_page_choice(spark, "").collect()] == [("p", "1,2,3")]


def test_rerank_alpha_is_chosen_on_dev(spark, monkeypatch):
    from glossmill.plans import eval_plans

    row = lambda i, split, gold, pred, c, rule: (i, split, gold, pred, c, rule, int(gold == pred))
    rows = [row(i, "train", "支持", "支持", 0.9, "good") for i in range(40)]
    # a label that needs a weight of more than ln(0.35 / 0.3) / 0.976 = 0.158 from its rule to come out on top
    rows += [row(100 + i, s, "支持", "支持", 0.3, "good") for s, i in (("dev", 0), ("dev", 1), ("test", 2))]
    rows += [row(200 + i, s, "不支持", "不支持", 0.9, "other") for s, i in (("dev", 0), ("test", 1))]
    df = spark.createDataFrame(rows, "row_id int, split string, gold string, prediction string, confidence double, rule string, correct int")
    monkeypatch.setattr(eval_plans, "_votes", lambda spark, d: df)
    used = []
    monkeypatch.setattr(tune, "rerank", lambda p, v, k, a, plain=tune.rerank: (used.append(a), plain(p, v, k, a))[1])
    got = {r["row_id"]: r["label"] for r in eval_plans.rerank_predictions_tuned(spark, "").collect()}
    assert got == {102: "支持", 201: "不支持"} and used[-1] == 0.25


def test_page_score_terms(spark):
    pages = spark.createDataFrame(
        [("s", 1, "12 把字句\n基本语义及用法：说明。"), ("s", 2, "目录\n把字句 34"), ("s", 3, "正文里也有把字句，写得很长很长，没有编号。"), ("s", 4, "【三007】别的内容"), ("s", 5, "只有一个把，别无其他，很长的一行正文内容在这里继续下去。"), ("s", 6, None)],
        "source string, page int, text string",
    )
    points = spark.createDataFrame(
        [("p", "s", "把字句", 25.0, "grammar_full"), ("p", "s", "把", 4.0, "grammar_component"), ("p", "s", "三7", 0.0, "official_id")], "point string, source string, cue string, weight double, origin string"
    )
    scored = align.page_scores(points, align.evidence(points, pages, "page", "text", "source"))
    got = {r["page_id"]: r["score"] for r in scored.collect()}
    full, head = 22.0 + 3 * 0.7, 42.0 + 3 * 1.2
    assert got == {1: round(2.0 + full + head + 1.0, 3), 2: 0.0, 3: round(full + 1.0 + head, 3) if got[3] > 60 else round(full + 1.0, 3), 4: 48.0, 5: 1.0}
    kinds = {r["page_id"]: r["method"] for r in align.classify(scored).collect()}
    assert kinds[1] == "handbook_heading_lexical" and kinds[4] == "best_available_page_local_evidence" and kinds[5] == "best_available_page_local_evidence"
    assert align.top_page(scored).select("page_id").first()[0] == 1


def test_parsing_helpers(spark):
    from glossmill.functions import parsing

    df = spark.createDataFrame([(1, "他说“把门关上”，把窗打开", "七－"), (2, "把“把", None), (3, "", "Level 7/8/9"), (4, None, " 三级 ")], "k int, s string, lv string")
    at = {r["k"]: r["p"] for r in df.select("k", parsing.positions_outside_quotes(F.col("s"), "把").alias("p")).collect()}
    assert at[1] == [10] and at[2] == [1] and at[3] == [] and not at[4]
    levels = df.where("k > 1").select("k", parsing.normalise_level(F.col("lv")).alias("v")).collect()
    assert {r["k"]: r["v"] for r in levels} == {2: None, 3: "7-9", 4: "3"}
    with pytest.raises(Exception, match="unknown level"):
        df.where("k = 1").select(parsing.normalise_level(F.col("lv"))).collect()
    got = df.limit(1).select(parsing.page_anchors(F.lit("初等 p.12；中等p.7；p.9")).alias("a"), parsing.page_anchors(F.lit(None).cast("string")).alias("n")).first()
    assert [tuple(x) for x in got["a"]] == [("elementary", 12), ("intermediate", 7)] and got["n"] == []
    assert df.limit(1).select(parsing.literal_markers(F.lit("把；结果; 越...越；等着；把")).alias("m")).first()["m"] == ["把", "把"]
    holds = lambda s, m: df.limit(1).select(parsing.holds_all(F.lit(s), F.array(*[F.lit(x) for x in m])).alias("h")).first()["h"]
    assert holds("有的来，有的走", ["有的", "有的"]) and not holds("有的来", ["有的", "有的"]) and holds("x", [])
    j = spark.createDataFrame([("b", None, 3, ""), ('q"', "c", 0, "y")], "z string, a string, n int, e string")
    assert sorted(r[0] for r in j.select(parsing.canonical_json(j, ["z", "a", "n", "e"])).collect()) == ['{"a":"c","e":"y","n":0,"z":"q\\""}', '{"n":3,"z":"b"}']


def test_grid_and_quality_by_definition(spark):
    from glossmill.functions import patterns

    assert len(list(tune.weight_grid(spark).collect())) == 1260
    rows = [("D1", 0)] + [("E", 1)] * 3 + [("E", 0)] * 3
    got = {r["rule"]: (r["grade"], r["weight"]) for r in tune.rule_reliability(spark.createDataFrame(rows, "r string, ok int"), "r", "ok").collect()}
    assert got == {"D1": ("D", 0.0), "E": ("insufficient", 0.15)}
    q = spark.createDataFrame([("小王把书放在桌子上了", "把书"), ("主语用在句中：动词（名词）", None), (None, None), ("长" * 70, "x" * 20)], "s string, p string")
    assert [r[0] for r in q.select(patterns.candidate_quality(F.col("s"), F.col("p"))).collect()] == [8, -2, 2, 0]
