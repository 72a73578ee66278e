"""The page search against the scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glossmill.operators import align, page_search, ranking
from glossmill.plans import text_plans

WORDS = ["主语", "宾语", "把", "越来越", "得", "结果补语", "趋向", "有", "「时段」", "不管"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Points and handbook pages of few words, so that many pairs share one; headings, ids, navigation and content pages."""
    rng = random.Random(7)
    source = lambda: rng.choice(["SRC-HB-ELEM", "SRC-HB-INTER", None])
    points = [(f"STD-{rng.randint(1, 6)}-{i:08d}", source(), rng.choice(["，", "；"]).join(rng.sample(WORDS, rng.randint(1, 6)))) for i in range(90)]
    lines = lambda: [rng.choice(["", "第", "1"]) + rng.choice(WORDS) + rng.choice(["", "句", "的说明" * 12]) for _ in range(rng.randint(1, 5))]
    signs = lambda: rng.choice(["", "", "", "目录", "小提示", f"【{rng.choice('一二三四五六')}{rng.randint(0, 90):02d}】", "基本语义及用法"])
    pages = [(1000 - i, "\n".join([*lines(), signs()]), "handbook_a", rng.choice(["初等", "中等", None])) for i in range(240)]
    return {
        "standard_handbook_alignment_v3": spark.createDataFrame(points, "standard_point_id string, handbook_source_id string, matched_source_derived_keywords string"),
        "documents": spark.createDataFrame(pages, "doc_id long, text string, source string, level_label string"),
    }


@pytest.fixture(params=[page_search.CELLS, 300])
def scores(spark, corpus, monkeypatch, request):
    """Scores of all pairs; the second time, the pages of a source take several blocks."""
    monkeypatch.setattr(text_plans, "table", lambda spark, d, name: corpus[name])
    monkeypatch.setattr(page_search, "CELLS", request.param)
    return align.page_scores(*text_plans._evidence(spark, "")).cache()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_greedy_choice_without_all_pairs(spark, scores):
    j = scores.select("point", F.col("page_id").cast("int").alias("page"), "score", F.col("cues").alias("words"))
    want = {r["point"]: ",".join(map(str, r["pages"])) for r in ranking.greedy_pages(j, ["point"]).collect()}
    assert {r["point"]: r["pages"] for r in text_plans.greedy_page_choice(spark, "").collect()} == want and len(want) > 50
    pairs = text_plans._scored(spark, "").select(scores.columns)
    assert set(map(repr, collected(pairs))) <= set(map(repr, collected(scores)))
    if page_search.CELLS > 300:
        assert pairs.groupBy("point").count().agg(F.max("count")).first()[0] <= 8 + 6 < scores.groupBy("point").count().agg(F.max("count")).first()[0]


def test_classes_without_all_pairs(spark, scores, monkeypatch):
    c = align.classify(align.top_page(scores)).groupBy("method", "status", "confidence").agg(F.count(F.lit(1)).alias("n_points"))
    want = collected(c)
    monkeypatch.setattr(align, "page_scores", None)
    assert collected(text_plans.page_align_classes(spark, "")) == want and len(want) >= 3


def test_top_page_without_all_pairs(spark, scores, monkeypatch):
    want = collected(align.top_page(scores.select("point", "source", "page_id", "score")))
    monkeypatch.setattr(align, "page_scores", None)
    assert collected(text_plans.page_align_top1(spark, "")) == want and len(want) > 50
