"""Alignment of catalogue points to document pages by lexical evidence.

Points carry cues (keywords with weights).  Pages are never crossed with points: distinct cues, whose number does not
grow with pages or points, are looked up in each page once, and hits are joined to points by (source, cue).  When the
distinct cues outgrow ``CUE_LIMIT``, the look-up runs over the pages' own n-grams instead, as an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import ratio
from glossmill.operators.features import char_ngrams
from glossmill.operators.ranking import top_with_margin

CUE_LIMIT = 5_000
#: What marks content pages, navigation pages, headings and printed ids.
CONTENT = ("基本语义及用法", "典型例句和对话", "结构特点", "补充例句", "小提示")
NAVIGATION = ("目录", "索引", "语法术语缩略形式一览表")
DESCRIPTION = "基本语义及用法"
HEADING = r"^\d{1,3}|词|句|结构"
PRINTED_ID = r"([一二三四五六]\d{1,3})(?!\d)"


def compacted(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def best_cues(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cue, weight, origin): one row per normalised cue with its best weight; empty cues are dropped.

    Cues without ``origin`` are components of the point's label.
    """
    if "origin" not in cues.columns:
        cues = cues.withColumn("origin", F.lit("grammar_component"))
    norm = cues.withColumn("cue", compacted(F.col("cue"))).where(F.col("cue") != "")
    return norm.groupBy(*keys, "cue").agg(F.max(F.struct("weight", "origin")).alias("b")).select(*keys, "cue", "b.weight", "b.origin")


def cue_hits(pages: DataFrame, cues: DataFrame, page_id: str, text: str, source: str) -> DataFrame:
    """(source, page_id, cue): distinct cues found in the compact text of each page."""
    words = cues.select("cue").distinct()
    found = words.limit(CUE_LIMIT + 1).collect()
    compact = pages.select(F.col(source).alias("source"), F.col(page_id).alias("page_id"), compacted(F.col(text)).alias("compact"))
    if len(found) <= CUE_LIMIT:
        table = F.array(*[F.lit(r["cue"]) for r in found]) if found else F.array().cast("array<string>")
        # bound to a variable, so that the page is made compact once and not again for every cue
        here = F.element_at(F.transform(F.array("compact"), lambda t: F.filter(table, lambda c: t.contains(c))), 1)
        return compact.select("source", "page_id", F.explode(here).alias("cue"))
    lengths = [r["n"] for r in words.select(F.length("cue").alias("n")).distinct().collect()]
    grams = compact.select(
        "source", "page_id", F.explode(F.array_distinct(F.flatten(F.array(*[char_ngrams(F.col("compact"), n) for n in lengths])))).alias("cue")
    )
    return grams.join(words, "cue", "left_semi").select("source", "page_id", "cue")


def page_facts(pages: DataFrame, page_id: str, text: str, source: str) -> DataFrame:
    """(source, page_id, compact, headings, content, navigation, ids) of each page: compact lines that look like headings,
    whether it is a content or a navigation page, and the printed ids (level sign and number) on it."""
    t, compact = F.col(text), compacted(F.col(text))
    lines = F.filter(F.transform(F.split(t, "\n"), compacted), lambda x: x.rlike(HEADING))
    return pages.select(
        F.col(source).alias("source"), F.col(page_id).alias("page_id"), compact.alias("compact"), lines.alias("headings"),
        F.exists(F.array(*[F.lit(m) for m in CONTENT]), lambda m: t.contains(m)).alias("content"),
        F.exists(F.array(*[F.lit(m) for m in NAVIGATION]), lambda m: compact.contains(m)).alias("navigation"),
        F.array_distinct(F.transform(F.regexp_extract_all(compact, F.lit(PRINTED_ID), F.lit(1)), lambda x: F.regexp_replace(x, "(?<=^.)0+(?=.)", ""))).alias("ids"),
    )


def evidence(points: DataFrame, pages: DataFrame, page_id: str, text: str, source: str) -> DataFrame:
    """(source, page_id, cue, printed, heading, content, navigation): hits of cues on pages and, ``printed``, of printed ids,
    which are points' cues of origin ``official_id``; ``heading`` where a short heading line holds the cue, or the description marker follows."""
    facts = page_facts(pages, page_id, text, source)
    plain = points.where(F.col("origin") != "official_id")
    seen = cue_hits(pages, plain, page_id, text, source).join(facts, ["source", "page_id"])
    n = F.length("cue")
    after = F.substring(F.col("compact"), F.expr("locate(cue, compact)"), n + 100)
    heading = (n >= 2) & (F.exists("headings", lambda x: x.contains(F.col("cue")) & (F.length(x) <= n + 24)) | after.contains(DESCRIPTION))
    printed = facts.select("source", "page_id", F.explode("ids").alias("cue"), F.lit(True).alias("printed"), F.lit(False).alias("heading"), "content", "navigation")
    return seen.select("source", "page_id", "cue", F.lit(False).alias("printed"), heading.alias("heading"), "content", "navigation").unionByName(
        printed.join(points.where(F.col("origin") == "official_id").select("source", "cue").distinct(), ["source", "cue"], "left_semi")
    )


def page_scores(points: DataFrame, hits: DataFrame) -> DataFrame:
    """(point, source, page_id, n_cues, cues, score): the evidence that a page treats a point.

    Everything is one aggregate over the hits joined to points by (source, cue): a content page, a navigation page, the
    printed id, the full label, its components (capped), the longest heading, a section item beside the label, literals of
    older patterns.  A single one-sign match without id or heading counts 3 at most.  Hits without ``heading`` and page
    facts are plain ones.
    """
    if "origin" not in points.columns:
        points = points.withColumn("origin", F.lit("grammar_component"))
    for c in ("heading", "content", "navigation"):
        if c not in hits.columns:
            hits = hits.withColumn(c, F.lit(False))
    j = points.join(hits, ["source", "cue"])
    if "printed" in hits.columns:
        j = j.where(F.col("printed") == (F.col("origin") == "official_id"))
    n, w, origin = F.length("cue"), F.col("weight"), F.col("origin")
    is_id, full = origin == "official_id", origin == "grammar_full"
    label = origin.isin("grammar_full", "canonical", "grammar_component")
    part = F.when(is_id | full, 0.0).when(n == 1, F.least(w, F.lit(1.0))).when(n == 2, F.least(w, F.lit(5.0))).otherwise(w)
    longest = lambda cond: F.max(F.when(cond, n))
    head = F.col("heading")
    agg = j.groupBy("point", "source", "page_id").agg(
        F.count_if(~is_id).alias("n_cues"), F.array_sort(F.collect_set(F.when(~is_id, F.col("cue")))).alias("cues"),
        F.max("content").alias("content"), F.max("navigation").alias("navigation"), F.max(is_id).alias("printed"), longest(full).alias("full"),
        F.least(F.lit(38.0), F.sum(part)).alias("parts"), longest(head & label).alias("label_head"), longest(head & (origin == "section_item")).alias("section_head"),
        F.max(origin == "section_item").alias("section"), F.max(label).alias("labelled"), F.max(origin == "legacy_regex_literal").alias("legacy"), F.max(~is_id & (n >= 2)).alias("substantive"),
        F.count_if(label).alias("n_label"), F.count_if(label & (n >= 2)).alias("n_long_label"), F.count_if(~is_id & (n >= 2)).alias("n_long"),
    )
    points_if = lambda cond, k: F.when(cond, k).otherwise(0.0)
    capped = lambda c, most, each: F.least(F.col(c), F.lit(most)) * each
    score = (
        points_if(F.col("content"), 2.0)
        - points_if(F.col("navigation") & ~F.col("content"), 80.0)
        + points_if(F.col("printed"), 48.0)
        + points_if(F.col("full").isNotNull(), 22.0 + capped("full", 18, 0.7))
        + F.col("parts")
        + F.when(F.col("label_head").isNotNull(), 42.0 + capped("label_head", 15, 1.2)).when(F.col("section_head").isNotNull(), 15.0 + capped("section_head", 15, 0.8)).otherwise(0.0)
        + points_if(F.col("section") & F.col("labelled"), 9.0)
        + points_if(F.col("legacy"), 1.5)
    )
    alone = ~F.col("printed") & F.col("label_head").isNull() & F.col("section_head").isNull() & ~F.col("substantive")
    score = F.when(alone, F.least(score, F.lit(3.0))).otherwise(score)
    flags = ("printed", "n_label", "n_long_label", "n_long", F.col("full").isNotNull().alias("full"), F.coalesce("label_head", "section_head").isNotNull().alias("headed"))
    return agg.select("point", "source", "page_id", "n_cues", "cues", F.round(F.greatest(score, F.lit(0.0)), 3).alias("score"), *flags)


def top_page(scored: DataFrame) -> DataFrame:
    """The best page of every point with ``margin``, ties to the smaller page; a missing second counts 0.

    The cues are left out, so that they aren't gathered for every page of a point.
    """
    best = top_with_margin(scored.drop("cues", "n_cues"), ["point"], "score", [F.desc("score"), F.asc("page_id")])
    return best.withColumn("margin", F.round("margin", 3))


def classify(top: DataFrame) -> DataFrame:
    """Adds method, status and confidence by a ladder of eight methods; the order of the steps is the contract."""
    s, printed, headed, full = F.col("score"), F.col("printed"), F.col("headed"), F.col("full")
    label, long_label, long = F.col("n_label") > 0, F.col("n_long_label"), F.col("n_long")
    ladder = (
        (printed & (headed | label), "printed_id_plus_lexical", "aligned", "high"),
        (printed & (long >= 2) & (s >= 30), "printed_id_plus_taxonomy", "aligned", "medium"),
        (headed & (full | label) & (s >= 55), "handbook_heading_lexical", "aligned", "high"),
        (headed & (full | label), "handbook_heading_lexical", "aligned", "medium"),
        (full & (long_label > 0) & (s >= 30), "full_label_lexical", "aligned", "medium"),
        (full & (long_label > 0), "full_label_lexical", "low_confidence", "low"),
        ((long_label >= 2) & (s >= 25), "multi_cue_lexical", "aligned", "medium"),
        ((long_label > 0) & (s >= 12), "single_cue_lexical", "low_confidence", "low"),
        ((long > 0) & (s >= 8), "taxonomy_lexical", "low_confidence", "low"),
    )
    out = F.struct(F.lit("best_available_page_local_evidence").alias("method"), F.lit("low_confidence").alias("status"), F.lit("low").alias("confidence"))
    for cond, method, status, confidence in reversed(ladder):
        out = F.when(cond, F.struct(F.lit(method).alias("method"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return top.withColumn("_c", out).select("*", "_c.method", "_c.status", "_c.confidence").drop("_c")


def dominant_offset(pairs: DataFrame, keys: list[str], offset: Column, support: int = 20) -> DataFrame:
    """(keys, offset, n): the most frequent offset with enough support; ties to the smaller."""
    c = pairs.groupBy(*keys, offset.alias("offset")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    return c.groupBy(*keys).agg(F.min_by("offset", F.struct((-F.col("n")).alias("a"), "offset")).alias("offset"), F.max("n").alias("n"))


def anchor_audit(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """(point, n_anchors, existing, verified_share, status): which of a point's page anchors exist."""
    known = pages.select("source", "page").distinct().withColumn("hit", F.lit(1))
    j = anchors.select("point", "source", "page").distinct().join(known, ["source", "page"], "left")
    n, hit = F.count(F.lit(1)), F.count("hit")
    return j.groupBy("point").agg(
        n.alias("n_anchors"), hit.alias("existing"), F.round(ratio(hit, n), 6).alias("verified_share"),
        F.when(hit == n, "verified").when(hit > 0, "partly_verified").otherwise("unverified").alias("status"),
    )


def range_anchor(tokens: DataFrame, ranges: DataFrame, level: str, page: str) -> DataFrame:
    """Tokens whose page lies within the range of their level: an equi-join on level with a bounded range frame."""
    r = ranges.withColumnRenamed(level, "_l")
    return tokens.join(F.broadcast(r), (tokens[level] == F.col("_l")) & tokens[page].between(F.col("start_page"), F.col("end_page"))).drop("_l")


def monotone_pages(candidates: DataFrame, level: str, ordinal: str, page: str) -> DataFrame:
    """(level, ordinal, page): for rising ordinals the earliest candidate page not before the page chosen last.

    Sequential by nature within a level; the work per level is bounded by the catalogue (points x pages), because
    candidates are reduced to distinct (ordinal, page) first and fold inside the JVM.
    """
    per = candidates.groupBy(level, ordinal).agg(F.array_sort(F.collect_set(page)).alias("pages"))
    rows = per.groupBy(level).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), "pages"))).alias("os"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<o:int,page:int>>").alias("out"))

    def step(acc, x):
        later = F.filter(x["pages"], lambda p: p >= acc["last"])
        first = F.try_element_at(later, F.lit(1))
        taken = F.struct(first.alias("last"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), first.alias("page")))).alias("out"))
        return F.when(F.size(later) > 0, taken).otherwise(acc)

    return rows.select(level, F.explode(F.aggregate("os", start, step)["out"]).alias("r")).select(level, F.col("r.o").alias(ordinal), F.col("r.page").alias(page))
