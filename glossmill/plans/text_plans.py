"""Text, compilation, alignment, governance, features, sources and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import align, compiler, features, govern, page_search, ranking
from glossmill.plans import base
from glossmill.plans.base import SQL_CANDIDATES, SQL_FACTS, sql_split
from glossmill.session import new_path, table
from glossmill.sources import files
from glossmill.streaming import state_mix as streaming

PUNCT_FROM, PUNCT_TO = "，。！？；：（）“”‘’", ",.!?;:()\"\"''"


def group_ids_dups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of sentences that are equal after squeezing, with their number of rows."""
    a = table(spark, d, "author_written_244").select(T.group_id("sentence").alias("group_id"))
    return a.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def dup_group_sizes(spark, d):
    docs = table(spark, d, "documents").select(T.group_id("text").alias("group_id"))
    return docs.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def split_overlap_check(spark, d):
    """Rows and groups per split by hashed group, and the number of groups in more than one split."""
    f = base.facts(spark, d).withColumn("gkey", base.group_key())
    s = f.withColumn("split", base.split_name(F.col("gkey")))
    spread = s.groupBy("gkey").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("overlap"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("gkey").alias("n_groups")).crossJoin(F.broadcast(spread))


def text_forms(spark, d):
    """Several normal forms of a sentence, as hashes."""
    a = table(spark, d, "author_written_244")
    digits = F.translate(F.coalesce("sentence", F.lit("")), "０１２３４５６７８９", "0123456789")
    return a.select(
        "row_id", F.md5(T.squeeze_sentence("sentence")).alias("squeezed"), F.md5(F.coalesce(T.without_formatting("sentence"), F.lit(""))).alias("bare"), F.md5(digits).alias("ascii_digits"),
        T.stable_id("U-", F.col("item_id"), F.col("label")).alias("unit_id"),
    )


def sentence_split(spark, d):
    """Sentences per document after splitting at Chinese terminators and line breaks, and those of good quality."""
    s = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.split("text", r"(?<=[。！？；;])|\n")).alias("s"))
    s = s.select("doc_id", F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("s")).where(F.col("s") != "")
    good = F.col("s").rlike("[一-龥]") & F.length("s").between(6, 85) & ~F.col("s").rlike("[A-Za-z]{8}") & ~F.col("s").rlike(r"^[0-9]+[.、]")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(good).alias("n_good"), F.max(F.length("s")).alias("longest"))


def page_topic_hints(spark, d):
    """The first four marker words found in each document, joined."""
    hints = F.array(*[F.lit(h) for h in ("把", "被", "连", "除了", "无论", "与其", "越来越", "随着")])
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.array_join(F.slice(F.filter(hints, lambda h: F.col("text").contains(h)), 1, 4), "；").alias("hints"))


def _fixes(spark, d):
    """Corrections derived from the catalogue: families of points without status, and one label's spelling."""
    g = table(spark, d, "grammar_points_v0_1")
    cell = lambda field, new, ok: [F.col("grammar_point_id").alias("key"), F.lit(field).alias("field"), F.col(field).alias("old"), F.lit(new).alias("new"), ok.alias("verified")]
    fam = g.where(F.col("source_status").isNull()).select(*cell("family", "待核", F.lit(True)))
    lab = g.where(F.col("canonical_label") == "与其不如").select(*cell("canonical_label", "与其／不如", F.col("source_status").isNotNull()))
    return g, fam.unionByName(lab)


def corrections_patch(spark, d):
    g, fixes = _fixes(spark, d)
    out = compiler.patch(g.select("grammar_point_id", "family", "canonical_label"), fixes.where("verified"), "grammar_point_id", ["family", "canonical_label"])
    return out.select("grammar_point_id", "family", "canonical_label", F.col("patched").cast("int").alias("patched"))


def corrections_rejected(spark, d):
    return compiler.reject_corrections(_fixes(spark, d)[1]).groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"))


def unit_split(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    u = compiler.split_units(docs, "doc_id", "text")
    return u.select("doc_id", F.col("unit_no").cast("int").alias("unit_no"), "path", F.md5("unit").alias("unit_md5"))


def taxonomy_templates(spark, d):
    p = table(spark, d, "part")
    return compiler.templates(p, ["p_type", "p_brand"], F.when(F.col("p_size") > 25, "large").otherwise("small"), "p_partkey").select("template_id", "p_type", "p_brand", "regime", "members", "first_member")


def taxonomy_histogram(spark, d):
    """Types whose count is not the expected one."""
    return compiler.histogram_gap(table(spark, d, "part").withColumn("size_class", F.when(F.col("p_size") > 25, "large").otherwise("small")), "size_class", {"large": 1000, "small": 1, "none": 5})


def _tests(spark, d):
    g = table(spark, d, "grammar_points_v0_1").select("grammar_point_id", F.substring("canonical_label", 1, 2).alias("literal"))
    return compiler.run_contract_tests(compiler.contract_tests(g, "grammar_point_id"))


def contract_tests(spark, d):
    return _tests(spark, d).select("test_id", "case", "actual", F.col("passed").cast("int").alias("passed"))


def audit_bools(spark, d):
    t = _tests(spark, d).groupBy("grammar_point_id").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("case")).alias("kinds"), F.bool_and("passed").alias("ok"), F.bool_or(F.length("literal") == 0).alias("blank"))
    checks = {"seven_tests": F.col("n") == 7, "all_cases": F.col("kinds") == 7, "all_passed": F.col("ok"), "literal_given": ~F.col("blank"), "key_given": F.col("grammar_point_id") != ""}
    return compiler.audit(t, checks).select("check_name", F.col("passed").cast("int").alias("passed"), "n_failed")


def marker_alternation(spark, d):
    """Escaped alternation patterns from marker lists."""
    g = table(spark, d, "grammar_points_release").where(F.col("markers").isNotNull())
    words = F.transform(F.split("markers", "[；;，,、|/]"), lambda w: F.regexp_replace(w, r"^[\s\"'“”「」\[\]{}]+|[\s\"'“”「」\[\]{}]+$", ""))
    return g.select("grammar_point_id", compiler.escaped_alternation(words).alias("pattern"))


def level_normalised(spark, d):
    """Level of a catalogue id, 7 to 9 as one, with the number of points."""
    a = table(spark, d, "standard_handbook_alignment_v3").select(F.regexp_extract("standard_point_id", r"^STD-([0-9](?:-9)?)-", 1).alias("level"))
    name = F.when(F.col("level") == "7-9", "高等").when(F.col("level").isin("4", "5", "6"), "中等").when(F.col("level").isin("1", "2", "3"), "初等").otherwise("?")
    return a.groupBy("level", name.alias("stage")).agg(F.count(F.lit(1)).alias("n_points"))


def ocr_range_anchor(spark, d):
    """Points whose page lies in the page range of their handbook."""
    a = table(spark, d, "standard_handbook_alignment_v3").select("standard_point_id", F.col("handbook_source_id").alias("source"), F.expr("try_cast(primary_page AS INT)").alias("page"))
    ranges = spark.createDataFrame([("SRC-HB-ELEM", 20, 220), ("SRC-HB-INTER", 40, 380), ("SRC-HB-ADV", 1, 400)], "source string, start_page int, end_page int")
    return align.range_anchor(a, ranges, "source", "page").select("standard_point_id", "source", "page")


def monotone_pages(spark, d):
    """Earliest page not before the last one, per handbook, for the catalogue in blocks of forty points."""
    a = table(spark, d, "standard_handbook_alignment_v3").select(
        F.col("handbook_source_id").alias("source"), (F.regexp_extract("standard_point_id", r"(\d+)$", 1).cast("int") / 40).cast("int").alias("ordinal"), F.expr("try_cast(primary_page AS INT)").alias("page")
    ).where(F.col("page").isNotNull())
    return align.monotone_pages(a, "source", "ordinal", "page")


_STAGE = {"SRC-HB-ELEM": "初等", "SRC-HB-INTER": "中等", "SRC-HB-ADV": "高等"}


_LEVEL_SIGNS = "一二三四五六"


def _evidence(spark, d):
    """Points with their keywords, the first of them as full label, and their printed id; their hits in handbook texts."""
    a = table(spark, d, "standard_handbook_alignment_v3").where(F.col("matched_source_derived_keywords").isNotNull())
    stage = F.create_map(*[F.lit(x) for kv in _STAGE.items() for x in kv])
    base_ = a.select(F.col("standard_point_id").alias("point"), stage[F.col("handbook_source_id")].alias("source"), F.posexplode(F.split("matched_source_derived_keywords", r"[；;，,、|/\s]+")).alias("i", "cue"))
    n = F.least(F.length("cue"), F.lit(10))
    cues = base_.withColumn("weight", F.when(F.col("i") == 0, 25.0).otherwise(4.0 + n * 1.15)).withColumn("origin", F.when(F.col("i") == 0, "grammar_full").otherwise("grammar_component"))
    level, ordinal = F.regexp_extract("standard_point_id", "^STD-([1-6])-", 1), F.regexp_extract("standard_point_id", "([0-9]{1,3})$", 1).cast("int")
    ids = a.where(level != "").select(
        F.col("standard_point_id").alias("point"), stage[F.col("handbook_source_id")].alias("source"),
        F.concat(F.element_at(F.array(*[F.lit(x) for x in _LEVEL_SIGNS]), level.cast("int")), ordinal.cast("string")).alias("cue"), F.lit(0.0).alias("weight"), F.lit("official_id").alias("origin"),
    )
    points = align.best_cues(cues.drop("i"), ["point", "source"]).unionByName(ids)
    pages = table(spark, d, "documents").where(F.col("source").startswith("handbook") & F.col("text").isNotNull() & F.col("level_label").isNotNull())
    return points, align.evidence(points, pages, "doc_id", "text", "level_label")


def _scored(spark, d):
    """The scored pages of each point that a greedy choice can keep."""
    return page_search.best_pages(*_evidence(spark, d), ranking.PAGES, (ranking.PAGE_FLOOR, ranking.PAGE_NEAR))


def page_align_top1(spark, d):
    best = page_search.best_pages(*_evidence(spark, d))
    return align.top_page(best.select("point", "source", "page_id", "score"))


def page_align_classes(spark, d):
    c = align.classify(align.top_page(page_search.best_pages(*_evidence(spark, d))))
    return c.groupBy("method", "status", "confidence").agg(F.count(F.lit(1)).alias("n_points"))


def greedy_page_choice(spark, d):
    """Up to eight pages per point, each near the best or with a new keyword."""
    s = _scored(spark, d)
    j = s.select("point", F.col("page_id").cast("int").alias("page"), "score", F.col("cues").alias("words"))
    return ranking.greedy_pages(j, ["point"]).select("point", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def dominant_offset(spark, d):
    a = table(spark, d, "standard_handbook_alignment_v3").select("handbook_source_id", F.expr("try_cast(primary_page AS INT)").alias("p"), F.expr("try_cast(regexp_extract(candidate_pages, '[0-9]+', 0) AS INT)").alias("c"))
    return align.dominant_offset(a.where(F.col("p").isNotNull() & F.col("c").isNotNull()), ["handbook_source_id"], F.col("c") - F.col("p"), 5)


def anchor_audit(spark, d):
    """Candidate pages of each point that are primary pages of some point of the same handbook."""
    a = table(spark, d, "standard_handbook_alignment_v3")
    pages = a.select(F.col("handbook_source_id").alias("source"), F.expr("try_cast(primary_page AS INT)").alias("page"))
    anchors = a.where(F.col("candidate_pages").isNotNull()).select(F.col("standard_point_id").alias("point"), F.col("handbook_source_id").alias("source"), F.explode(F.regexp_extract_all("candidate_pages", F.lit("([0-9]+)"), F.lit(1))).alias("p"))
    return align.anchor_audit(anchors.select("point", "source", F.col("p").cast("int").alias("page")), pages)


def leak_scan(spark, d):
    """Documents that hold a candidate sentence or a test item verbatim; the first one each."""
    needles = table(spark, d, "benchmark").select("item_id", F.element_at(F.split("text", "[。.！？!?]"), 1).alias("needle"))
    return govern.verbatim_leaks(table(spark, d, "documents"), needles, "doc_id", "text", "item_id", "needle", 24)


def leak_scan_full(spark, d):
    """Documents that hold a sentence of a test item or of a candidate verbatim; the first item and the first candidate each."""
    docs, found = table(spark, d, "documents"), None
    for name, key, text in (("benchmark", "item_id", "text"), ("author_written_244", "row_id", "sentence")):
        whole = table(spark, d, name).where(F.col(text).isNotNull())
        pieces = F.concat(F.array(F.col(text)), F.split(text, r"[。！？!?\n]+|\.(?=\s|$)"))  # whole too: of short sentences no piece is long enough
        needles = whole.select(F.col(key).alias("needle_id"), F.explode(pieces).alias("n")).select("needle_id", F.regexp_replace("n", r"(?U)^\s+|\s+$", "").alias("needle")).distinct()
        hits = govern.verbatim_leaks(docs, needles, "doc_id", "text", "needle_id", "needle").select("doc_id", F.lit(name).alias("source"), "needle_id")
        found = hits if found is None else found.unionByName(hits)
    return found


def redacted_export(spark, d):
    a = table(spark, d, "author_written_244")
    return govern.redact(a, ["row_id", "item_id", "label", "gold"], ["sentence"], ["span"], {"note": "withheld"})


def forbidden_tokens(spark, d):
    patterns = {"local_path": r"/home/|/Users/", "secret": r"sk-[A-Za-z0-9]{8}", "replacement_char": "�", "level_a": r"tier.: .A.", "handwave": "标注员认为"}
    return govern.forbidden_tokens(table(spark, d, "documents"), ["text", "source", "lang"], patterns)


def tfidf_char_weights(spark, d):
    a = base.candidates(spark, d).where(F.col("sentence").isNotNull())
    w = features.tfidf_weights(a, "row_id", "sentence", 2)
    return w.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_grams"), F.max("weight").alias("top"), F.sum(F.col("weight").cast("decimal(18,6)")).cast("double").alias("total"))


def class_weights(spark, d):
    return features.class_weights(base.candidates(spark, d), "gold")


def linear_model_eval(spark, d):
    """Character n-grams with rule features in a balanced logistic regression, trained and tested by hashed split."""
    from glossmill.operators import metrics

    e = base.evaluated(spark, d).where(F.col("gold").isNotNull() & F.col("sentence").isNotNull())
    num = ["f_accept", "f_weak", "f_strong"]
    data = e.select("row_id", "item_id", "gold", "sentence", *[F.col(c).cast("double").alias(n) for c, n in zip(("accepted", "weak_reject", "strong_reject"), num)])
    data = data.withColumn("split", base.split_name(T.group_id("sentence")))
    model = features.fit_text_classifier(data.where(F.col("split") == "train"), "sentence", "gold", num)
    scored = features.predict_labels(model, data.where(F.col("split") == "test"), "sentence").select("split", "gold", "predicted")
    return metrics.union_label_metrics(scored, ["split"], base.NEGATIVE, "gold", "predicted")


def embedding_centroids(spark, d):
    """Mean vector per label as rows, without collecting any group."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


def state_mix_daily(spark, d):
    """Extension: event types per day, the batch form of the streaming monitor."""
    m = streaming.state_mix(table(spark, d, "events"), "ts", "event_type")
    return m.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "state", "n")


def io_csv_roundtrip(spark, d):
    """Written as CSV with quoted newlines and read again."""
    path = new_path(spark, "csv")
    files.write_csv(table(spark, d, "grammar_points_v0_1").select("grammar_point_id", "markers", "example_ids"), path)
    back = files.read_csv(spark, path)
    return back.select("grammar_point_id", F.md5("markers").alias("markers_md5"), F.md5("example_ids").alias("example_ids_md5"))


def io_jsonl_filter(spark, d):
    """Written as JSON lines, read again for two sources with required keys."""
    path = new_path(spark, "jsonl")
    files.write_jsonl(table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("page"), "text"), path)
    back = files.read_jsonl(spark, path, "source_id string, page long, text string", ["page"], ["handbook_a", "lecture_b"])
    return back.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


_SQ = f"regexp_replace(translate(lower(coalesce({{c}}, '')), '{PUNCT_FROM}', '{PUNCT_TO.replace(chr(39), chr(39) * 2)}'), '[\\s\\p{{{{Z}}}}\\x{{{{0085}}}}]+', '', 'g')"
_sq = lambda c: _SQ.format(c=c)
_BARE = lambda c: rf"lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_TRIM = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}\x{{0085}}]+|[\s\p{{Z}}\x{{0085}}]+$', '', 'g')"
_UID = "'{p}' || upper(substr(sha256({x}), 1, 12))"
_MARK = r"(?:[0-9]+[.．、)]|[（(][0-9]+[)）]|[①②③④⑤⑥⑦⑧⑨])"
_FIXES = """g AS (SELECT * FROM grammar_points_v0_1), fx AS (SELECT grammar_point_id AS key, 'family' AS field, family AS old, '待核' AS new, true AS verified FROM g WHERE source_status IS NULL
    UNION ALL SELECT grammar_point_id, 'canonical_label', canonical_label, '与其／不如', source_status IS NOT NULL FROM g WHERE canonical_label = '与其不如')"""
_TESTS = """b AS (SELECT grammar_point_id, substr(canonical_label, 1, 2) AS literal FROM grammar_points_v0_1),
    c AS (SELECT grammar_point_id, literal, unnest([{'i': 1, 'c': 'positive', 't': literal || '甲乙丙'}, {'i': 2, 'c': 'boundary', 't': literal || repeat('甲', 60)}, {'i': 3, 'c': 'missing_slot', 't': literal},
        {'i': 4, 'c': 'confusable', 't': '近似形式'}, {'i': 5, 'c': 'semantic_incompatible', 't': literal || '※'}, {'i': 6, 'c': 'other_construction', 't': '别的句式'}, {'i': 7, 'c': 'uncertain', 't': ''}], recursive := true) FROM b),
    r AS (SELECT grammar_point_id, literal, grammar_point_id || '-' || lpad(i::VARCHAR, 2, '0') AS test_id, c AS "case", CASE WHEN t = '' THEN 'uncertain' WHEN regexp_matches(t, '例句|语法点') THEN 'other_construction'
        WHEN contains(t, '※') THEN 'semantic_incompatible' WHEN contains(t, '近似') AND NOT contains(t, literal) THEN 'confusable' WHEN NOT contains(t, literal) THEN 'other_construction'
        WHEN length(t) < length(literal) + 2 THEN 'missing_slot' WHEN length(t) > 50 THEN 'boundary' ELSE 'positive' END AS actual FROM c)"""
_HAS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_SCORED = rf"""src AS (SELECT *, CASE handbook_source_id {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE.items())} END AS stage FROM standard_handbook_alignment_v3 WHERE matched_source_derived_keywords IS NOT NULL),
    cu0 AS (SELECT standard_point_id AS point, stage AS source, unnest(ks) AS raw, unnest(range(len(ks))) AS i FROM (SELECT *, regexp_split_to_array(matched_source_derived_keywords, '[；;，,、|/\s]+') AS ks FROM src)),
    cu AS (SELECT point, source, {_BARE('raw')} AS cue, CASE WHEN i = 0 THEN 25.0 ELSE 4.0 + least(length(raw), 10) * 1.15 END::DOUBLE AS w, CASE WHEN i = 0 THEN 'grammar_full' ELSE 'grammar_component' END AS origin FROM cu0),
    pt AS (SELECT point, source, cue, max(w) AS w, arg_max(origin, w) AS origin FROM cu WHERE cue <> '' GROUP BY 1, 2, 3
        UNION ALL SELECT standard_point_id, stage, '{_LEVEL_SIGNS}'[level::INT] || num::INT, 0.0, 'official_id' FROM (SELECT *, regexp_extract(standard_point_id, '^STD-([1-6])-', 1) AS level, regexp_extract(standard_point_id, '([0-9]{{1,3}})$', 1) AS num FROM src) WHERE level <> ''),
    pg AS (SELECT doc_id, level_label AS source, {_BARE('text')} AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_BARE('x')}), lambda x: regexp_matches(x, '{align.HEADING}')) AS heads,
        {_HAS('text', align.CONTENT)} AS content, {_HAS(_BARE('text'), align.NAVIGATION)} AS nav FROM documents WHERE source LIKE 'handbook%' AND text IS NOT NULL AND level_label IS NOT NULL),
    idp AS (SELECT DISTINCT doc_id, source, content, nav, x[1] || regexp_replace(x[2:], '^0+(.)', '\1') AS cue FROM (SELECT *, unnest(regexp_extract_all(t, '([一二三四五六][0-9]{{1,3}})(?:[^0-9]|$)', 1)) AS x FROM pg)),
    hit AS (SELECT source, doc_id AS page_id, cue, content, nav, length(cue) >= 2 AND (len(list_filter(heads, lambda x: contains(x, cue) AND length(x) <= length(cue) + 24)) > 0
            OR contains(substr(t, strpos(t, cue), length(cue) + 100), '{align.DESCRIPTION}')) AS head, false AS printed FROM pg, (SELECT DISTINCT cue FROM pt WHERE origin <> 'official_id') WHERE contains(t, cue)
        UNION ALL SELECT source, doc_id, cue, content, nav, false, true FROM idp),
    j AS (SELECT pt.*, page_id, content, nav, head, length(pt.cue) AS n, origin = 'official_id' AS is_id FROM pt JOIN hit ON hit.source = pt.source AND hit.cue = pt.cue AND hit.printed = (pt.origin = 'official_id')),
    ag AS (SELECT point, source, page_id, bool_or(content) AS content, bool_or(nav) AS nav, bool_or(is_id) AS printed, max(CASE WHEN origin = 'grammar_full' THEN n END) AS fl, max(CASE WHEN head AND NOT is_id THEN n END) AS lh,
        least(38.0::DOUBLE, sum(CASE WHEN is_id OR origin = 'grammar_full' THEN 0.0 WHEN n = 1 THEN least(w, 1.0) WHEN n = 2 THEN least(w, 5.0) ELSE w END)) AS parts, coalesce(bool_or(n >= 2) FILTER (NOT is_id), false) AS sub,
        count(*) FILTER (NOT is_id) AS n_label, count(*) FILTER (NOT is_id AND n >= 2) AS n_long FROM j GROUP BY 1, 2, 3),
    s0 AS (SELECT *, CASE WHEN content THEN 2.0 ELSE 0.0 END - CASE WHEN nav AND NOT content THEN 80.0 ELSE 0.0 END + CASE WHEN printed THEN 48.0 ELSE 0.0 END + CASE WHEN fl IS NULL THEN 0.0 ELSE 22.0 + least(fl, 18) * 0.7::DOUBLE END + parts + CASE WHEN lh IS NULL THEN 0.0 ELSE 42.0 + least(lh, 15) * 1.2::DOUBLE END AS s FROM ag),
    sc AS (SELECT *, round(greatest(0.0, CASE WHEN NOT printed AND lh IS NULL AND NOT sub THEN least(s, 3.0) ELSE s END), 3)::DOUBLE AS score FROM s0),
    tp AS (SELECT *, round(score - coalesce(lead(score) OVER w, 0.0), 3) AS margin, row_number() OVER w AS r FROM sc WINDOW w AS (PARTITION BY point ORDER BY score DESC, page_id))"""
_PREFIX = ", ".join(f"count(*) FILTER (regexp_matches(w, '{p}')) AS {k}" for k, p in (("local_path", "/home/|/Users/"), ("secret", "sk-[A-Za-z0-9]{8}"), ("replacement_char", "�"), ("level_a", "tier.: .A."), ("handwave", "标注员认为")))

QUERIES = {
    f.__name__: f
    for f in (
        group_ids_dups, dup_group_sizes, split_overlap_check, text_forms, sentence_split, page_topic_hints, corrections_patch, corrections_rejected, unit_split, taxonomy_templates, taxonomy_histogram,
        contract_tests, audit_bools, marker_alternation, level_normalised, ocr_range_anchor, monotone_pages, page_align_top1, page_align_classes, greedy_page_choice, dominant_offset, anchor_audit,
        leak_scan, leak_scan_full, redacted_export, forbidden_tokens, tfidf_char_weights, class_weights, linear_model_eval, embedding_centroids, state_mix_daily, io_csv_roundtrip, io_jsonl_filter,
    )
}

ORACLES = {
    "group_ids_dups": f"SELECT substr(sha1({_sq('sentence')}), 1, 16) AS group_id, count(*) AS n_rows FROM author_written_244 GROUP BY 1 HAVING count(*) > 1",
    "dup_group_sizes": f"SELECT size, count(*) AS n_groups FROM (SELECT sha1({_sq('text')}) AS g, count(*) AS size FROM documents GROUP BY 1) GROUP BY 1",
    "split_overlap_check": f"WITH {SQL_FACTS}, k AS (SELECT {base.SQL_GROUP_KEY} AS gkey FROM facts), s AS (SELECT gkey, {sql_split('gkey')} AS split FROM k) SELECT split, count(*) AS n_rows, count(DISTINCT gkey) AS n_groups, (SELECT count(*) FROM (SELECT gkey FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS overlap FROM s GROUP BY 1",
    "text_forms": f"""SELECT row_id, md5({_sq('sentence')}) AS squeezed, md5(coalesce({_BARE('sentence')}, '')) AS bare, md5(translate(coalesce(sentence, ''), '０１２３４５６７８９', '0123456789')) AS ascii_digits,
        {_UID.format(p='U-', x="coalesce(item_id, '') || chr(31) || coalesce(label, '')")} AS unit_id FROM author_written_244""",
    "sentence_split": f"""WITH s AS (SELECT doc_id, {_TRIM('u')} AS s FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([。！？；;])', '\\1' || chr(10), 'g'), chr(10))) AS u FROM documents WHERE text IS NOT NULL))
        SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (regexp_matches(s, '[一-龥]') AND length(s) BETWEEN 6 AND 85 AND NOT regexp_matches(s, '[A-Za-z]{{8}}') AND NOT regexp_matches(s, '^[0-9]+[.、]')) AS n_good,
        max(length(s))::INT AS longest FROM s WHERE s <> '' GROUP BY 1""",
    "page_topic_hints": "SELECT doc_id, array_to_string(list_filter(['把', '被', '连', '除了', '无论', '与其', '越来越', '随着'], lambda h: contains(text, h))[1:4], '；') AS hints FROM documents WHERE text IS NOT NULL",
    "corrections_patch": f"""WITH {_FIXES}, w AS (SELECT key, max(CASE WHEN field = 'family' THEN old END) AS fo, max(CASE WHEN field = 'family' THEN new END) AS fn, max(CASE WHEN field = 'canonical_label' THEN old END) AS co,
        max(CASE WHEN field = 'canonical_label' THEN new END) AS cn FROM fx WHERE verified GROUP BY 1)
        SELECT grammar_point_id, CASE WHEN family = fo THEN fn ELSE family END AS family, CASE WHEN canonical_label = co THEN cn ELSE canonical_label END AS canonical_label,
            (coalesce(family = fo, false)::INT + coalesce(canonical_label = co, false)::INT) AS patched FROM g LEFT JOIN w ON w.key = grammar_point_id""",
    "corrections_rejected": f"WITH {_FIXES} SELECT field, 'unverified' AS reason, count(*) AS n FROM fx WHERE NOT verified GROUP BY 1",
    "unit_split": f"""WITH p AS (SELECT doc_id, text, len(regexp_extract_all(text, '{_MARK}')) AS n, list_transform(regexp_split_to_array(text, '{_MARK}'), lambda x: {_TRIM('x')}) AS parts FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, CASE WHEN n >= 2 THEN list_transform(list_filter(parts[2:], lambda x: x <> ''), lambda x: CASE WHEN parts[1] = '' THEN x ELSE parts[1] || ' ' || x END) ELSE [text] END AS us FROM p)
        SELECT doc_id, i::INT AS unit_no, lpad(i::VARCHAR, 2, '0') AS path, md5(us[i]) AS unit_md5 FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM u)""",
    "taxonomy_templates": f"""SELECT {_UID.format(p='TPL-', x="p_type || chr(31) || p_brand || chr(31) || regime")} AS template_id, p_type, p_brand, regime, count(*) AS members, min(p_partkey) AS first_member
        FROM (SELECT *, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS regime FROM part) GROUP BY p_type, p_brand, regime""",
    "taxonomy_histogram": """WITH s AS (SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class, count(*) AS n FROM part GROUP BY 1), e(size_class, expected) AS (VALUES ('large', 1000), ('small', 1), ('none', 5))
        SELECT coalesce(s.size_class, e.size_class) AS size_class, coalesce(n, 0)::BIGINT AS n, coalesce(expected, 0)::BIGINT AS expected FROM s FULL JOIN e USING (size_class) WHERE coalesce(n, 0) <> coalesce(expected, 0)""",
    "contract_tests": f'WITH {_TESTS} SELECT test_id, "case", actual, (actual = "case")::INT AS passed FROM r',
    "audit_bools": f"""WITH {_TESTS}, t AS (SELECT grammar_point_id, count(*) AS n, count(DISTINCT "case") AS kinds, bool_and(actual = "case") AS ok, bool_or(literal = '') AS blank FROM r GROUP BY 1),
        x AS (SELECT count(*) FILTER (n <> 7) AS a, count(*) FILTER (kinds <> 7) AS b, count(*) FILTER (NOT ok) AS c, count(*) FILTER (blank) AS d, count(*) FILTER (grammar_point_id = '') AS e FROM t),
        l AS (SELECT unnest([{{'k': 'seven_tests', 'v': a}}, {{'k': 'all_cases', 'v': b}}, {{'k': 'all_passed', 'v': c}}, {{'k': 'literal_given', 'v': d}}, {{'k': 'key_given', 'v': e}}], recursive := true) FROM x)
        SELECT k AS check_name, (v = 0)::INT AS passed, v AS n_failed FROM l""",
    "marker_alternation": r"""WITH w AS (SELECT grammar_point_id, unnest(regexp_split_to_array(markers, '[；;，,、|/]')) AS w FROM grammar_points_release WHERE markers IS NOT NULL),
        c AS (SELECT DISTINCT grammar_point_id, regexp_replace(w, '^[\s"''“”「」\[\]{}]+|[\s"''“”「」\[\]{}]+$', '', 'g') AS w FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY grammar_point_id ORDER BY length(w) DESC, w) AS k FROM c WHERE w <> '')
        SELECT p.grammar_point_id, coalesce(string_agg(regexp_replace(w, '([\\^$.|?*+()\[\]{}])', '\\\1', 'g'), '|' ORDER BY k), '') AS pattern
        FROM (SELECT grammar_point_id FROM grammar_points_release WHERE markers IS NOT NULL) p LEFT JOIN r ON r.grammar_point_id = p.grammar_point_id AND k <= 16 GROUP BY 1""",
    "level_normalised": """SELECT level, CASE WHEN level = '7-9' THEN '高等' WHEN level IN ('4', '5', '6') THEN '中等' WHEN level IN ('1', '2', '3') THEN '初等' ELSE '?' END AS stage, count(*) AS n_points
        FROM (SELECT regexp_extract(standard_point_id, '^STD-([0-9](?:-9)?)-', 1) AS level FROM standard_handbook_alignment_v3) GROUP BY 1, 2""",
    "ocr_range_anchor": """SELECT standard_point_id, source, page FROM (SELECT standard_point_id, handbook_source_id AS source, try_cast(primary_page AS INT) AS page FROM standard_handbook_alignment_v3) a
        JOIN (VALUES ('SRC-HB-ELEM', 20, 220), ('SRC-HB-INTER', 40, 380), ('SRC-HB-ADV', 1, 400)) r(s, lo, hi) ON s = source AND page BETWEEN lo AND hi""",
    "page_align_top1": f"WITH {_SCORED} SELECT point, source, page_id, score, margin::DOUBLE AS margin FROM tp WHERE r = 1",
    "page_align_classes": f"""WITH {_SCORED}, c AS (SELECT CASE WHEN printed AND (lh IS NOT NULL OR n_label > 0) THEN 'printed_id_plus_lexical|aligned|high' WHEN printed AND n_long >= 2 AND score >= 30 THEN 'printed_id_plus_taxonomy|aligned|medium'
            WHEN lh IS NOT NULL AND score >= 55 THEN 'handbook_heading_lexical|aligned|high' WHEN lh IS NOT NULL THEN 'handbook_heading_lexical|aligned|medium' WHEN fl IS NOT NULL AND n_long > 0 AND score >= 30 THEN 'full_label_lexical|aligned|medium'
            WHEN fl IS NOT NULL AND n_long > 0 THEN 'full_label_lexical|low_confidence|low' WHEN n_long >= 2 AND score >= 25 THEN 'multi_cue_lexical|aligned|medium' WHEN n_long > 0 AND score >= 12 THEN 'single_cue_lexical|low_confidence|low'
            WHEN n_long > 0 AND score >= 8 THEN 'taxonomy_lexical|low_confidence|low' ELSE 'best_available_page_local_evidence|low_confidence|low' END AS k FROM tp WHERE r = 1)
        SELECT split_part(k, '|', 1) AS method, split_part(k, '|', 2) AS status, split_part(k, '|', 3) AS confidence, count(*) AS n_points FROM c GROUP BY k""",
    "dominant_offset": """WITH p AS (SELECT handbook_source_id, try_cast(nullif(regexp_extract(candidate_pages, '[0-9]+', 0), '') AS INT) - try_cast(primary_page AS INT) AS o FROM standard_handbook_alignment_v3),
        c AS (SELECT handbook_source_id, o, count(*) AS n FROM p WHERE o IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY handbook_source_id ORDER BY n DESC, o) AS k FROM c)
        SELECT handbook_source_id, o AS "offset", n FROM r WHERE k = 1""",
    "anchor_audit": """WITH a AS (SELECT DISTINCT standard_point_id AS point, handbook_source_id AS source, unnest(regexp_extract_all(candidate_pages, '[0-9]+'))::INT AS page FROM standard_handbook_alignment_v3 WHERE candidate_pages IS NOT NULL),
        p AS (SELECT DISTINCT handbook_source_id AS source, try_cast(primary_page AS INT) AS page, 1 AS hit FROM standard_handbook_alignment_v3)
        SELECT point, count(*) AS n_anchors, count(hit) AS existing, round(count(hit) / count(*)::DOUBLE, 6) AS verified_share, CASE WHEN count(hit) = count(*) THEN 'verified' WHEN count(hit) > 0 THEN 'partly_verified' ELSE 'unverified' END AS status
        FROM a LEFT JOIN p USING (source, page) GROUP BY 1""",
    "leak_scan": """WITH n AS (SELECT item_id, regexp_split_to_array(text, '[。.！？!?]')[1] AS needle FROM benchmark) SELECT doc_id, min(item_id) AS item_id FROM documents JOIN n ON length(needle) >= 24 AND contains(text, needle) GROUP BY 1""",
    "redacted_export": "SELECT row_id, item_id, label, gold, sha256(coalesce(sentence, '')) AS sentence_sha256, length(coalesce(span, ''))::INT AS span_chars, 'withheld' AS note FROM author_written_244",
    "forbidden_tokens": f"""WITH d AS (SELECT coalesce(text, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(lang, '') AS w FROM documents), c AS (SELECT {_PREFIX} FROM d)
        SELECT finding, n_rows FROM (UNPIVOT c ON local_path, secret, replacement_char, level_a, handwave INTO NAME finding VALUE n_rows)""",
    "tfidf_char_weights": f"""WITH {SQL_CANDIDATES}, d AS (SELECT row_id, sentence AS s FROM cand WHERE sentence IS NOT NULL), g AS (SELECT row_id, s[i:i+1] AS gram FROM (SELECT row_id, s, unnest(range(1, length(s))) AS i FROM d)),
        tf AS (SELECT row_id, gram, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
        r AS (SELECT row_id, gram, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (gram)), q AS (SELECT row_id, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM r)
        SELECT row_id, count(*) AS n_grams, max(round(w, 6)) AS top, sum(round(w, 6)::DECIMAL(18, 6))::DOUBLE AS total FROM q GROUP BY 1""",
    "class_weights": f"""WITH {SQL_CANDIDATES}, c AS (SELECT gold, count(*) AS n FROM cand WHERE gold IS NOT NULL GROUP BY 1) SELECT gold, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS weight FROM c""",
    "embedding_centroids": """SELECT label, (i - 1)::INT AS dim, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2""",
    "state_mix_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS state, count(*) AS n FROM events GROUP BY 1, 2",
    "io_csv_roundtrip": f"SELECT grammar_point_id, md5({_TRIM('coalesce(markers, $$$$)')}) AS markers_md5, md5({_TRIM('coalesce(example_ids, $$$$)')}) AS example_ids_md5 FROM grammar_points_v0_1",
    "io_jsonl_filter": "SELECT source AS source_id, count(*) AS n_pages, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents WHERE source IN ('handbook_a', 'lecture_b') GROUP BY 1",
}
