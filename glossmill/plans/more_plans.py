"""Further operators of the inventory: pattern matching over sentences, quality, checks of recomputed values, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossmill.functions import patterns
from glossmill.functions.text import ratio
from glossmill.operators import grouping, metrics
from glossmill.plans import base
from glossmill.plans.base import SQL_CANDIDATES, SQL_FACTS, SQL_SYSTEMS, sql_metrics
from glossmill.session import table

#: Families and the patterns that propose them, in order of precedence.
FAMILY_PATTERNS = (
    ("介词框架", "除了.{1,20}以外|随着"), ("复句", "虽然.{1,20}但是|如果.{1,20}就"), ("比较", "比.{1,12}更|越来越"), ("把字", "把.{1,12}(放|当成|都)"), ("对举", "与其.{1,20}不如|有的.{1,10}有的"), ("疑问", "为什么|是谁"),
)


def first_matching_family(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by the first family whose pattern they match; the patterns are a ladder, so nothing is joined."""
    s = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.split("text", "[。！？\n]")).alias("s")).where("s <> ''")
    ladder = F.lit(None).cast("string")
    for family, p in reversed(FAMILY_PATTERNS):
        ladder = F.when(F.col("s").rlike(p), family).otherwise(ladder)
    return s.withColumn("family", ladder).where(F.col("family").isNotNull()).groupBy("family").agg(F.count(F.lit(1)).alias("n_sentences"), F.countDistinct("doc_id").alias("n_docs"))


def candidate_quality(spark, d):
    c = base.candidates(spark, d)
    return c.select("row_id", patterns.candidate_quality(F.col("sentence"), F.col("span")).alias("quality"))


def cleaned_sentences(spark, d):
    a = table(spark, d, "author_written_244").where(F.col("sentence").isNotNull())
    return a.select("row_id", F.md5(patterns.clean_speaker(F.col("sentence"))).alias("clean_md5"), F.md5(patterns.label_head(F.col("sentence"))).alias("head_md5"))


def pattern_validity(spark, d):
    """Markers as patterns: repaired and compiled."""
    g = table(spark, d, "grammar_points_release").where(F.col("markers").isNotNull()).select("grammar_point_id", "markers")
    return patterns.pattern_validity(g, "markers").groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def recompute_compare(spark, d):
    """Metrics computed twice, by union of labels and by fixed labels, joined and compared within a tolerance."""
    s = base.systems(spark, d)
    a = metrics.union_label_metrics(s, ["system"]).select("system", F.col("accuracy").alias("reported"))
    b = s.groupBy("system").agg(F.round(ratio(F.sum("correct"), F.count(F.lit(1))), 6).alias("recomputed"))
    return a.join(b, "system").select("system", "reported", "recomputed", (F.abs(F.col("reported") - F.col("recomputed")) <= 5e-7).cast("int").alias("equal"))


def demo_selection(spark, d):
    """Two examples per construction for each point: of the point itself first, then of its family, then any."""
    c = base.candidates(spark, d).where(F.col("sentence").isNotNull() & F.col("gold").isNotNull()).select("row_id", "label", "family", "construction")
    best = c.withColumn("r", F.row_number().over(W.partitionBy("label", "construction").orderBy("row_id"))).where("r <= 2").select("row_id", "label", "family", "construction")
    fam = c.where("family <> ''").withColumn("r", F.row_number().over(W.partitionBy("family", "construction").orderBy("row_id"))).where("r <= 4").select(F.col("row_id").alias("rid"), "family", "construction")
    points = c.select("label", "family").distinct()
    own = best.select("label", "construction", "row_id", F.lit(0).alias("tier"))
    near = points.join(fam, "family").select("label", "construction", F.col("rid").alias("row_id"), F.lit(1).alias("tier"))
    other = c.withColumn("r", F.row_number().over(W.partitionBy("construction").orderBy("row_id"))).where("r <= 4").select(F.col("row_id").alias("rid"), "construction")
    anywhere = points.select("label").distinct().crossJoin(F.broadcast(other)).select("label", "construction", F.col("rid").alias("row_id"), F.lit(2).alias("tier"))
    pool = own.unionByName(near).unionByName(anywhere).groupBy("label", "construction", "row_id").agg(F.min("tier").alias("tier"))
    w = W.partitionBy("label", "construction").orderBy("tier", "row_id")
    return pool.withColumn("place", F.row_number().over(w)).where("place <= 2").select("label", "construction", "row_id", "tier", "place")


def confidence_forms(spark, d):
    """Margins as confidences, per model."""
    f = base.facts(spark, d).where(F.col("confidence").isNotNull())
    m = F.col("confidence") * 4 - 2
    return f.groupBy("model").agg(
        F.round(F.avg(patterns.margin_confidence(m)), 5).alias("binary"), F.round(F.avg(patterns.softmax_confidence(F.array(m, F.lit(0.0), -m))), 5).alias("softmax"),
        F.round(F.avg(F.aggregate(F.slice(patterns.aligned_probabilities(F.create_map(F.lit("a"), F.col("confidence")), ["a", "b"]), 1, 1), F.lit(0.0), lambda x, y: x + y)), 5).alias("aligned"),
    )


def cost_sums(spark, d):
    """Token sums and latency per model: totals, mean, median."""
    e = table(spark, d, "evidence_predictions_release")
    return e.groupBy(F.col("response_model").alias("model")).agg(
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")],
        F.round(F.avg("latency_seconds"), 5).alias("mean_latency"), F.round(F.median("latency_seconds"), 5).alias("median_latency"),
    )


def threshold_best(spark, d):
    """Best confidence threshold per model by macro-F1, then accuracy, then smallest."""
    f = base.facts(spark, d).where(F.col("gold").isNotNull() & F.col("confidence").isNotNull())
    r = f.groupBy("model", F.round("confidence", 2).alias("c"), (F.col("gold") == "支持").alias("y"), (F.col("prediction") == "支持").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    t = r.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.8, 0.9)])))
    yes, n = F.col("p") & (F.col("c") >= F.col("threshold")), F.col("n")
    s = lambda c: F.sum(F.when(c, n).otherwise(0))
    g = t.groupBy("model", "threshold").agg(s(yes & F.col("y")).alias("tp"), s(yes & ~F.col("y")).alias("fp"), s(~yes & F.col("y")).alias("fn"), s(~yes & ~F.col("y")).alias("tn"))
    f1 = (ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")) + ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn"))) / 2
    acc = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    g = g.select("model", "threshold", F.round(f1, 6).alias("macro_f1"), F.round(acc, 6).alias("accuracy"))
    best = g.groupBy("model").agg(F.min(F.struct((-F.col("macro_f1")).alias("a"), (-F.col("accuracy")).alias("b"), "threshold")).alias("m"))
    return best.select("model", F.col("m.threshold").alias("threshold"), (-F.col("m.a")).alias("macro_f1"), (-F.col("m.b")).alias("accuracy"))


def seed_choice(spark, d):
    """Best seed label for each catalogue keyword set: points of the release scored by shared markers, ties by name."""
    g = table(spark, d, "grammar_points_release").where(F.col("markers").isNotNull())
    seeds = g.select(F.col("candidate_label").alias("seed"), F.explode(F.split("markers", r"[；;，,、|/\s]+")).alias("cue")).where(F.length("cue") >= 2).distinct()
    a = table(spark, d, "standard_handbook_alignment_v3").where(F.col("matched_source_derived_keywords").isNotNull())
    points = a.select("standard_point_id", F.explode(F.split("matched_source_derived_keywords", r"[；;，,、|/\s]+")).alias("cue")).where(F.length("cue") >= 2).distinct()
    score = points.join(seeds, "cue").groupBy("standard_point_id", "seed").agg(F.sum(F.length("cue")).alias("score"))
    best = score.groupBy("standard_point_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "seed")).alias("m"))
    return best.select("standard_point_id", F.col("m.seed").alias("seed"), (-F.col("m.n")).alias("score"))


def status_rewrite(spark, d):
    """Alignment status by polarity and verification."""
    a = table(spark, d, "standard_handbook_alignment_v3")
    status = F.when((F.col("alignment_status") == "aligned") & (F.col("confidence") == "high"), "confirmed").when(F.col("alignment_status") == "aligned", "provisional").otherwise("open")
    return a.groupBy("alignment_method", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("alignment_score"), 4).alias("mean_score"))


def printed_id_pages(spark, d):
    """Documents that print a page sign or a numbered point, digits bounded on both sides."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    page, point = F.regexp_extract("text", r"第 ([0-9]{1,3}) 页", 1), F.regexp_count("text", F.lit(r"第[一二三四五六七八九]组"))
    return docs.groupBy("source").agg(F.count_if(page != "").alias("n_pages"), F.max(F.expr("try_cast(regexp_extract(text, '第 ([0-9]{1,3}) 页', 1) AS INT)")).alias("last_page"), F.sum(point).cast("long").alias("n_points"))


def heading_lines(spark, d):
    """Lines that are short and without terminator, per source."""
    lines = table(spark, d, "documents").where(F.col("text").isNotNull()).select("source", F.explode(F.split("text", "\n")).alias("line"))
    head = F.length("line").between(1, 16) & ~F.col("line").rlike("[。！？.!?”]$")
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(head).alias("n_headings"))


def utf8_findings(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count_if(~patterns.is_clean_utf8(F.col("text"))).alias("n_broken"))


def stratified_split(spark, d):
    """Rows and groups per split and gold label, split by stratified groups."""
    f = base.facts(spark, d).where(F.col("gold").isNotNull()).withColumn("gkey", base.group_key()).select("gkey", "gold")
    parts = grouping.three_way_split(f, "gkey", "gold")
    return grouping.split_manifest(f.join(parts, "gkey"), "split", "gkey", "gold")


_SQL_PIECES = r"regexp_split_to_array({c}, '[；;，,、|/\s]+')"
_LAD = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{f}'" for f, p in FAMILY_PATTERNS) + " END"

QUERIES = {
    f.__name__: f
    for f in (
        first_matching_family, candidate_quality, cleaned_sentences, pattern_validity, recompute_compare, demo_selection, confidence_forms, cost_sums, threshold_best, seed_choice, status_rewrite,
        printed_id_pages, heading_lines, utf8_findings, stratified_split,
    )
}

_words = base._sql_list
_COUNTED = """, again AS (SELECT system, round(sum(CASE WHEN gold = prediction THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS recomputed FROM systems GROUP BY 1)
    SELECT system, accuracy AS reported, recomputed, (abs(accuracy - recomputed) <= 5e-7)::INT AS equal FROM metrics JOIN again USING (system)"""

ORACLES = {
    "first_matching_family": rf"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[。！？\n]')) AS s FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, {_LAD} AS family FROM s WHERE s <> '')
        SELECT family, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_docs FROM f WHERE family IS NOT NULL GROUP BY 1""",
    "candidate_quality": f"""WITH {SQL_CANDIDATES}, c AS (SELECT row_id, coalesce(sentence, '') AS s, coalesce(span, '') AS p FROM cand)
        SELECT row_id, (CASE WHEN length(s) BETWEEN 8 AND 42 THEN 5 WHEN length(s) <= 65 THEN 2 ELSE 0 END
            - CASE WHEN len(list_filter({_words(patterns.EXPLAINING)}, lambda w: contains(s, w))) > 0 THEN 5 ELSE 0 END - CASE WHEN len(list_filter({_words(patterns.FORMULA)}, lambda w: contains(s, w))) > 0 THEN 2 ELSE 0 END
            + CASE WHEN length(p) BETWEEN 1 AND 16 THEN 1 ELSE 0 END + CASE WHEN len(list_filter({_words(patterns.EVERYDAY)}, lambda w: contains(s, w))) > 0 THEN 2 ELSE 0 END)::INT AS quality FROM c""",
    "cleaned_sentences": r"""WITH a AS (SELECT row_id, sentence AS s, regexp_replace(sentence, '^[\s\p{Z}\x{0085}·*•\-—#>（(【“]+', '') AS t FROM author_written_244 WHERE sentence IS NOT NULL),
        b AS (SELECT row_id, s, regexp_replace(t, '^[\p{L}]{1,4}[：:](.)', '\1') AS t FROM a)
        SELECT row_id, md5(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '^[\s\p{Z}\x{0085}]+|[\s\p{Z}\x{0085}]+$', '', 'g')) AS clean_md5,
            md5(CASE WHEN contains(s, '：') AND length(string_split(s, '：')[1]) BETWEEN 1 AND 32 THEN string_split(s, '：')[1] ELSE s END) AS head_md5 FROM b""",
    "recompute_compare": f"WITH {SQL_SYSTEMS}, {sql_metrics('systems', ['system'])} {_COUNTED}",
    "demo_selection": f"""WITH {SQL_CANDIDATES}, c AS (SELECT row_id, label, family, construction FROM cand WHERE sentence IS NOT NULL AND gold IS NOT NULL),
        o AS (SELECT label, construction, row_id, 0 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY label, construction ORDER BY row_id) AS r FROM c) WHERE r <= 2),
        f AS (SELECT family, construction, row_id FROM (SELECT *, row_number() OVER (PARTITION BY family, construction ORDER BY row_id) AS r FROM c WHERE family <> '') WHERE r <= 4),
        a AS (SELECT construction, row_id FROM (SELECT *, row_number() OVER (PARTITION BY construction ORDER BY row_id) AS r FROM c) WHERE r <= 4),
        u AS (SELECT label, construction, row_id, min(tier) AS tier FROM (SELECT * FROM o UNION ALL SELECT p.label, f.construction, f.row_id, 1 FROM (SELECT DISTINCT label, family FROM c) p JOIN f USING (family)
            UNION ALL SELECT p.label, a.construction, a.row_id, 2 FROM (SELECT DISTINCT label FROM c) p, a) GROUP BY 1, 2, 3)
        SELECT label, construction, row_id, tier::INT AS tier, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY label, construction ORDER BY tier, row_id) AS place FROM u) WHERE place <= 2""",
    "confidence_forms": f"""WITH {SQL_FACTS}, m AS (SELECT model, confidence AS c, confidence * 4 - 2 AS m FROM facts WHERE confidence IS NOT NULL)
        SELECT model, round(avg(1 / (1 + exp(-abs(m)))), 5) AS binary, round(avg(1 / (exp(m - greatest(m, 0, -m)) + exp(0 - greatest(m, 0, -m)) + exp(-m - greatest(m, 0, -m)))), 5) AS softmax,
            round(avg(greatest(c, 1e-9) / (greatest(c, 1e-9) + 1e-9)), 5) AS aligned FROM m GROUP BY 1""",
    "cost_sums": """SELECT response_model AS model, sum(input_tokens)::BIGINT AS input_tokens, sum(cached_input_tokens)::BIGINT AS cached_input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens,
        round(avg(latency_seconds), 5) AS mean_latency, round(median(latency_seconds), 5) AS median_latency FROM evidence_predictions_release GROUP BY 1""",
    "threshold_best": f"""WITH {SQL_FACTS}, r AS (SELECT model, round(confidence, 2) AS c, gold = '支持' AS y, prediction = '支持' AS p, unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold FROM facts WHERE gold IS NOT NULL AND confidence IS NOT NULL),
        g AS (SELECT model, threshold, count(*) FILTER (p AND c >= threshold AND y)::DOUBLE AS tp, count(*) FILTER (p AND c >= threshold AND NOT y)::DOUBLE AS fp, count(*) FILTER (NOT (p AND c >= threshold) AND y)::DOUBLE AS fn,
            count(*) FILTER (NOT (p AND c >= threshold) AND NOT y)::DOUBLE AS tn FROM r GROUP BY 1, 2),
        s AS (SELECT model, threshold, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM g),
        k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, accuracy DESC, threshold) AS k FROM s) SELECT model, threshold, macro_f1, accuracy FROM k WHERE k = 1""",
    "seed_choice": f"""WITH s AS (SELECT DISTINCT candidate_label AS seed, cue FROM (SELECT candidate_label, unnest({_SQL_PIECES.format(c='markers')}) AS cue FROM grammar_points_release WHERE markers IS NOT NULL) WHERE length(cue) >= 2),
        p AS (SELECT DISTINCT standard_point_id, cue FROM (SELECT standard_point_id, unnest({_SQL_PIECES.format(c='matched_source_derived_keywords')}) AS cue FROM standard_handbook_alignment_v3) WHERE length(cue) >= 2),
        c AS (SELECT standard_point_id, seed, sum(length(cue))::BIGINT AS score FROM p JOIN s USING (cue) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY standard_point_id ORDER BY score DESC, seed) AS k FROM c)
        SELECT standard_point_id, seed, score FROM k WHERE k = 1""",
    "status_rewrite": """SELECT alignment_method, CASE WHEN alignment_status = 'aligned' AND confidence = 'high' THEN 'confirmed' WHEN alignment_status = 'aligned' THEN 'provisional' ELSE 'open' END AS status, count(*) AS n,
        round(avg(alignment_score), 4) AS mean_score FROM standard_handbook_alignment_v3 GROUP BY 1, 2""",
    "printed_id_pages": """SELECT source, count(*) FILTER (regexp_matches(text, '第 [0-9]{1,3} 页')) AS n_pages, max(try_cast(nullif(regexp_extract(text, '第 ([0-9]{1,3}) 页', 1), '') AS INT)) AS last_page,
        sum(len(regexp_extract_all(text, '第[一二三四五六七八九]组')))::BIGINT AS n_points FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "heading_lines": """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
        SELECT source, count(*) AS n_lines, count(*) FILTER (length(line) BETWEEN 1 AND 16 AND NOT regexp_matches(line, '[。！？.!?”]$')) AS n_headings FROM l GROUP BY 1""",
    "utf8_findings": "SELECT source, count(*) FILTER (contains(text, '�')) AS n_broken FROM documents GROUP BY 1",
}
