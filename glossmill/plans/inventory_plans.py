"""Catalogue parsing over whole tables: statuses, quotes, levels, anchors, markers, canonical JSON, source bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import parsing
from glossmill.plans import base
from glossmill.plans.base import SQL_CANDIDATES
from glossmill.session import table

READY = "AUTH_READY"
_HANDBOOKS = {"SRC-HB-ELEM": "初等", "SRC-HB-INTER": "中等", "SRC-HB-ADV": "高等"}
_JSON_COLUMNS = ["grammar_point_id", "candidate_label", "canonical_label", "grammar_family", "sample_count", "source_status"]


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Points per family and status, a missing status counting as ready."""
    status = F.coalesce(F.col("source_status"), F.lit(READY))
    return table(spark, d, "grammar_points_v0_1").groupBy("family", status.alias("status")).agg(F.count(F.lit(1)).alias("n_points"))


def marks_outside_quotes(spark, d):
    """Per sentence: where 把 stands outside quotes, and how often it stands within."""
    a = table(spark, d, "author_written_244").where(F.col("sentence").isNotNull())
    free = parsing.positions_outside_quotes(F.col("sentence"), "把")
    total = F.length("sentence") - F.length(F.replace("sentence", F.lit("把"), F.lit("")))
    return a.select("row_id", F.array_join(free.cast("array<string>"), ",").alias("positions"), (total - F.size(free)).alias("quoted"))


def level_forms(spark, d):
    """Levels of catalogue ids in several spellings, brought to one."""
    a = table(spark, d, "standard_handbook_alignment_v3").select(F.regexp_extract("standard_point_id", r"^STD-([0-9](?:-9)?)-", 1).alias("level")).where("level <> ''")
    han = F.translate("level", "123456", "一二三四五六")
    raw = F.explode(F.array(F.concat(F.lit("Level "), F.col("level")), F.concat(han, F.lit("级")), F.regexp_replace("level", "-", "—"), F.regexp_replace("level", "7-9", "高等")))
    return a.select(raw.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", parsing.normalise_level(F.col("raw")).alias("level"), "n")


def parsed_anchors(spark, d):
    """Book and page of every page anchor of a point, written out and parsed again."""
    book = F.create_map(*[F.lit(x) for kv in _HANDBOOKS.items() for x in kv])[F.col("handbook_source_id")]
    a = table(spark, d, "standard_handbook_alignment_v3").where(F.col("candidate_pages").isNotNull())
    pages = F.regexp_extract_all("candidate_pages", F.lit("([0-9]+)"), F.lit(1))
    written = F.array_join(F.transform(pages, lambda p: F.concat(book, F.lit(" p."), p)), "；")
    return a.select("standard_point_id", F.posexplode(parsing.page_anchors(written)).alias("i", "a")).select("standard_point_id", (F.col("i") + 1).alias("place"), "a.book", "a.page")


def point_markers(spark, d):
    """Literal markers of every point."""
    g = table(spark, d, "grammar_points_release")
    return g.select("grammar_point_id", F.array_join(parsing.literal_markers(F.col("markers")), "|").alias("literals"))


def sentences_with_all_signs(spark, d):
    """Candidates whose sentence holds every sign of the span at least as often as the span does, and what follows the span."""
    c = base.candidates(spark, d).where(F.col("sentence").isNotNull() & F.col("span").isNotNull())
    signs = F.filter(F.split("span", ""), lambda x: x != "")
    return c.select("row_id", parsing.holds_all(F.col("sentence"), signs).alias("holds"), F.md5(parsing.window_after(F.col("sentence"), F.col("span"), 10)).alias("window"))


def point_json(spark, d):
    """Canonical JSON of every point and its hash."""
    g = table(spark, d, "grammar_points_release")
    return g.select("grammar_point_id", parsing.canonical_json(g, _JSON_COLUMNS).alias("json"), parsing.json_sha256(g, _JSON_COLUMNS).alias("sha256"))


def source_bounds(spark, d):
    """Per handbook: first page with high confidence (body), last page, and first low-confidence page of the last quarter."""
    a = table(spark, d, "standard_handbook_alignment_v3").select("handbook_source_id", "confidence", F.expr("try_cast(primary_page AS INT)").alias("page")).where(F.col("page").isNotNull())
    last = a.groupBy("handbook_source_id").agg(F.max("page").alias("last_page"))
    tail = (F.col("page") >= F.floor(F.col("last_page") * 0.75)) & (F.col("confidence") == "low")
    return a.join(F.broadcast(last), "handbook_source_id").groupBy("handbook_source_id", "last_page").agg(
        F.min(F.when(F.col("confidence") == "high", F.col("page"))).alias("body_start"), F.coalesce(F.min(F.when(tail, F.col("page"))), F.max("page") + 1).alias("index_start")
    )


QUERIES = {f.__name__: f for f in (status_counts, marks_outside_quotes, level_forms, parsed_anchors, point_markers, sentences_with_all_signs, point_json, source_bounds)}

_LAST = lambda q: f"(CASE WHEN contains(p, '{q}') THEN length(p) - strpos(reverse(p), '{q}') + 1 ELSE 0 END)"
_PIECE = lambda c: f"CASE WHEN {c} IS NOT NULL AND {c}::VARCHAR <> '' THEN '\"{c}\":' || to_json({c})::VARCHAR END"
_JSON = "'{' || array_to_string(list_filter([" + ", ".join(_PIECE(c) for c in sorted(_JSON_COLUMNS)) + "], lambda x: x IS NOT NULL), ',') || '}'"
_BOOK = "CASE handbook_source_id WHEN 'SRC-HB-ELEM' THEN 'elementary' WHEN 'SRC-HB-INTER' THEN 'intermediate' WHEN 'SRC-HB-ADV' THEN 'advanced' END"

ORACLES = {
    "status_counts": f"SELECT family, coalesce(source_status, '{READY}') AS status, count(*) AS n_points FROM grammar_points_v0_1 GROUP BY 1, 2",
    "marks_outside_quotes": f"""WITH s AS (SELECT row_id, sentence, unnest(range(1, length(sentence) + 1)) AS i FROM author_written_244 WHERE sentence <> ''),
        b AS (SELECT row_id, i, substr(sentence, 1, i - 1) AS p FROM s WHERE substr(sentence, i, 1) = '把'),
        f AS (SELECT row_id, i, {_LAST('“')} <= {_LAST('”')} AND {_LAST('‘')} <= {_LAST('’')} AS free FROM b),
        g AS (SELECT row_id, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (free) AS positions, count(*) FILTER (NOT free) AS quoted FROM f GROUP BY 1)
        SELECT a.row_id, coalesce(positions, '') AS positions, coalesce(quoted, 0)::INT AS quoted FROM author_written_244 a LEFT JOIN g USING (row_id) WHERE sentence IS NOT NULL""",
    "level_forms": """WITH l AS (SELECT regexp_extract(standard_point_id, '^STD-([0-9](?:-9)?)-', 1) AS level FROM standard_handbook_alignment_v3),
        r AS (SELECT level, unnest(['Level ' || level, translate(level, '123456', '一二三四五六') || '级', replace(level, '-', '—'), replace(level, '7-9', '高等')]) AS raw FROM l WHERE level <> '')
        SELECT raw, level, count(*) AS n FROM r GROUP BY 1, 2""",
    "parsed_anchors": f"""SELECT standard_point_id, unnest(range(1, len(ps) + 1))::INT AS place, {_BOOK} AS book, unnest(ps)::INT AS page
        FROM (SELECT *, regexp_extract_all(candidate_pages, '[0-9]+') AS ps FROM standard_handbook_alignment_v3 WHERE candidate_pages IS NOT NULL)""",
    "point_markers": rf"""SELECT grammar_point_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(markers, ''), '[；;]'), lambda m: regexp_replace(m, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')),
        lambda m: m <> '' AND NOT list_contains({base._sql_list(parsing.CONCEPTS)}, m) AND NOT contains(m, '...') AND NOT contains(m, '等')), '|') AS literals FROM grammar_points_release""",
    "sentences_with_all_signs": f"""WITH {SQL_CANDIDATES}, c AS (SELECT row_id, sentence, span, string_split(span, '') AS signs FROM cand WHERE sentence IS NOT NULL AND span IS NOT NULL)
        SELECT row_id, len(list_filter(signs, lambda x: x <> '' AND length(sentence) - length(replace(sentence, x, '')) < length(span) - length(replace(span, x, '')))) = 0 AS holds,
            md5(CASE WHEN span <> '' AND contains(sentence, span) THEN substr(sentence, strpos(sentence, span), length(span) + 10) ELSE '' END) AS "window" FROM c""",
    "point_json": f"SELECT grammar_point_id, {_JSON} AS json, sha256({_JSON}) AS sha256 FROM grammar_points_release",
    "source_bounds": """WITH a AS (SELECT handbook_source_id, confidence, try_cast(primary_page AS INT) AS page, max(try_cast(primary_page AS INT)) OVER (PARTITION BY handbook_source_id) AS last_page FROM standard_handbook_alignment_v3)
        SELECT handbook_source_id, last_page, min(page) FILTER (confidence = 'high') AS body_start, coalesce(min(page) FILTER (confidence = 'low' AND page >= floor(last_page * 0.75)), last_page + 1)::INT AS index_start
        FROM a WHERE page IS NOT NULL GROUP BY 1, 2""",
}
