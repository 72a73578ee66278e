"""Queries of the general data problems: orphan references and packed fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import orphans, packed
from glossmill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orphans.orphan_references(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes"))
    return rows.select("edge_id", "side")


def p2_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orphans.orphan_references(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes"))
    return orphans.orphan_counts(rows)


PACKED = (
    ("grammar_points_release", "grammar_point_id", ["markers"]),
    ("grammar_points_v0_1", "grammar_point_id", ["example_ids"]),
    ("standard_handbook_alignment_v3", "standard_point_id", ["candidate_pages", "matched_source_derived_keywords"]),
)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [packed.packed_fields(table(spark, sf_dir, t), t, key, fields) for t, key, fields in PACKED]
    fields = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return packed.split_packed(fields).select(
        "table_name", "field_name", "row_key", F.col("pos").cast("int").alias("pos"), "item"
    )


_ORPHANS = """
    SELECT edge_id, side, "end" AS key, relation, loaded_at FROM (
        SELECT edge_id, 'source' AS side, source AS "end", relation, loaded_at FROM edges
        UNION ALL SELECT edge_id, 'target', target, relation, loaded_at FROM edges) r
    WHERE "end" IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM nodes n WHERE n.id = r."end" AND n.loaded_at <= r.loaded_at
          AND (n.deleted_at IS NULL OR n.deleted_at > r.loaded_at))
"""

def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _splitter() -> str:
    """The stated rule as one pattern: a quoted span before a separator or the end, or a run without separators."""
    sep = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}" + packed.SEPARATORS
    spans = [rf"{a}[^{b}]*(?:{b}{b}[^{b}]*)*{b}" if a == b else rf"{a}[^{a}{b}]*(?:{b}{b}[^{a}{b}]*)*{b}" for a, b in packed.QUOTES]
    return rf"({'|'.join(spans)}|[^{sep}]+)(?:[{sep}]+|$)|[{sep}]+"


def _packed_sql(name: str, key: str, field: str) -> str:
    body = f"trim({field}, {_sql(packed.BLANKS)})"
    for a, b in packed.BRACKETS:
        body = f"regexp_replace({body}, {_sql(rf'(?s)^{re.escape(a)}([^{re.escape(a + b)}]*){re.escape(b)}$')}, '\\1')"
    value = "t"
    for a, b in packed.QUOTES:
        value = f"CASE WHEN len(t) > 1 AND t[1] = {_sql(a)} AND t[-1] = {_sql(b)} THEN trim(replace(t[2:-2], {_sql(b + b)}, {_sql(b)}), {_sql(packed.BLANKS)}) ELSE {value} END"
    return f"""SELECT {_sql(name)} AS table_name, {_sql(field)} AS field_name, row_key, unnest(generate_series(1, len(v)))::INTEGER AS pos, unnest(v) AS item FROM (
        SELECT {key} AS row_key, list_filter(list_transform(list_filter(regexp_extract_all({body}, {_sql(_splitter())}, 1), lambda t: t <> ''), lambda t: {value}), lambda t: t <> '') AS v
        FROM {name} WHERE {field} IS NOT NULL)"""


QUERIES = {"p2_found": p2_found, "p2_orphan_report": p2_orphan_report, "p3_found": p3_found}

ORACLES = {
    "p3_found": " UNION ALL ".join(_packed_sql(t, key, f) for t, key, fields in PACKED for f in fields),
    "p2_found": f"SELECT edge_id, side FROM ({_ORPHANS}) o",
    "p2_orphan_report": f"""
        SELECT side, relation, strftime(loaded_at, '%Y-%m') AS month, count(*)::BIGINT AS n_orphans,
               count(DISTINCT key)::BIGINT AS n_keys
        FROM ({_ORPHANS}) o GROUP BY 1, 2, 3
    """,
}
