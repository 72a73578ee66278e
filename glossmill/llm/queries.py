"""Queries of the text problems and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import duplicates, leakage, lookalike, packing, splits, truncation
from glossmill.session import table

EVIDENCE, AUTHOR = "evidence_predictions_release", "author_written_244"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.linked_groups(table(spark, sf_dir, EVIDENCE))


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.record_blocks(table(spark, sf_dir, EVIDENCE))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, EVIDENCE))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, author = table(spark, sf_dir, EVIDENCE), table(spark, sf_dir, AUTHOR)
    loose, exact = duplicates.compared_columns(evidence, ("row_id", "loaded_at"))
    a = duplicates.fingerprints(evidence, EVIDENCE, loose=loose, exact=exact)
    b = duplicates.fingerprints(
        author, AUTHOR, exact=["label", "construction", "span", "gold", "benchmark_label"], labelled=["sentence"]
    )
    return a.unionByName(b)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.surplus_copies(_prints(spark, sf_dir))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.collapse(_prints(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = table(spark, sf_dir, AUTHOR)
    pairs = lookalike.lookalike_pairs(author, "sentence").select(F.lit("sentence").alias("field"), "row_a", "row_b")
    spans = lookalike.hidden_spans(author)
    return pairs.unionByName(spans.select(F.lit("span").alias("field"), F.col("row").alias("row_a"), F.col("row").alias("row_b")))


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent(table(spark, sf_dir, AUTHOR), ["sentence", "span"])


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_containers(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_documents(table(spark, sf_dir, "documents"))


def p8_source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_share(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_blocks": p1_blocks,
    "p1_splits": p1_splits,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_consistent": p5_consistent,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p7_removal_spans": p7_removal_spans,
    "p8_found": p8_found,
    "p8_source_share": p8_source_share,
}

def _bare(c: str) -> str:
    return rf"lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


_SQL_LINKS = f"""k AS (SELECT row_id, {_bare('"编号"')} AS num, {_bare('sentence_group')} AS grp FROM {EVIDENCE}),
    p AS (SELECT DISTINCT num, grp FROM k WHERE num <> '' AND regexp_full_match(grp, '[0-9a-f]{{16}}')),
    h AS (SELECT num, min(grp) AS a FROM p GROUP BY 1 HAVING count(*) > 1),
    e AS (SELECT DISTINCT a, grp AS b FROM p JOIN h USING (num) WHERE grp > a),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT r.v, b.b FROM reach r JOIN both_ways b ON b.a = r.w),
    top AS (SELECT v, min(w) AS block_group FROM reach GROUP BY 1)"""

_FROM, _TO = (x.replace("'", "''") for x in lookalike.mapping())
_MAPPED = lambda c: f"nfc_normalize(translate({c}, '{_FROM}', '{_TO}'))"
_PLAIN = lambda c: f"translate({c}, ' ' || chr(9) || chr(10) || chr(13), '')"

_SAME = """row_number() OVER (PARTITION BY {keys} ORDER BY row_id) AS k, min(row_id) OVER (PARTITION BY {keys}) AS kept"""
_EV_TEXT = ("task", "job_id", '"编号"', "sentence_group", "gold", "prediction", "response_model", "response_status")
_EV_OTHER = (
    "repeat", "confidence", "has_evidence_cues", "all_cues_grounded", "valid_output", "latency_seconds", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "completed_at",
)
_PIECES = rf"""list_filter(regexp_split_to_array(regexp_replace(sentence, '[\s\p{{Z}}\p{{Cf}}\x{{0085}}\x{{FE00}}-\x{{FE0F}}]+', '', 'g'), '[；;，,、|/。！!？?]+'),
    lambda p: regexp_replace(p, '[^\p{{L}}\p{{N}}]+', '', 'g') <> '')"""
_LABEL = r"'^[^\p{L}\p{N}]*[\p{L}\p{N}]{1,12}[：:].*$'"
_SQL_SENTENCE = rf"""CASE WHEN len(list_filter({_PIECES}, lambda p: regexp_matches(p, {_LABEL}))) >= 2 THEN
    (WITH j AS (SELECT string_split(array_to_string(list_transform({_PIECES}, lambda p: CASE WHEN regexp_matches(p, {_LABEL}) THEN chr(1) ELSE '' END || {_bare('p')}), ''), chr(1)) AS x)
     SELECT x[1] || chr(1) || array_to_string(list_sort(x[2:]), chr(1)) FROM j) ELSE {_bare('sentence')} END"""

_SQL_SPLITS = f"""{_SQL_LINKS}, n1 AS (SELECT num, min(grp) AS ng FROM p GROUP BY 1)
    SELECT row_id, coalesce('g:' || coalesce(top.block_group, g), 'n:' || nullif(num, ''), 'r:' || row_id) AS block FROM (
        SELECT k.row_id, k.num, coalesce(CASE WHEN regexp_full_match(k.grp, '[0-9a-f]{{16}}') THEN k.grp END, n1.ng) AS g FROM k LEFT JOIN n1 ON n1.num = k.num) q LEFT JOIN top ON top.v = q.g"""

_ROOM = {"train": "0.8::DOUBLE * t - tr", "validation": "0.1::DOUBLE * t - va", "test": "0.1::DOUBLE * t - te"}
_HOME = f"""CASE WHEN {_ROOM["train"]} >= {_ROOM["validation"]} AND {_ROOM["train"]} >= {_ROOM["test"]} THEN 'train'
    WHEN {_ROOM["validation"]} >= {_ROOM["test"]} THEN 'validation' ELSE 'test' END"""
#: Heavy blocks one after another where most room is left, the others cut by cumulative weight in the order of their hash.
_SQL_ASSIGNED = f"""{_SQL_SPLITS.replace("SELECT row_id, coalesce('g:'", ", placed AS (SELECT row_id, coalesce('g:'")}),
    wb AS (SELECT block, count(*) AS w, md5('42:' || block) AS h FROM placed GROUP BY 1),
    tot AS (SELECT sum(w)::BIGINT AS t FROM wb),
    big AS (SELECT block, w, t, row_number() OVER (ORDER BY w DESC, h, block) AS k FROM wb, tot WHERE w * 20 > t * 0.1::DOUBLE),
    fill AS (SELECT 0::BIGINT AS k, 0::BIGINT AS tr, 0::BIGINT AS va, 0::BIGINT AS te, t, NULL::VARCHAR AS block, NULL::VARCHAR AS split FROM tot
        UNION ALL SELECT k, tr + CASE WHEN home = 'train' THEN w ELSE 0 END, va + CASE WHEN home = 'validation' THEN w ELSE 0 END,
            te + CASE WHEN home = 'test' THEN w ELSE 0 END, t, block, home
        FROM (SELECT b.k, tr, va, te, f.t, b.block, b.w, {_HOME.replace("* t -", "* f.t -")} AS home FROM fill f JOIN big b ON b.k = f.k + 1)),
    fin AS (SELECT *, t - tr - va - te AS rest, greatest(0.0::DOUBLE, {_ROOM["train"]}) AS r1, greatest(0.0::DOUBLE, {_ROOM["validation"]}) AS r2, greatest(0.0::DOUBLE, {_ROOM["test"]}) AS r3
        FROM fill ORDER BY k DESC LIMIT 1),
    scaled AS (SELECT *, rest / greatest(r1 + r2 + r3, 1.0::DOUBLE) AS s FROM fin),
    small AS (SELECT block, sum(w) OVER (ORDER BY h, block ROWS UNBOUNDED PRECEDING) - w / 2.0::DOUBLE AS place FROM wb WHERE block NOT IN (SELECT block FROM big)),
    homes AS (SELECT block, split FROM fill WHERE block IS NOT NULL
        UNION ALL SELECT small.block, CASE WHEN place < rest - r3 * s - r2 * s THEN 'train' WHEN place < rest - r3 * s THEN 'validation' ELSE 'test' END FROM small, scaled)
    SELECT row_id, block, split FROM placed JOIN homes USING (block)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_SQL_LINKS} SELECT block_group, v AS sentence_group FROM top WHERE v > block_group",
    "p1_blocks": f"WITH RECURSIVE {_SQL_SPLITS}",
    "p1_splits": f"WITH RECURSIVE {_SQL_ASSIGNED}",
    "p4_found": f"""SELECT '{EVIDENCE}' AS table_name, kept AS kept_row, row_id AS copy_row FROM (SELECT row_id, {_SAME.format(keys=", ".join([_bare(c) for c in _EV_TEXT] + list(_EV_OTHER)))} FROM {EVIDENCE}) WHERE k > 1
        UNION ALL SELECT '{AUTHOR}', kept, row_id FROM (SELECT row_id, {_SAME.format(keys="label, construction, span, gold, benchmark_label, canon")} FROM (SELECT *, {_SQL_SENTENCE} AS canon FROM {AUTHOR})) WHERE k > 1""",
    "p4_records": f"""SELECT '{EVIDENCE}' AS table_name, min(row_id) AS kept_row, count(*) AS n_copies FROM {EVIDENCE} GROUP BY {", ".join([_bare(c) for c in _EV_TEXT] + list(_EV_OTHER))}
        UNION ALL SELECT '{AUTHOR}', min(row_id), count(*) FROM (SELECT *, {_SQL_SENTENCE} AS canon FROM {AUTHOR}) GROUP BY label, construction, span, gold, benchmark_label, canon""",
    "p5_consistent": f"SELECT row_id, {_MAPPED('sentence')} AS sentence, {_MAPPED('span')} AS span FROM {AUTHOR}",
    "p5_found": f"""WITH s AS (SELECT row_id, {_PLAIN('sentence')} AS raw, {_PLAIN(_MAPPED('sentence'))} AS look FROM {AUTHOR} WHERE sentence IS NOT NULL)
        SELECT 'sentence' AS field, a.row_id AS row_a, b.row_id AS row_b FROM s a JOIN s b ON a.look = b.look AND a.row_id < b.row_id AND a.raw <> b.raw
        UNION ALL SELECT 'span', row_id, row_id FROM {AUTHOR} WHERE {_MAPPED('span')} <> '' AND NOT contains(sentence, span) AND contains({_MAPPED('sentence')}, {_MAPPED('span')})""",
}
