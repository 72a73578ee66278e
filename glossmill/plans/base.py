"""Shared inputs of the plans: the prediction fact table, candidates with their families, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import without_formatting
from glossmill.operators import ranking, rules
from glossmill.session import table

NO_OUTPUT = "无输出"
POSITIVE, NEGATIVE = "是目标语法点", "不是目标语法点"
LABELS = ["支持", "部分支持", "不支持"]

#: Demonstration bindings for the points of the candidate table.
DEMO_BOOK = rules.RuleBook(
    bindings={
        "安放把字候选": rules.Binding("把", "把.{2,}(放|搬|挂|摆)", ("R-01", "R-02"), ("R-03",), ("R-04",), ("^一把",)),
        "越来越候选": rules.Binding("越来越", "越来越.{1,}", ("R-05", "R-06"), ("R-07",), ("R-08",)),
        "无论都候选": rules.Binding("无论", "无论.+都", ("R-09", "R-10"), ("R-11",), ("R-12",), ("……",)),
        "除了以外候选": rules.Binding("除了", "除了.+以外", ("R-13", "R-14"), ("R-15",), ("R-16",)),
        "连都强调候选": rules.Binding("连", "连.+都", ("R-17", "R-18"), ("R-19",), ("R-20",)),
        "是的强调候选": rules.Binding("是", "是.+的", ("R-21", "R-22", "R-23"), ("R-24",), ("R-25",), ("老师$",)),
        "只有才候选": rules.Binding("只有", "只有.+才", ("R-26", "R-27"), ("R-28",), ("R-29",)),
        "有的有的候选": rules.Binding("有的", "有的.+有的", ("R-30",), ("R-31", "R-32"), ("R-33",)),
        "一就紧接候选": rules.Binding("一", "一.+就", ("R-34", "R-35"), ("R-36",), ("R-37",)),
        "与其不如候选": rules.Binding("与其", "与其.+不如", ("R-38",), ("R-39",), ("R-40",)),
        "宁可也候选": rules.Binding("宁可", "宁可.+也", ("R-41", "R-42"), ("R-43",), ("R-44",)),
    },
    meta=("例句", "语法点", "候选", "[A-Z]:", "……|\\.\\.\\."),
    literals={"随着框架候选": ("随着",), "起来趋向候选": ("起来",), "请求兼语候选": ("请",), "下去持续候选": ("下去",), "遍数动量候选": ("遍",)},
)

STRUCTURAL = ("安放与移位", "补足成分", "论元增减", "时空框架")


def hash_bucket(key: Column) -> Column:
    """0..9 from the first 8 hex digits of a SHA-1."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 10).cast("int")


def split_name(key: Column) -> Column:
    b = hash_bucket(key)
    return F.when(b < 7, "train").when(b < 8, "dev").otherwise("test")


SQL_BUCKET = "(('0x' || substr(sha1({k}), 1, 8))::BIGINT % 10)"


def sql_split(key: str) -> str:
    b = SQL_BUCKET.format(k=key)
    return f"CASE WHEN {b} < 7 THEN 'train' WHEN {b} < 8 THEN 'dev' ELSE 'test' END"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, seed, model, item, grp, gold, prediction, confidence, cues, grounded, status): one row per run."""
    e = table(spark, sf_dir, "evidence_predictions_release")
    grp = without_formatting("sentence_group")
    return e.select(
        "row_id", F.coalesce("repeat", F.lit(0)).alias("seed"), F.col("response_model").alias("model"), F.coalesce(without_formatting("编号"), F.lit("")).alias("item"),
        F.when(grp.rlike("^[0-9a-f]{16}$"), grp).otherwise("").alias("grp"), "gold", F.coalesce("prediction", F.lit(NO_OUTPUT)).alias("prediction"),
        "confidence", F.col("has_evidence_cues").alias("cues"), F.col("all_cues_grounded").alias("grounded"), F.col("response_status").alias("status"),
    )


SQL_FACTS = rf"""facts AS (
    SELECT row_id, coalesce(repeat, 0) AS seed, response_model AS model, coalesce(lower(regexp_replace("编号", '[^\p{{L}}\p{{N}}]+', '', 'g')), '') AS item,
        CASE WHEN regexp_full_match(lower(regexp_replace(sentence_group, '[^\p{{L}}\p{{N}}]+', '', 'g')), '[0-9a-f]{{16}}')
             THEN lower(regexp_replace(sentence_group, '[^\p{{L}}\p{{N}}]+', '', 'g')) ELSE '' END AS grp,
        gold, coalesce(prediction, '{NO_OUTPUT}') AS prediction, confidence, has_evidence_cues AS cues, all_cues_grounded AS grounded, response_status AS status
    FROM evidence_predictions_release)"""


def group_key() -> Column:
    return F.when(F.col("grp") != "", F.col("grp")).otherwise(F.col("item"))


SQL_GROUP_KEY = "CASE WHEN grp <> '' THEN grp ELSE item END"


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, seed, item, gkey, system, gold, prediction, correct, confidence): three systems on each row with gold.

    The systems are expanded from the row itself; only the majority label, one row, is joined.
    """
    f = facts(spark, sf_dir).withColumn("gkey", group_key()).where(F.col("gold").isNotNull())
    train = f.where(split_name(F.col("gkey")) == "train").withColumn("one", F.lit(1))
    top = ranking.majority_label(train, ["one"], "gold", "row_id").select("majority")
    cue = F.when((F.col("grounded") == 1) & (F.col("cues") == 1), "支持").when(F.col("cues") == 1, "部分支持").otherwise("不支持")
    pairs = F.array(
        F.struct(F.lit("model").alias("system"), F.col("prediction").alias("p")), F.struct(F.lit("cues").alias("system"), cue.alias("p")),
        F.struct(F.lit("majority").alias("system"), F.col("majority").alias("p")),
    )
    long = f.crossJoin(F.broadcast(top)).select("row_id", "seed", "item", "gkey", "gold", "confidence", F.explode(pairs).alias("s"))
    return long.select(
        "row_id", "seed", "item", "gkey", "s.system", "gold", F.col("s.p").alias("prediction"), (F.col("gold") == F.col("s.p")).cast("int").alias("correct"), "confidence"
    )


SQL_SYSTEMS = f"""{SQL_FACTS}, keyed AS (SELECT *, {SQL_GROUP_KEY} AS gkey FROM facts WHERE gold IS NOT NULL),
    top AS (SELECT gold AS majority FROM keyed WHERE {sql_split('gkey')} = 'train' GROUP BY gold ORDER BY count(*) DESC, min(row_id) LIMIT 1),
    sys0 AS (
        SELECT row_id, seed, item, gkey, 'model' AS system, gold, prediction, confidence FROM keyed
        UNION ALL SELECT row_id, seed, item, gkey, 'cues', gold,
            CASE WHEN grounded = 1 AND cues = 1 THEN '支持' WHEN cues = 1 THEN '部分支持' ELSE '不支持' END, confidence FROM keyed
        UNION ALL SELECT row_id, seed, item, gkey, 'majority', gold, majority, confidence FROM keyed, top),
    systems AS (SELECT *, (gold = prediction)::INT AS correct FROM sys0)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, item_id, label, family, sentence, span, gold, tier, construction): candidates with their family."""
    a = table(spark, sf_dir, "author_written_244")
    fam = table(spark, sf_dir, "grammar_points_v0_1").groupBy(F.col("candidate_label").alias("label")).agg(F.min("family").alias("family"))
    return a.join(fam, "label", "left").select(
        "row_id", "item_id", "label", F.coalesce("family", F.lit("")).alias("family"), "sentence", "span", "gold", F.col("benchmark_label").alias("tier"), "construction"
    )


SQL_CANDIDATES = """cand AS (
    SELECT a.row_id, a.item_id, a.label, coalesce(f.family, '') AS family, a.sentence, a.span, a.gold, a.benchmark_label AS tier, a.construction
    FROM author_written_244 a LEFT JOIN (SELECT candidate_label, min(family) AS family FROM grammar_points_v0_1 GROUP BY 1) f ON f.candidate_label = a.label)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with rule outcomes and the label predicted from them."""
    e = rules.evaluate(candidates(spark, sf_dir), DEMO_BOOK, family="family")
    return e.withColumn("prediction", rules.predicted_label(F.col("accepted"), F.col("strong_reject"), F.col("weak_reject"), POSITIVE, NEGATIVE))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]::VARCHAR[]"


def _sql_case(cases: dict[str, str], other: str) -> str:
    return "CASE label " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


def _sql_rules() -> str:
    b = DEMO_BOOK.bindings
    of = lambda make, other: _sql_case({k: make(x) for k, x in b.items()}, other)
    lit = {k: "(" + " OR ".join(f"contains(c, {_q(m)})" for m in ms) + ")" for k, ms in DEMO_BOOK.literals.items()}
    short = {k: str(min(len(m) for m in ms)) for k, ms in DEMO_BOOK.literals.items()}
    meta = " OR ".join(f"regexp_matches(c, {_q(m)})" for m in DEMO_BOOK.meta)
    bound = "label IN (" + ", ".join(_q(k) for k in b) + ")"
    trim = lambda x: rf"regexp_replace(coalesce({x}, ''), '^[\s\p{{Z}}\x{{0085}}]+|[\s\p{{Z}}\x{{0085}}]+$', '', 'g')"
    return f"""{SQL_CANDIDATES}, r0 AS (SELECT *, {trim('sentence')} AS s, {trim('span')} AS c, {bound} AS bound FROM cand),
    r1 AS (SELECT *, CASE WHEN bound THEN {of(lambda x: f"regexp_matches(c, {_q(x.marker)})", 'false')} ELSE {_sql_case(lit, 'false')} END AS m,
        CASE WHEN bound THEN {of(lambda x: f"regexp_matches(c, {_q(x.structure)})", 'false')}
             ELSE {_sql_case(lit, 'false')} AND length(c) >= greatest(2, {_sql_case(short, '1')} + 1) END AS st,
        {of(lambda x: "(" + (" OR ".join(f"regexp_matches(c, {_q(h)})" for h in x.hard_negatives) or "false") + ")", 'false')} AS lex,
        {of(lambda x: _sql_list(x.positive), '[]::VARCHAR[]')} AS pos, {of(lambda x: _sql_list(x.weak), '[]::VARCHAR[]')} AS weak,
        {of(lambda x: _sql_list(x.strong), '[]::VARCHAR[]')} AS strong, ({meta}) AS meta, (c <> '' AND NOT contains(s, c)) AS off FROM r0),
    r2 AS (SELECT *,
        CASE WHEN bound THEN list_concat(CASE WHEN m THEN pos[1:1] ELSE [] END, CASE WHEN st THEN pos[2:] ELSE [] END) ELSE [] END AS p_ids,
        list_concat(list_concat(CASE WHEN bound AND NOT m THEN weak[1:1] ELSE [] END, CASE WHEN bound AND NOT st THEN weak[1:1] ELSE [] END),
            CASE WHEN off AND bound THEN weak[1:1] WHEN off THEN ['GLOBAL-OFFSET-MISMATCH'] ELSE [] END) AS w_ids,
        list_concat(list_concat(CASE WHEN bound AND lex THEN strong[len(strong):len(strong)] ELSE [] END, CASE WHEN c = '' THEN ['GLOBAL-EMPTY-CANDIDATE'] ELSE [] END),
            CASE WHEN meta AND len(strong) > 0 THEN strong[1:1] WHEN meta THEN ['GLOBAL-META-MENTION'] ELSE [] END) AS s_ids FROM r1),
    r3 AS (SELECT *, len(list_distinct(p_ids)) AS np, len(list_distinct(w_ids)) AS nw, len(list_distinct(s_ids)) AS ns FROM r2),
    ev AS (SELECT *, np - nw - 2 * ns AS score, m AND st AND ns = 0 AS accepted, nw > 0 AND ns = 0 AS weak_reject, ns > 0 AS strong_reject,
        CASE WHEN ns > 0 THEN 'strong' WHEN nw > 0 THEN 'weak' WHEN m AND st THEN 'accept' ELSE 'no_decision' END AS state,
        CASE WHEN m AND st AND ns = 0 THEN '{POSITIVE}' ELSE '{NEGATIVE}' END AS prediction FROM r3)"""


SQL_EVALUATED = _sql_rules()


def sql_metrics(source: str, keys: list[str], negative: str | None = None) -> str:
    """Union-label metrics of ``source(keys, gold, prediction)`` as SQL."""
    k = ", ".join(keys)
    kk = k + ", " if keys else ""
    hard = f"round(max(CASE WHEN label = '{negative}' AND support > 0 THEN tp / support::DOUBLE END), 6)" if negative else "NULL::DOUBLE"
    group = f"GROUP BY {k}" if keys else ""
    return f"""cells AS (SELECT {kk}gold, prediction, count(*) AS n FROM {source} WHERE gold IS NOT NULL AND prediction IS NOT NULL GROUP BY {kk}gold, prediction),
    lab AS (SELECT {kk}label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
        SELECT {kk}gold AS label, CASE WHEN gold = prediction THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM cells
        UNION ALL SELECT {kk}prediction, 0, 0, n FROM cells) GROUP BY {kk}label),
    metrics AS (SELECT {kk}sum(support)::BIGINT AS n_rows, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy,
        round(avg(2 * tp / (support + predicted)::DOUBLE), 6) AS macro_f1, {hard} AS hard_negative_accuracy FROM lab {group})"""
