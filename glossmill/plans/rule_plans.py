"""Rule execution, its evaluation by family, regime, binding and tier, and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import ratio
from glossmill.operators import metrics, ranking, rules
from glossmill.plans import base
from glossmill.plans.base import NEGATIVE, POSITIVE, SQL_CANDIDATES, SQL_EVALUATED, sql_metrics, sql_split


def rule_states(spark: SparkSession, d: str) -> DataFrame:
    e = base.evaluated(spark, d)
    return e.select(
        "row_id", F.col("score").cast("int").alias("score"), F.size("positive_ids").alias("n_positive"), F.size("weak_ids").alias("n_weak"),
        F.size("strong_ids").alias("n_strong"), F.col("accepted").cast("int").alias("accepted"), F.col("weak_reject").cast("int").alias("weak_reject"), "state",
    )


def rule_trace(spark: SparkSession, d: str) -> DataFrame:
    return base.evaluated(spark, d).select("row_id", F.array_join("trace", ";").alias("trace"))


def rule_catalog_states(spark: SparkSession, d: str) -> DataFrame:
    """The same executor with its bindings as a joined catalogue instead of a ladder."""
    limit, rules.LADDER_LIMIT = rules.LADDER_LIMIT, 0
    try:
        e = base.evaluated(spark, d)
    finally:
        rules.LADDER_LIMIT = limit
    return e.select("row_id", F.col("score").cast("int").alias("score"), "state")


def rule_eval_by_family(spark: SparkSession, d: str) -> DataFrame:
    return metrics.union_label_metrics(base.evaluated(spark, d), ["family"], NEGATIVE)


def regime_breakdown(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("family").isin(*base.STRUCTURAL), "structural_pattern").when(F.col("family") == "", "unassigned").otherwise("complex_functional")
    return metrics.binary_f1(base.evaluated(spark, d).withColumn("regime", known), ["regime"], POSITIVE)


def binding_coverage(spark: SparkSession, d: str) -> DataFrame:
    bound = F.when(F.col("label").isin(*base.DEMO_BOOK.bindings), "bound").otherwise("unbound")
    e = base.evaluated(spark, d).withColumn("binding_kind", bound)
    return e.groupBy("binding_kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_points"), F.round(ratio(F.count_if(F.col("accepted")), F.count(F.lit(1))), 6).alias("accept_rate"),
        F.round(ratio(F.count_if(F.col("gold") == F.col("prediction")), F.count("gold")), 6).alias("accuracy"),
    )


def tier_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.union_label_metrics(base.evaluated(spark, d), ["tier", "construction"], NEGATIVE)


def trace_state_rates(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and target rate per tier and state; states that don't occur are still listed."""
    e = base.evaluated(spark, d)
    states = F.explode(F.array(*[F.lit(s) for s in ("strong", "weak", "accept", "no_decision")])).alias("state")
    seen = e.groupBy("tier", "state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == POSITIVE).alias("pos"))
    totals = e.groupBy("tier").agg(F.count(F.lit(1)).alias("total"))
    grid = totals.select("tier", "total", states)
    j = grid.join(seen, ["tier", "state"], "left").fillna(0, ["n", "pos"])
    return j.select("tier", "state", F.col("n").alias("n_rows"), F.round(ratio(F.col("n"), F.col("total")), 6).alias("coverage"), F.round(ratio(F.col("pos"), F.col("n")), 6).alias("target_rate"))


def _majority_eval(level: str | None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = base.candidates(spark, d).where(F.col("gold").isNotNull()).withColumn("split", base.split_name(F.coalesce("item_id", F.lit(""))))
        train, test = c.where(F.col("split") == "train"), c.where(F.col("split") == "test")
        top = ranking.majority_label(train.withColumn("one", F.lit(1)), ["one"], "gold", "row_id").select(F.col("majority").alias("fallback"))
        if level:
            local = ranking.majority_label(train, [level], "gold", "row_id")
            test = test.join(local, level, "left").crossJoin(F.broadcast(top)).withColumn("prediction", F.coalesce("majority", "fallback"))
        else:
            test = test.crossJoin(F.broadcast(top)).withColumn("prediction", F.col("fallback"))
        return metrics.union_label_metrics(test, ["tier"], NEGATIVE)

    return query


def _majority_sql(level: str | None) -> str:
    local = f"SELECT {level}, gold, row_number() OVER (PARTITION BY {level} ORDER BY count(*) DESC, min(row_id)) AS r FROM sp WHERE split = 'train' GROUP BY {level}, gold" if level else ""
    pred = (
        f"loc AS ({local}), t AS (SELECT sp.tier, sp.gold, coalesce(loc.gold, top.gold) AS prediction FROM sp CROSS JOIN top LEFT JOIN loc ON loc.{level} = sp.{level} AND loc.r = 1 WHERE split = 'test')"
        if level
        else "t AS (SELECT sp.tier, sp.gold, top.gold AS prediction FROM sp CROSS JOIN top WHERE split = 'test')"
    )
    split_key = "coalesce(item_id, '')"
    return f"""WITH {SQL_CANDIDATES}, sp AS (SELECT *, {sql_split(split_key)} AS split FROM cand WHERE gold IS NOT NULL),
        top AS (SELECT gold FROM sp WHERE split = 'train' GROUP BY gold ORDER BY count(*) DESC, min(row_id) LIMIT 1), {pred}, {sql_metrics('t', ['tier'], NEGATIVE)} SELECT * FROM metrics"""


def span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spans found by the bound structure pattern against the given ones."""
    c = base.candidates(spark, d)
    found = rules._case({k: f"regexp_extract(sentence, {rules._lit(b.structure)}, 0)" for k, b in base.DEMO_BOOK.bindings.items()}, "''")
    with_found = c.withColumn("_p", F.col("label")).withColumn("found", F.expr(found))
    return metrics.span_scores(with_found, ["tier"], "span", "found", "sentence")


_FOUND = base._sql_case({k: f"regexp_extract(sentence, {base._q(b.structure)}, 0)" for k, b in base.DEMO_BOOK.bindings.items()}, "''")
_REGIME = "CASE WHEN family IN (" + ", ".join(f"'{f}'" for f in base.STRUCTURAL) + ") THEN 'structural_pattern' WHEN family = '' THEN 'unassigned' ELSE 'complex_functional' END"
_BOUND = "CASE WHEN bound THEN 'bound' ELSE 'unbound' END"

QUERIES = {
    "rule_states": rule_states,
    "rule_trace": rule_trace,
    "rule_catalog_states": rule_catalog_states,
    "rule_eval_by_family": rule_eval_by_family,
    "regime_breakdown": regime_breakdown,
    "binding_coverage": binding_coverage,
    "tier_breakdown": tier_breakdown,
    "trace_state_rates": trace_state_rates,
    "majority_global_eval": _majority_eval(None),
    "majority_family_eval": _majority_eval("family"),
    "majority_point_eval": _majority_eval("label"),
    "span_scores": span_scores,
}

ORACLES = {
    "rule_states": f"""WITH {SQL_EVALUATED} SELECT row_id, score::INT AS score, np::INT AS n_positive, nw::INT AS n_weak, ns::INT AS n_strong, accepted::INT AS accepted,
        weak_reject::INT AS weak_reject, state FROM ev""",
    "rule_trace": f"""WITH {SQL_EVALUATED}, ids AS (SELECT row_id, label, family, list_concat(list_concat(p_ids, w_ids), s_ids) AS ids FROM ev),
        once AS (SELECT row_id, label, family, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS ids FROM ids)
        SELECT row_id, array_to_string(list_concat(['candidate:' || coalesce(label, ''), 'family:' || family], list_transform(ids, lambda x: 'rule:' || x)), ';') AS trace FROM once""",
    "rule_catalog_states": f"WITH {SQL_EVALUATED} SELECT row_id, score::INT AS score, state FROM ev",
    "rule_eval_by_family": f"WITH {SQL_EVALUATED}, {sql_metrics('ev', ['family'], NEGATIVE)} SELECT * FROM metrics",
    "regime_breakdown": f"""WITH {SQL_EVALUATED}, b AS (SELECT {_REGIME} AS regime, gold = '{POSITIVE}' AS g, prediction = '{POSITIVE}' AS p FROM ev WHERE gold IS NOT NULL),
        c AS (SELECT regime, count(*) AS n_rows, count(*) FILTER (g AND p)::DOUBLE AS tp, count(*) FILTER (NOT g AND p)::DOUBLE AS fp, count(*) FILTER (g AND NOT p)::DOUBLE AS fn,
            count(*) FILTER (NOT g AND NOT p)::DOUBLE AS tn FROM b GROUP BY 1),
        f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS pf, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS nf FROM c)
        SELECT regime, n_rows, round(pf, 6) AS pos_f1, round(nf, 6) AS neg_f1, round((pf + nf) / 2, 6) AS macro_f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS negative_recall FROM f""",
    "binding_coverage": f"""WITH {SQL_EVALUATED} SELECT {_BOUND} AS binding_kind, count(*) AS n_rows, count(DISTINCT label) AS n_points,
        round(count(*) FILTER (accepted) / count(*)::DOUBLE, 6) AS accept_rate, round(count(*) FILTER (gold = prediction) / count(gold)::DOUBLE, 6) AS accuracy FROM ev GROUP BY 1""",
    "tier_breakdown": f"WITH {SQL_EVALUATED}, {sql_metrics('ev', ['tier', 'construction'], NEGATIVE)} SELECT * FROM metrics",
    "trace_state_rates": f"""WITH {SQL_EVALUATED}, t AS (SELECT tier, count(*) AS total FROM ev GROUP BY 1),
        s AS (SELECT tier, state, count(*) AS n, count(*) FILTER (gold = '{POSITIVE}') AS pos FROM ev GROUP BY 1, 2),
        g AS (SELECT tier, total, unnest(['strong', 'weak', 'accept', 'no_decision']) AS state FROM t)
        SELECT g.tier, g.state, coalesce(n, 0)::BIGINT AS n_rows, round(coalesce(n, 0) / total::DOUBLE, 6) AS coverage, round(coalesce(pos / nullif(n, 0)::DOUBLE, 0), 6) AS target_rate
        FROM g LEFT JOIN s ON s.tier IS NOT DISTINCT FROM g.tier AND s.state = g.state""",
    "majority_global_eval": _majority_sql(None),
    "majority_family_eval": _majority_sql("family"),
    "majority_point_eval": _majority_sql("label"),
    "span_scores": f"""WITH {SQL_CANDIDATES}, f AS (SELECT tier, coalesce(sentence, '') AS s, coalesce(span, '') AS g, coalesce({_FOUND}, '') AS p FROM cand),
        c AS (SELECT tier, count(*) FILTER (g <> '' AND g = p) AS tp, count(*) FILTER (p <> '' AND g <> p) AS fp, count(*) FILTER (g <> '' AND g <> p) AS fn,
            count(*) FILTER (g <> '' AND p <> '' AND (contains(g, p) OR contains(p, g))) AS rel, count(*) FILTER (g <> '' AND p <> '') AS bth,
            count(*) FILTER (p <> '' AND contains(s, p)) AS gr, count(*) FILTER (p <> '') AS np FROM f GROUP BY 1)
        SELECT tier, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
            round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(rel / nullif(bth, 0)::DOUBLE, 0), 6) AS relaxed,
            round(coalesce(gr / nullif(np, 0)::DOUBLE, 0), 6) AS grounded FROM c""",
}
