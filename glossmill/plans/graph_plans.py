"""Property graph: layers, upserts, conflicts, integrity, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import graph, ranking
from glossmill.plans import base
from glossmill.plans.base import SQL_CANDIDATES
from glossmill.session import table

DEGREES = ["OCCURS_IN", "IN_FAMILY", "CANDIDATE_OF", "HAS_CONSENSUS", "ANNOTATED_AS"]


def graph_nodes_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Distinct nodes by content, per type."""
    n = graph.upsert_nodes(table(spark, d, "nodes").select("id", "type", "label", "properties_json"))
    return n.groupBy("type").agg(F.count(F.lit(1)).alias("n_versions"), F.countDistinct("id").alias("n_ids"))


def graph_conflicts(spark, d):
    return graph.node_conflicts(table(spark, d, "nodes"), ["type", "label"])


def graph_current_nodes(spark, d):
    """The last delivery of each id; of two at the same time, the one with the larger label."""
    n = table(spark, d, "nodes").select("id", "type", "label", F.struct("loaded_at", "label", "properties_json").alias("o"))
    return ranking.last_wins(n.select("id", "type", "label", "o"), ["id"], "o").select("id", "type", "label")


def graph_edges_distinct(spark, d):
    e = graph.distinct_edges(table(spark, d, "edges"))
    return e.groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("target").alias("n_targets"))


def graph_degree_integrity(spark, d):
    return graph.degree_integrity(table(spark, d, "edges"), DEGREES)


def graph_dangling(spark, d):
    return graph.dangling(table(spark, d, "edges"), table(spark, d, "nodes"))


def graph_path_families(spark, d):
    """Paths from consensus to family over shared candidates, counted along the chain."""
    e = table(spark, d, "edges")
    back = e.where(F.col("relation") == "HAS_CONSENSUS").select(F.col("target").alias("source"), F.lit("OF").alias("relation"), F.col("source").alias("target"), "properties_json")
    chain = back.unionByName(e.select("source", "relation", "target", "properties_json"))
    p = graph.path_counts(chain, ["OF", "IN_FAMILY"])
    return p.groupBy("stop").agg(F.sum("n_paths").cast("long").alias("n_paths"), F.count(F.lit(1)).alias("n_starts"))


def graph_rule_sources(spark, d):
    """How often a rule and an authority leave the same candidate: rule -> candidate -> authority."""
    return graph.shared_target_counts(table(spark, d, "edges"), "ACTIVATES_RULE", "DERIVED_FROM")


def _layer(spark, d) -> tuple[DataFrame, DataFrame]:
    """A layer of nodes and edges built from the candidate table."""
    c = base.candidates(spark, d)
    node = lambda kind, key, label: c.where(key.isNotNull()).select(F.concat(F.lit(kind + ":"), key).alias("id"), F.lit(kind).alias("type"), label.alias("label")).distinct()
    nodes = graph.union_layers(
        node("example", F.col("item_id"), F.col("item_id")), node("point", F.col("label"), F.col("label")), node("family", F.nullif(F.col("family"), F.lit("")), F.col("family"))
    )
    edge = lambda rel, a, b, ka, kb: c.where(a.isNotNull() & b.isNotNull()).select(
        F.concat(F.lit(ka + ":"), a).alias("source"), F.lit(rel).alias("relation"), F.concat(F.lit(kb + ":"), b).alias("target")
    ).distinct()
    edges = graph.union_layers(
        edge("EXAMPLE_OF", F.col("item_id"), F.col("label"), "example", "point"),
        edge("IN_FAMILY", F.col("label"), F.nullif(F.col("family"), F.lit("")), "point", "family"),
    )
    return nodes, edges


def graph_layer_histogram(spark, d):
    nodes, edges = _layer(spark, d)
    a = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.col("type").alias("name"), "n")
    b = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.col("relation").alias("name"), "n")
    return a.unionByName(b)


def graph_preserved(spark, d):
    """The base layer is still there after a layer was added."""
    base_nodes = table(spark, d, "nodes").select("id", "type", "label")
    nodes, _ = _layer(spark, d)
    return graph.preserved(base_nodes, graph.union_layers(base_nodes, nodes), ["id", "type", "label"])


def graph_signal_precedence(spark, d):
    """Fired rules of candidates as edges, one signal per (candidate, rule): positive over weak over strong."""
    e = base.evaluated(spark, d)
    def tagged(column: str, k: int, signal: str):
        return F.transform(F.col(column), lambda r: F.struct(r.alias("rule"), F.lit(k).alias("k"), F.lit(signal).alias("signal")))

    signals = (("positive_ids", "positive"), ("weak_ids", "weak"), ("strong_ids", "strong"))
    sig = F.explode(F.concat(*[tagged(c, k, s) for k, (c, s) in enumerate(signals)])).alias("s")
    fired = e.select("item_id", sig).groupBy("item_id", F.col("s.rule").alias("rule")).agg(F.min(F.struct("s.k", "s.signal")).alias("m"))
    return fired.groupBy("rule", F.col("m.signal").alias("signal")).agg(F.count(F.lit(1)).alias("n_edges"))


_SQL_NODES = f"""{SQL_CANDIDATES}, ln AS (SELECT DISTINCT 'example:' || item_id AS id, 'example' AS type, item_id AS label FROM cand WHERE item_id IS NOT NULL
    UNION ALL SELECT DISTINCT 'point:' || label, 'point', label FROM cand WHERE label IS NOT NULL UNION ALL SELECT DISTINCT 'family:' || family, 'family', family FROM cand WHERE family <> '')"""

QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes_upsert, graph_conflicts, graph_current_nodes, graph_edges_distinct, graph_degree_integrity, graph_dangling, graph_path_families, graph_rule_sources,
        graph_layer_histogram, graph_preserved, graph_signal_precedence,
    )
}

ORACLES = {
    "graph_nodes_upsert": "SELECT type, count(*) AS n_versions, count(DISTINCT id) AS n_ids FROM (SELECT DISTINCT id, type, label, properties_json FROM nodes) GROUP BY 1",
    "graph_conflicts": "SELECT id, count(*) AS n_versions FROM (SELECT DISTINCT id, type, label FROM nodes) GROUP BY 1 HAVING count(*) > 1",
    "graph_current_nodes": """SELECT id, type, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, label DESC NULLS LAST, properties_json DESC NULLS LAST) AS k FROM nodes) WHERE k = 1""",
    "graph_edges_distinct": "SELECT relation, count(*) AS n_edges, count(DISTINCT target) AS n_targets FROM (SELECT DISTINCT source, relation, target, properties_json FROM edges) GROUP BY 1",
    "graph_degree_integrity": f"""WITH p AS (SELECT source, relation, count(*) AS d FROM (SELECT DISTINCT source, relation, target, properties_json FROM edges) WHERE source IS NOT NULL
        AND relation IN ({', '.join(f"'{r}'" for r in DEGREES)}) GROUP BY 1, 2) SELECT relation, count(*) AS n_sources, min(d) AS min_degree, max(d) AS max_degree, count(*) FILTER (d = 1) AS exactly_one FROM p GROUP BY 1""",
    "graph_dangling": """SELECT relation, side, count(*) AS n FROM (SELECT relation, 'source' AS side, source AS e FROM edges UNION ALL SELECT relation, 'target', target FROM edges)
        WHERE e IS NOT NULL AND e NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL) GROUP BY 1, 2""",
    "graph_path_families": """WITH e AS (SELECT DISTINCT source, relation, target, properties_json FROM edges WHERE source IS NOT NULL AND target IS NOT NULL),
        p AS (SELECT a.target AS start, b.target AS stop, count(*) AS n FROM e a JOIN e b ON a.source = b.source WHERE a.relation = 'HAS_CONSENSUS' AND b.relation = 'IN_FAMILY' GROUP BY 1, 2)
        SELECT stop, sum(n)::BIGINT AS n_paths, count(*) AS n_starts FROM p GROUP BY 1""",
    "graph_rule_sources": """WITH a AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'ACTIVATES_RULE' AND target IS NOT NULL), b AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'DERIVED_FROM' AND target IS NOT NULL)
        SELECT a.target AS left_target, b.target AS right_target, count(*) AS n_sources FROM a JOIN b ON a.source = b.source GROUP BY 1, 2""",
    "graph_layer_histogram": f"""WITH {_SQL_NODES}, le AS (SELECT DISTINCT item_id, 'EXAMPLE_OF' AS relation, label FROM cand WHERE item_id IS NOT NULL AND label IS NOT NULL
        UNION ALL SELECT DISTINCT label, 'IN_FAMILY', family FROM cand WHERE label IS NOT NULL AND family <> '')
        SELECT 'node' AS kind, type AS name, count(*) AS n FROM ln GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM le GROUP BY 2""",
    "graph_preserved": "SELECT count(*) AS n_base, 0::BIGINT AS n_missing FROM (SELECT DISTINCT id, type, label FROM nodes)",
    "graph_signal_precedence": f"""WITH {base.SQL_EVALUATED}, f AS (SELECT item_id, unnest(p_ids) AS rule, 0 AS k, 'positive' AS signal FROM ev UNION ALL SELECT item_id, unnest(w_ids), 1, 'weak' FROM ev
        UNION ALL SELECT item_id, unnest(s_ids), 2, 'strong' FROM ev), m AS (SELECT item_id, rule, arg_min(signal, k) AS signal FROM f GROUP BY 1, 2) SELECT rule, signal, count(*) AS n_edges FROM m GROUP BY 1, 2""",
}
