"""Layered property graphs as two frames, nodes(id, type, label, properties_json) and edges(source, relation, target,
properties_json), with measured integrity.

Defined cases: repeated identical nodes or edges are one; an id with differing contents is a conflict and listed;
null ends are never counted as dangling; empty frames give empty reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_layers(*layers: DataFrame) -> DataFrame:
    """Union by name; columns missing in a layer become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.dropDuplicates()


def node_conflicts(nodes: DataFrame, content: list[str]) -> DataFrame:
    """(id, n_versions) of ids whose contents differ."""
    return nodes.select("id", *content).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_versions")).where(F.col("n_versions") > 1)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "relation", "target", "properties_json").distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation, side, n): ends that name no node, of any time."""
    ids = nodes.select(F.col("id").alias("end")).distinct()
    parts = [
        edges.where(F.col(side).isNotNull()).select("relation", F.lit(side).alias("side"), F.col(side).alias("end")) for side in ("source", "target")
    ]
    return union_layers(*parts).join(ids, "end", "left_anti").groupBy("relation", "side").agg(F.count(F.lit(1)).alias("n"))


def degree_integrity(edges: DataFrame, relations: list[str]) -> DataFrame:
    """(relation, n_sources, min_degree, max_degree, exactly_one): out-degrees over distinct edges."""
    per = distinct_edges(edges).where(F.col("source").isNotNull() & F.col("relation").isin(relations)).groupBy("source", "relation").agg(F.count(F.lit(1)).alias("d"))
    return per.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n_sources"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.count_if(F.col("d") == 1).alias("exactly_one")
    )


def preserved(base: DataFrame, extended: DataFrame, keys: list[str]) -> DataFrame:
    """(n_base, n_missing): whether every row of a layer is still there."""
    gone = base.select(*keys).distinct().join(extended.select(*keys).distinct(), [base[k].eqNullSafe(extended[k]) for k in keys], "left_anti")
    return base.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_base")).crossJoin(gone.agg(F.count(F.lit(1)).alias("n_missing")))


def path_counts(edges: DataFrame, relations: list[str]) -> DataFrame:
    """(start, stop, n_paths) along a chain of relations, each hop an equi-join on already counted ends.

    Paths are counted, not listed: after each hop rows are (start, end, n), so hubs don't multiply rows.
    """
    hop = lambda r: distinct_edges(edges.where(F.col("relation") == r)).where(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("source", "target").agg(F.count(F.lit(1)).alias("m"))
    out = hop(relations[0]).select(F.col("source").alias("start"), F.col("target").alias("stop"), F.col("m").alias("n_paths"))
    for r in relations[1:]:
        nxt = hop(r).select(F.col("source").alias("stop"), F.col("target").alias("next"), "m")
        out = out.join(nxt, "stop").groupBy("start", F.col("next").alias("stop")).agg(F.sum(F.col("n_paths") * F.col("m")).alias("n_paths"))
    return out


def shared_target_counts(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(left_target, right_target, n_sources): how often two relations leave the same source."""
    a = distinct_edges(edges.where(F.col("relation") == left)).select("source", F.col("target").alias("left_target")).distinct()
    b = distinct_edges(edges.where(F.col("relation") == right)).select("source", F.col("target").alias("right_target")).distinct()
    return a.join(b, "source").where(F.col("left_target").isNotNull() & F.col("right_target").isNotNull()).groupBy("left_target", "right_target").agg(F.count(F.lit(1)).alias("n_sources"))
