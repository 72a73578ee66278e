"""References to records that do not exist.

An end of an edge (``source`` or ``target``) refers to ``nodes.id``.  It resolves when at least one delivery of
that id was loaded no later than the edge and was not deleted at or before the edge's load time.

Method (skew-aware split):

1. References are pre-aggregated per key and month with map-side combining; keys that hold at least
   ``heavy_share`` of all references are heavy.  At most ``1 / heavy_share`` keys can be, so that list is bounded
   by construction whatever the size of the data.
2. Deliveries are reduced to life spans: per id the earliest load of a delivery that was never deleted
   (``open_from``), and per distinct deletion time the earliest load.  Repeated deliveries vanish map-side.
3. Heavy keys are checked against a broadcast of their own life spans, after counting that these fit
   ``broadcast_rows``; if they do not, the same check runs as a salted shuffle join.
4. All other references go through a shuffle anti-join on the key.  Both parts are united.

Nulls: a null end is no reference, an edge without load time resolves to nothing (every end is an orphan), a node
row without id or load time can't resolve anything, an empty text is an ordinary id.  Empty tables give an
empty result or, with no nodes, every non-null end.  Repeated edges count once per ``edge_id`` row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 0.002
BROADCAST_ROWS = 20_000
SALTS = 32


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, side, key, relation, at, month): one row per non-null end; no shuffle."""
    ends = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source").alias("key")),
        F.struct(F.lit("target").alias("side"), F.col("target").alias("key")),
    )
    rows = edges.select("edge_id", "relation", F.col("loaded_at").alias("at"), F.explode(ends).alias("end"))
    return rows.where(F.col("end.key").isNotNull()).select(
        "edge_id", "end.side", "end.key", "relation", "at", F.trunc("at", "month").alias("month")
    )


def life_spans(nodes: DataFrame) -> DataFrame:
    """(key, begun, ended): distinct life spans of every id; ``ended`` null means never deleted."""
    live = nodes.where(
        F.col("id").isNotNull()
        & F.col("loaded_at").isNotNull()
        & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at")))
    )
    return live.groupBy(F.col("id").alias("key"), F.col("deleted_at").alias("ended")).agg(F.min("loaded_at").alias("begun"))


def heavy_keys(refs: DataFrame, share: float = HEAVY_SHARE) -> list[str]:
    """Keys holding at least ``share`` of all references; never more than 1/share of them."""
    per_period = refs.groupBy("key", "month").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_period.groupBy("key").agg(F.sum("n").alias("n"))
    total = refs.count()
    if not total:
        return []
    return [r["key"] for r in per_key.where(F.col("n") >= F.lit(max(2.0, share * total))).select("key").collect()]


def _alive() -> Column:
    return (F.col("begun") <= F.col("at")) & (F.col("ended").isNull() | (F.col("ended") > F.col("at")))


def _anti(refs: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.withColumnRenamed("key", "span_key")
    return refs.join(s, (F.col("key") == F.col("span_key")) & _alive(), "left_anti")


def _salted_anti(refs: DataFrame, spans: DataFrame) -> DataFrame:
    left = refs.withColumn("salt", F.pmod(F.xxhash64("edge_id", "side"), F.lit(SALTS)).cast("int"))
    right = spans.withColumnRenamed("key", "span_key").withColumn(
        "span_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    cond = (F.col("key") == F.col("span_key")) & (F.col("salt") == F.col("span_salt")) & _alive()
    return left.join(right, cond, "left_anti").drop("salt")


def orphan_references(
    edges: DataFrame, nodes: DataFrame, heavy_share: float = HEAVY_SHARE, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(edge_id, side, key, relation, at, month) of every reference that resolves to no living record."""
    refs = references(edges)
    spans = life_spans(nodes)
    heavy = heavy_keys(refs, heavy_share)
    if not heavy:
        return _anti(refs, spans)
    is_heavy = F.col("key").isin(heavy)
    heavy_spans = life_spans(nodes.where(F.col("id").isin(heavy)))
    light = _anti(refs.where(~is_heavy), spans.where(~is_heavy))
    if heavy_spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot = _anti(refs.where(is_heavy), F.broadcast(heavy_spans))
    else:
        hot = _salted_anti(refs.where(is_heavy), heavy_spans)
    return hot.unionByName(light)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(side, relation, month, n_orphans, n_keys): orphan ends per side, relation and month of loading."""
    return orphans.groupBy("side", "relation", F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_keys")
    )
