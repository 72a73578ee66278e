"""Cluster bootstrap on pre-aggregated groups.

Groups are resampled, not rows.  Rows are first reduced to one vector of confusion counts per group (map-side
combined), so a replicate costs one weighted sum over groups whatever the number of rows.  Replicate weights come from
a hash of (replicate, group): Poisson(1) by inverse cumulative weights, so that draws need no coordination, every task
can recompute them after a loss, and the same group has the same weight for all systems and seeds (paired and pooled
comparisons).

Two forms: ``hash_replicates`` expands groups by replicates inside the JVM, for a moderate number of draws, and
``numpy_replicates`` multiplies weight blocks in one pass per partition and adds up partial sums, for thousands.

Defined cases: a label absent from a draw scores F1 0; labels are those of gold only; no groups give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import ratio
from glossmill.session import materialize

#: Cumulative Poisson(1) weights in thousandths: P(X <= 0), P(X <= 1), ...
POISSON_CUTS = (368, 736, 920, 981, 996, 999)
#: Groups whose weights a task of ``numpy_replicates`` holds at once.
WEIGHT_ROWS = 500


def group_cells(df: DataFrame, keys: list[str], group: str, gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """(keys, group, label, tp, support, predicted) per group, labels as seen."""
    known = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    cells = known.groupBy(*keys, group, F.col(gold).alias("_gold"), F.col(pred).alias("_pred")).agg(F.count(F.lit(1)).alias("_n"))
    same = F.when(F.col("_gold") == F.col("_pred"), F.col("_n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    a = cells.select(*keys, group, F.col("_gold").alias("label"), same.alias("tp"), F.col("_n").alias("support"), none.alias("predicted"))
    b = cells.select(*keys, group, F.col("_pred").alias("label"), none.alias("tp"), none.alias("support"), F.col("_n").alias("predicted"))
    return a.unionByName(b).groupBy(*keys, group, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def hash_weights(group: Column, draws: int) -> Column:
    """Array of the Poisson(1) weights of a group in replicates 1..draws, from 8 hex digits of a SHA-1 each."""
    us = F.transform(
        F.sequence(F.lit(1), F.lit(draws)),
        lambda r: F.conv(F.substring(F.sha1(F.concat_ws("|", r.cast("string"), group)), 1, 8), 16, 10).cast("long") % 1000,
    )
    return F.transform(us, lambda u: sum(((u >= cut).cast("int") for cut in POISSON_CUTS), F.lit(0)))


def hash_replicates(cells: DataFrame, keys: list[str], group: str, draws: int) -> DataFrame:
    """(keys, replicate, macro_f1, accuracy) for every draw.

    Weights are made once per group and replicate; the cells of a group (systems x labels) travel with it.
    """
    cells = materialize(cells, "cells")
    labels = cells.where(F.col("support") > 0).select(*keys, "label").distinct()
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small data, much work: keep it spread
    per_group = cells.repartition(tasks, group).groupBy(group).agg(F.collect_list(F.struct(*keys, "label", "tp", "support", "predicted")).alias("_cells"))
    drawn = per_group.select("_cells", F.posexplode(hash_weights(F.col(group), draws)).alias("_r", "w")).where(F.col("w") > 0)
    weighted = (
        drawn.select((F.col("_r") + 1).alias("replicate"), "w", F.explode("_cells").alias("c"))
        .groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], "replicate", F.col("c.label").alias("label"))
        .agg(*[F.sum(F.col(f"c.{c}") * F.col("w")).alias(c) for c in ("tp", "support", "predicted")])
    )
    size = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    known = labels.join(size, keys).withColumn("_gold", F.lit(True))
    flagged = weighted.join(F.broadcast(known), [*keys, "label"], "left")
    f1 = F.when(F.col("_gold"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).otherwise(0.0)
    return flagged.groupBy(*keys, "replicate").agg(
        (F.sum(f1) / F.max("k")).alias("macro_f1"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy")
    )


def interval(replicates: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, mean, low, high, sd, n_draws): percentile interval at 95 %."""
    return replicates.groupBy(*keys).agg(
        F.round(F.avg(metric), 6).alias("mean"), F.round(F.percentile(metric, F.lit(0.025)), 6).alias("low"),
        F.round(F.percentile(metric, F.lit(0.975)), 6).alias("high"), F.round(F.coalesce(F.stddev_samp(metric), F.lit(0.0)), 6).alias("sd"),
        F.count(F.lit(1)).alias("n_draws"),
    )


def paired_delta(replicates: DataFrame, keys: list[str], system: str, a: str, b: str, metric: str) -> DataFrame:
    """(keys, delta, low, high, p_value): difference on the same draws, two-sided."""
    wide = replicates.groupBy(*keys, "replicate").agg(
        F.max(F.when(F.col(system) == a, F.col(metric))).alias("a"), F.max(F.when(F.col(system) == b, F.col(metric))).alias("b")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("d", F.round(F.col("a") - F.col("b"), 9))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    return wide.groupBy(*keys).agg(
        F.round(F.avg("d"), 6).alias("delta"), F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"),
        F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"), F.round(p, 6).alias("p_value"),
    )


def numpy_replicates(cells: DataFrame, keys: list[str], group: str, labels: list[str], draws: int = 5000, seed: int = 42) -> DataFrame:
    """As ``hash_replicates`` for thousands of draws: one pass, partial sums per task added up in the JVM."""
    k = len(labels)

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf[group].fillna("").astype(str)
            codes, uniq = pd.factorize(groups)
            mats = []
            for key, part in pdf.assign(_g=codes).groupby(keys, dropna=False, sort=False) if keys else [((), pdf.assign(_g=codes))]:
                key = key if isinstance(key, tuple) else (key,)
                acc = sums.setdefault(key, np.zeros((draws, k * 3)))
                col = part["label"].map({x: i for i, x in enumerate(labels)})
                ok = col.notna()
                mat = np.zeros((len(uniq), k * 3))
                for j, c in enumerate(("tp", "support", "predicted")):
                    np.add.at(mat, (part["_g"][ok].to_numpy(), col[ok].to_numpy(dtype=int) * 3 + j), part[c][ok].to_numpy())
                mats.append((acc, mat))
            for at in range(0, len(uniq), WEIGHT_ROWS):
                weights = np.stack([np.random.default_rng([seed, *g.encode()]).poisson(1.0, draws).astype(np.float64) for g in uniq[at : at + WEIGHT_ROWS]])
                for acc, mat in mats:
                    acc += weights.T @ mat[at : at + WEIGHT_ROWS]
        for key, acc in sums.items():
            out = pd.DataFrame({"replicate": np.arange(draws, dtype=np.int32), "sums": list(acc)})
            for name, v in zip(keys, key):
                out[name] = v
            yield out[[*keys, "replicate", "sums"]]

    schema = ", ".join([f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keys] + ["replicate int", "sums array<double>"])
    # all cells of a group in one task and next to each other, so that its weights are drawn once
    parts = cells.repartition(group).sortWithinPartitions(group).mapInPandas(partial, schema)
    total = parts.groupBy(*keys, "replicate").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(3 * k)])
    f1 = [ratio(2 * F.col(f"s{3 * i}"), F.col(f"s{3 * i + 1}") + F.col(f"s{3 * i + 2}")) for i in range(k)]
    acc = ratio(sum((F.col(f"s{3 * i}") for i in range(k)), F.lit(0.0)), sum((F.col(f"s{3 * i + 1}") for i in range(k)), F.lit(0.0)))
    return total.select(*keys, "replicate", (sum(f1, F.lit(0.0)) / k).alias("macro_f1"), acc.alias("accuracy"))
