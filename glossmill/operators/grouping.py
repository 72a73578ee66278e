"""Leakage-free splits by group, balanced over strata.

Groups are reduced to counts per stratum, spread over hash buckets of bounded size, and each bucket assigns its groups
greedily to the fold that then lacks them most.  Buckets are alike by hashing, so the folds are balanced over all, and
no task ever holds more than about ``BUCKET_GROUPS`` groups.

Defined cases: null groups are one group, null strata one stratum; a group is never divided; fewer groups than folds
leave folds empty; ties go to the smaller fold number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_GROUPS = 20_000


def stratified_group_folds(df: DataFrame, group: str, stratum: str, folds: int, seed: int = 42) -> DataFrame:
    """(group, fold): the fold of every group."""
    counts = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    n_groups = counts.agg(F.countDistinct("g").alias("k")).first()["k"]
    buckets = max(1, -(-n_groups // BUCKET_GROUPS))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "g"), F.lit(buckets)).cast("int")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="g", columns="s", values="n", aggfunc="sum", fill_value=0).sort_index()
        m = wide.to_numpy(dtype=float)
        total = m.sum(axis=0)
        order = np.lexsort((np.arange(len(m)), -m.sum(axis=1), -m.std(axis=1)))
        filled = np.zeros((folds, m.shape[1]))
        out = np.empty(len(m), dtype=np.int32)
        for i in order:
            trial = (filled[None, :, :] + np.eye(folds)[:, :, None] * m[i]) / np.maximum(total, 1)
            spread = trial.std(axis=1).mean(axis=1)
            size = filled.sum(axis=1)
            out[i] = np.lexsort((np.arange(folds), size, np.round(spread, 12)))[0]
            filled[out[i]] += m[i]
        return pd.DataFrame({group: wide.index, "fold": out})

    return counts.withColumn("b", bucket).groupBy("b").applyInPandas(assign, f"`{group}` string, fold int")


def three_way_split(df: DataFrame, group: str, stratum: str, seed: int = 42) -> DataFrame:
    """(group, split): test is one of five folds, dev one of eight of what is left."""
    outer = stratified_group_folds(df, group, stratum, 5, seed)
    named = df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("")))
    test = outer.where("fold = 0").select(group)
    rest = named.join(test.withColumnRenamed(group, "_t"), F.col("_g") == F.col("_t"), "left_anti")
    inner = stratified_group_folds(rest.select(F.col("_g").alias(group), stratum), group, stratum, 8, seed + 100_003)
    other = inner.select(group, F.when(F.col("fold") == 0, "dev").otherwise("train").alias("split"))
    return test.select(group, F.lit("test").alias("split")).unionByName(other)


def split_manifest(df: DataFrame, split: str, group: str, stratum: str) -> DataFrame:
    """(split, stratum, n_rows, n_groups)."""
    return df.groupBy(split, stratum).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))
