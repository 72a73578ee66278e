"""Expectations that raise: row counts, uniqueness, domains, foreign keys, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ExpectationError(AssertionError):
    """A frame that is not what it has to be."""


def expect_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing, extra = set(columns) - set(df.columns), set(df.columns) - set(columns)
    if missing or extra:
        raise ExpectationError(f"columns missing {sorted(missing)}, not expected {sorted(extra)}")
    return df


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    got = df.count()
    if got != n:
        raise ExpectationError(f"{got} rows instead of {n}")
    return df


def expect_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(10).collect()
    if twice:
        raise ExpectationError(f"repeated keys: {[tuple(r[k] for k in keys) for r in twice]}")
    return df


def expect_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    odd = [r[0] for r in df.where(~F.col(column).isin(allowed)).select(column).distinct().limit(10).collect()]
    if odd:
        raise ExpectationError(f"{column} holds {odd}")
    return df


def expect_reference(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    gone = df.where(F.col(column).isNotNull()).join(other, df[column] == other[key], "left_anti").select(column).limit(10).collect()
    if gone:
        raise ExpectationError(f"{column} refers to nothing: {[r[0] for r in gone]}")
    return df


def exactly_one(df: DataFrame) -> dict:
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ExpectationError(f"{'no' if not rows else 'more than one'} row")
    return rows[0].asDict()
