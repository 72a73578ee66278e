"""Readers and writers with fixed conventions: CSV with quoted newlines, JSON, JSON lines, text folders, file hashes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, missing_ok: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Header, UTF-8 with or without BOM, quoted newlines, every cell a string, empty cells ''; names and cells trimmed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema or T.StructType([]))
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', nullValue="\u0000")
    if not df.columns:
        raise ValueError(f"{path} has no header")
    return df.select(*[F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"(?U)^\s+|\s+$", "").alias(c.strip().lstrip("﻿")) for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None, single: bool = False) -> bool:
    """Fixed or own header; nothing is written for an empty frame.  ``single`` gives one ordered file."""
    out = df.select(*columns) if columns else df
    if out.isEmpty():
        return False
    out = out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])
    if single:
        out = out.repartition(1).sortWithinPartitions(*(order or out.columns))
    elif order:
        out = out.sort(*order)
    out.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, lineSep="\n", emptyValue="")
    return True


def read_json(spark: SparkSession, path: str, list_keys: tuple[str, ...] = ()) -> DataFrame:
    """A JSON document; with ``list_keys``, the rows of the first list found under them, or of a bare list."""
    df = spark.read.json(path, multiLine=True)
    for k in list_keys:
        if k in df.columns:
            return df.select(F.explode(k).alias("r")).select("r.*")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str], sources: list[str] | None = None, source: str = "source_id") -> DataFrame:
    """JSON lines of the wanted sources; a record without a required key is an error when it is read."""
    df = spark.read.schema(schema).json(path)
    if sources:
        df = df.where(F.col(source).isin(sources))
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"record without {c}"))))
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_report(report: dict, path: str) -> None:
    """A small report: pretty, non-ASCII kept, trailing newline."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(report, ensure_ascii=False, indent=2) + "\n")


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> str:
    """A report table; only for aggregates of bounded size."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).orderBy(*order).collect()
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) from files named ``page-<n>.txt``."""
    df = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return df.select(F.try_to_number(F.regexp_extract("file", r"page-(\d+)\.txt$", 1), F.lit("999999999")).cast("int").alias("page"), F.col("value").alias("text"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under a path."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
