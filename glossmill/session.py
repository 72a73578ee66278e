"""Session construction, table loading and lineage cutting.

``materialize`` writes an intermediate table as Parquet into the shared folder that the session names in
``spark.checkpoint.dir``.  Every executor can read it again, so a lost executor costs at most a re-run of the
tasks it was running.  Only where the setting is absent and the master is local (tests, notebooks) a temporary folder is
set, which goes when the process ends; on a cluster the missing setting is an error.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_KEY = "spark.checkpoint.dir"


def build_session(app: str = "glossmill", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the submitted configuration wins."""
    n = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master(f"local[{n}]").config("spark.driver.memory", "8g")
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; sets one only where the session names none and all tasks run on this machine."""
    path = spark.conf.get(SHARED_KEY, None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"{SHARED_KEY} names no folder that all executors of {master!r} share")
        folder = tempfile.mkdtemp(prefix="glossmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set(SHARED_KEY, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/glossmill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it; cuts the lineage."""
    return materialize_at(df, label)[0]


def materialize_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``materialize``, also giving the path for ``discard``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, str, int]:
    """As ``materialize_at``, also giving the number of rows, which reading the written footers tells."""
    out, path = materialize_at(df, label)
    return out, path, out.count()


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing will read again."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this library; call when no frame that reads them is in use any more."""
    discard(spark, f"{shared_dir(spark)}/glossmill")
