"""Staged tables: cut lineage in shared storage, and null-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def staging_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only where driver and tasks are one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` go to the writer.

    Later steps start from files that survive the loss of any executor, and the planner sees
    the measured file size, so it broadcasts the table only when it is small enough.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key matches a null key; the key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(
        Column.__and__, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Bring per-group statistics back to the rows of ``df``.

    ``stats`` is staged, so its true size decides between a broadcast and a shuffle join; a window
    over the group is avoided because one hot group would then sit in a single task.
    """
    return null_safe(df, stage(stats), keys, how)


def distinct_levels(df: DataFrame, column: str) -> list:
    """Sorted non-null levels of a column whose levels become columns or coefficients, hence go to the driver."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().toLocalIterator())
