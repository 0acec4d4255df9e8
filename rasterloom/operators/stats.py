"""Sweep grids and the statistics of benchmark rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The sweep's parameters and its limits on threads.
BLOCKS, THREADS, CHUNKS = (24, 32, 40, 48, 72, 96), (64, 128, 256, 512), (16, 32, 64, 128)
MOST_PER_BLOCK, MOST_IN_ALL = 1024, 8192


def sweep_grid(spark: SparkSession, blocks=BLOCKS, threads=THREADS, chunks=CHUNKS) -> DataFrame:
    """All combinations within the limits on threads."""
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    grid = frame("blocks_per_grid", blocks).crossJoin(frame("threads_per_block", threads)).crossJoin(frame("chunk_size", chunks))
    return grid.filter((F.col("threads_per_block") <= MOST_PER_BLOCK) & (F.col("blocks_per_grid") * F.col("threads_per_block") <= MOST_IN_ALL))


def timed_runs(spark: SparkSession, make: Callable[[], DataFrame], repeats: int = 5, warm_ups: int = 1) -> DataFrame:
    """(run, seconds) of computing make() whole, after runs that aren't counted."""
    took = []
    for i in range(-warm_ups, repeats):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append((i, time.perf_counter() - began))
    return spark.createDataFrame(took[warm_ups:], "run int, seconds double")


def run_statistics(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, extremes and population deviation of repeated runs."""
    return df.groupBy(*keys).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(value).alias("deviation"))


def mean_runs(df: DataFrame, keys: list[str], numeric: list[str], first: list[str], order: str) -> DataFrame:
    """Repeated runs to one row: means of the numeric fields, the first run's value of the others."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric], *[F.min_by(c, order).alias(c) for c in first])


def best(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The row with the largest value; of equal ones the first in the given order."""
    return df.orderBy(F.desc(value), *order).limit(1)


def top(df: DataFrame, value: str, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(F.desc(value), *order).limit(n)


def first_and_last(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def used_workers(df: DataFrame, count: str, whole: int) -> DataFrame:
    """Workers that did anything, and their percentage."""
    return df.agg(F.count_if(F.col(count) > 0).alias("used"), (100.0 * F.count_if(F.col(count) > 0) / whole).alias("used_pct"))


def numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
