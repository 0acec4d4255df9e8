"""Sizes, durations, occupancy and other report values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def bytes_text(n: Column, units: tuple[str, ...] = UNITS[:4]) -> Column:
    """Two decimals in the largest unit that leaves 1 or more."""
    out = F.format_string(f"%.2f {units[0]}", n.cast("double"))
    for i, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.2f {unit}", n / 1024**i)).otherwise(out)
    return out


def memory_text(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Three digits or so: no decimals from 100 on, one from 10 on, else two; from 1000 on in the next unit. Ties go to
    the even digit."""

    def text(size: Column, unit: str) -> Column:
        places = lambda k: F.format_string(f"%.{k}f {unit}", F.bround(size, k))
        return F.when(size >= 100, places(0)).when(size >= 10, places(1)).otherwise(places(2))

    out = text(n.cast("double"), units[0])
    for i, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1000 * 1024 ** (i - 1), text(n / 1024**i, unit)).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 0.001, F.format_string("%.3f ms", seconds * 1000))
        .when(seconds < 1, F.format_string("%.2f ms", seconds * 1000))
        .otherwise(F.format_string("%.2f s", seconds))
    )


def occupancy(threads: Column, blocks: Column, limit: int = 1536) -> Column:
    return threads * blocks / limit


def occupancy_class(share: Column) -> Column:
    return F.when(share >= 0.75, "high").when(share >= 0.5, "medium").otherwise("low")


def blocks_per_processor(threads: Column, shared_kb: Column, max_threads: int = 1536, max_blocks: int = 24, max_shared_kb: int = 100) -> Column:
    by_memory = F.when(shared_kb > 0, F.floor(max_shared_kb / shared_kb)).otherwise(max_blocks)
    return F.least(F.lit(max_blocks), F.floor(max_threads / threads), by_memory)


def queue_bytes(capacity: Column) -> Column:
    return capacity * 8


def work_per_warp(queued: Column, warps: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(queued / warps))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def engine_info(spark: SparkSession) -> DataFrame:
    """(name, value) of the session: version, master, parallelism and the settings that shape a plan."""
    sc = spark.sparkContext
    named = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")
    rows = [("version", spark.version), ("master", sc.master), ("parallelism", str(sc.defaultParallelism)), *((k, spark.conf.get(k)) for k in named)]
    return spark.createDataFrame(rows, "name string, value string")


def rate(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))
