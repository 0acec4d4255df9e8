"""Patch-by-patch scans of a canvas with a deterministic clock: all patches advance one step a tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def scan_clock(pixels: DataFrame, size: int, patch: int = 10, order: str = "row") -> DataFrame:
    """Adds worker (number of the patch; patches run down the rows first), step (place in the patch, by row or by
    anti-diagonal) and tick (1-based visit number: step by step, workers in turn)."""
    per = size // patch
    i, j = F.col("r") % patch, F.col("c") % patch
    worker = F.floor(F.col("c") / patch) * per + F.floor(F.col("r") / patch)
    step = i * patch + j if order == "row" else _diagonal(i, j, patch)
    out = pixels.withColumns({"worker": worker.cast("long"), "step": step.cast("long")})
    return out.withColumn("tick", F.col("step") * per * per + F.col("worker") + 1)


def _diagonal(i: Column, j: Column, n: int) -> Column:
    """Place of (i, j) when anti-diagonals are walked one after the other, each by rising i."""
    d = i + j
    before = F.when(d < n, d * (d + 1) / 2).otherwise(n * n - (2 * n - 1 - d) * (2 * n - d) / 2)
    return before + i - F.greatest(F.lit(0), d - n + 1)


def first_found(clocked: DataFrame) -> DataFrame:
    """found and the place of the foreground pixel with the smallest tick; the scan stops there."""
    one = clocked.groupBy("image_id").agg(F.min(F.struct("tick", "r", "c")).alias("p"))
    return one.select("image_id", F.lit(True).alias("found"), "p.r", "p.c", "p.tick")


def last_found(clocked: DataFrame) -> DataFrame:
    """A scan without an early stop: the last writer stays."""
    one = clocked.groupBy("image_id").agg(F.max(F.struct("tick", "r", "c")).alias("p"))
    return one.select("image_id", F.lit(True).alias("found"), "p.r", "p.c", "p.tick")
