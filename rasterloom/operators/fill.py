"""Seeded fill: the blobs that hold a seed, the visited ring, iterations and work distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.operators.components import label_runs
from rasterloom.operators.levels import OFFSETS, levels, levels_of_runs  # noqa: F401
from rasterloom.operators.runs import lookup, runs_of_pixels

def first_foreground(pixels: DataFrame) -> DataFrame:
    """The first pixel of each image in row-major order."""
    return pixels.groupBy("image_id").agg(F.min(F.struct("r", "c")).alias("p")).select("image_id", "p.r", "p.c")


def first_of_runs(runs: DataFrame) -> DataFrame:
    """The first pixel of each image in row-major order, from its runs."""
    return runs.groupBy("image_id").agg(F.min(F.struct("r", "s")).alias("p")).select("image_id", "p.r", F.col("p.s").alias("c"))


def seeded_runs(runs: DataFrame, seeds: DataFrame, connectivity: int) -> DataFrame:
    """The runs of the blobs whose runs hold a seed (image_id, r, c); a seed on background fills nothing."""
    labels = label_runs(runs, connectivity)
    held = lookup(runs, seeds.select("image_id", "r", "c")).select("image_id", "run_id")
    hit = labels.join(held, ["image_id", "run_id"], "left_semi").select("image_id", "blob_id").distinct()
    return runs.join(labels.join(hit, ["image_id", "blob_id"], "left_semi").select("image_id", "run_id"), ["image_id", "run_id"]).select(*runs.columns)


def pixels_of_runs(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", "r", F.explode(F.sequence("s", "e")).alias("c"))


def seed_blobs(pixels: DataFrame, seeds: DataFrame, width: int, connectivity: int) -> DataFrame:
    """The pixels of the blobs that hold a seed."""
    return pixels_of_runs(seeded_runs(runs_of_pixels(pixels, width), seeds, connectivity))


def frontier_sizes(reached: DataFrame) -> DataFrame:
    return reached.groupBy("image_id", "level").agg(F.count("*").alias("pixels"))


def checked_iterations(deepest: Column, check_every: int = 50, limit: int = 1_000_000) -> Column:
    """Iterations of a loop that looks for an empty frontier only now and then; deepest: the last level."""
    return F.least(F.lit(limit), (F.ceil((deepest + 1) / check_every) * check_every)).cast("long")


def _covered(parts: DataFrame) -> DataFrame:
    """Stretches (image_id, r, s, e, weight) of constant summed weight, of weighted stretches (image_id, r, s, e, weight)."""
    ends = parts.select("image_id", "r", F.col("s").alias("c"), "weight").union(parts.select("image_id", "r", F.col("e") + 1, -F.col("weight")))
    steps = ends.groupBy("image_id", "r", "c").agg(F.sum("weight").alias("step"))
    row = Window.partitionBy("image_id", "r").orderBy("c")
    return steps.select("image_id", "r", F.col("c").alias("s"), (F.lead("c").over(row) - 1).alias("e"), F.sum("step").over(row).alias("weight")).filter("weight > 0")


def _in_three_rows(runs: DataFrame, grow: int) -> DataFrame:
    """Each run in its own row and the two beside it, longer by `grow` at both ends."""
    wide = runs.select("image_id", "r", (F.col("s") - grow).alias("s"), (F.col("e") + grow).alias("e")).filter("s <= e")
    return wide.select("image_id", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)).alias("r"), "s", "e", F.lit(1).alias("weight"))


def visited_ring(runs: DataFrame, height: int, width: int) -> DataFrame:
    """The pixels of the runs with their 8-neighbours on the canvas: runs are grown, merged and only then spelt out."""
    grown = _in_three_rows(runs, 1).withColumns({"s": F.greatest(F.lit(0), F.col("s")), "e": F.least(F.lit(width - 1), F.col("e"))})
    return pixels_of_runs(_covered(grown.filter(F.col("r").between(0, height - 1))))


def edge_pixels(runs: DataFrame) -> DataFrame:
    """Foreground pixels with an 8-neighbour that is off the canvas or background: those not under shortened runs of all
    three rows."""
    own = runs.select("image_id", "r", "s", "e", F.lit(10).alias("weight"))
    return pixels_of_runs(_covered(_in_three_rows(runs, -1).union(own)).filter("weight between 10 and 12"))


def slice_plan(sizes: DataFrame, workers: int) -> DataFrame:
    """A level's queue in equal slices: items of a slice, workers that get one, and items of the last slice."""
    items = F.greatest(F.lit(1), F.ceil(F.col("pixels") / workers)).cast("long")
    out = sizes.withColumn("items", items).withColumn("busy", F.ceil(F.col("pixels") / F.col("items")).cast("long"))
    return out.withColumn("last_items", F.col("pixels") - (F.col("busy") - 1) * F.col("items"))


def chunk_plan(sizes: DataFrame, blocks: int, chunk: int, warps: int) -> DataFrame:
    """How a level's queue is dealt: chunks in all, to each block, and items per warp of the first and last block."""
    chunks = F.ceil(F.col("pixels") / chunk)
    out = sizes.withColumn("chunks", chunks.cast("long"))
    base, extra = F.floor(F.col("chunks") / blocks), F.col("chunks") % blocks
    first = F.when(F.col("chunks") >= blocks, base + F.when(extra > 0, 1).otherwise(0)).otherwise(1)
    return out.select(
        "image_id", "level", "pixels", "chunks", F.least(F.col("chunks"), F.lit(blocks)).cast("long").alias("busy_blocks"),
        first.cast("long").alias("chunks_first_block"), F.when(F.col("chunks") >= blocks, base).otherwise(0).cast("long").alias("chunks_last_block"),
        F.greatest(F.lit(1), F.ceil(F.least(first * chunk, F.col("pixels")) / warps)).cast("long").alias("items_per_warp"),
    )
