"""Pixels to runs, and runs that touch in neighbouring rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Columns of a block: runs meet inside a block, so a row with very many runs is no single join key.
BLOCK = 1024
#: The same for points that are looked up in runs: a block has at most half as many runs.
LOOKUP_BLOCK = 256


def runs_of_pixels(pixels: DataFrame, width: int, tile: int | None = None) -> DataFrame:
    """Maximal horizontal runs (image_id, run_id, r, s, e) of distinct pixels; with a tile size, runs end at tiles."""
    parts = ["image_id", "r"] + (["tile"] if tile else [])
    at = pixels.withColumn("tile", F.floor(F.col("c") / tile)) if tile else pixels
    island = F.col("c") - F.row_number().over(Window.partitionBy(*parts).orderBy("c"))
    runs = at.withColumn("island", island).groupBy(*parts, "island").agg(F.min("c").alias("s"), F.max("c").alias("e"))
    return runs.select("image_id", (F.col("r").cast("long") * width + F.col("s")).alias("run_id"), "r", "s", "e")


def touching(runs: DataFrame, connectivity: int, carried: list[str]) -> DataFrame:
    """Pairs of runs that touch in neighbouring rows, the upper as r_a, s_a, e_a, the lower as r_b, s_b, e_b, each with the
    carried columns; 8-connectivity also touches at corners. A pair may occur once for each block that both reach."""
    reach = 1 if connectivity == 8 else 0
    cut = runs.withColumn("block", F.explode(F.sequence(F.floor((F.col("s") - reach) / BLOCK), F.floor((F.col("e") + reach) / BLOCK))))
    side = lambda n, row: cut.select("image_id", "block", row.alias("row"), *(F.col(c).alias(f"{c}_{n}") for c in ("r", "s", "e", *carried)))
    near = (F.col("s_a") <= F.col("e_b") + reach) & (F.col("s_b") <= F.col("e_a") + reach)
    return side("a", F.col("r") + 1).join(side("b", F.col("r")), ["image_id", "block", "row"]).filter(near)


def adjacent_runs(runs: DataFrame, connectivity: int = 4) -> DataFrame:
    """Pairs (image_id, a, b) of runs that touch in neighbouring rows."""
    return touching(runs, connectivity, ["run_id"]).select("image_id", F.col("run_id_a").alias("a"), F.col("run_id_b").alias("b")).distinct()


def lookup(runs: DataFrame, points: DataFrame) -> DataFrame:
    """The points (image_id, r, c and other columns) that lie in a run, each with run_id.

    Runs are cut at blocks of columns and points fall into one, so both meet on (image, row, block): a row of very many runs and
    points is many keys, and a block compares at most its own width. Runs must be disjoint; repeated points are kept."""
    cut = runs.select("image_id", "r", F.explode(F.sequence(F.floor(F.col("s") / LOOKUP_BLOCK), F.floor(F.col("e") / LOOKUP_BLOCK))).alias("block"), "run_id", F.col("s").alias("run_s"), F.col("e").alias("run_e"))
    placed = points.withColumn("block", F.floor(F.col("c") / LOOKUP_BLOCK))
    return placed.join(cut, ["image_id", "r", "block"]).filter("c between run_s and run_e").drop("block", "run_s", "run_e")
