"""Tiles: blobs found in passes over growing tiles, their tiers and states, and pixels on tile frames.

The passes work on runs. The first labels what lies inside small tiles; blobs that touch no frame are done. Of the others only
the pieces on frames go on to the next, larger tiles, whose frames lie on those of the smaller, and join there;
what the last pass leaves open is joined over the whole image. Frames are counted by arithmetic on row, start and
end of a run, so no pixel is spelt out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from rasterloom.operators.components import border_links, counted, joined, label_runs, labelled_pieces, merged_labels, touching_pairs, written

TIERS = (100, 400, 800)


def on_frame_row(size: int, r="r") -> Column:
    return (F.col(r) % size).isin(0, size - 1)


def frame_columns(size: int, s="s", e="e") -> Column:
    """Columns of a run that are the first or the last of a tile."""
    s, e = F.col(s), F.col(e)
    both = F.floor(e / size) - F.floor((s - 1) / size) + F.floor((e + 1) / size) - F.floor(s / size)
    return both if size > 1 else e - s + 1


def frame_pixels(size: int) -> Column:
    """Pixels of a run (r, s, e) on the frames of its size x size tiles."""
    return F.when(on_frame_row(size), F.col("e") - F.col("s") + 1).otherwise(frame_columns(size)).cast("long")


def first_frame_column(size: int) -> Column:
    """Column of a run's first pixel on a tile frame, null without one."""
    at = F.when(on_frame_row(size) | (F.col("s") % size == 0), F.col("s")).otherwise(F.col("s") + size - 1 - F.col("s") % size)
    return F.when(at <= F.col("e"), at)


def layer_counts(runs: DataFrame, size: int) -> DataFrame:
    """(layer, pixels): pixels of disjoint runs by their distance from the frame of their size x size tile.

    Runs are summed by the layer of their row into counts of whole widths and steps at the columns where the
    rest of a run begins and ends, two or four for a run; the columns are laid out last, at most size for each of size / 2 rows."""
    i = F.col("r") % size
    row = F.least(i, size - 1 - i)
    long, begin = F.col("e") - F.col("s") + 1, F.col("s") % size
    rest = long % size
    end = begin + rest
    step = lambda at, n: F.struct(at.cast("long").alias("at"), n.cast("long").alias("n"))
    steps = F.array(step(F.lit(0), F.floor(long / size)), step(begin, F.when(rest > 0, 1).otherwise(0)), step(F.least(end, F.lit(size)), F.when(rest > 0, -1).otherwise(0)), step(F.lit(0), F.when(end > size, 1).otherwise(0)), step(F.greatest(end - size, F.lit(0)), F.when(end > size, -1).otherwise(0)))
    summed = runs.select(row.alias("row"), F.explode(F.filter(steps, lambda x: x.n != 0)).alias("x")).groupBy("row", F.col("x.at").alias("at")).agg(F.sum("x.n").alias("n"))
    by_row = summed.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("steps"))
    laid = by_row.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.coalesce(F.element_at("steps", j.cast("long")), F.lit(0)))).alias("column", "n"))
    covered = F.sum("n").over(Window.partitionBy("row").orderBy("column"))
    layer = F.least(F.col("row"), F.col("column"), size - 1 - F.col("column"))
    return laid.select(layer.cast("long").alias("layer"), covered.alias("n")).groupBy("layer").agg(F.sum("n").alias("pixels")).filter("pixels > 0")


def _on_border(size: int) -> Column:
    return on_frame_row(size) | (F.col("s") % size == 0) | ((F.col("e") + 1) % size == 0)


def _joined_in_tiles(border: DataFrame, size: int, connectivity: int) -> DataFrame:
    """(image_id, label, onto): labels of border pieces (image_id, label, r, s, e) that touch inside a size x size tile, and
    the smallest they are joined to there."""
    reach = int(connectivity == 8)

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "s"])
        r, s, e = ((rows[c] - o).to_numpy(np.int64) for c, o in (("r", key[1] * size), ("s", key[2] * size), ("e", key[2] * size)))
        names, label = np.unique(rows["label"].to_numpy(), return_inverse=True)
        up, down = touching_pairs(r, s, e, reach, size)
        along = np.flatnonzero((r[1:] == r[:-1]) & (s[1:] == e[:-1] + 1))
        onto = joined(len(names), label[np.concatenate([up, along])], label[np.concatenate([down, along + 1])])
        return pd.DataFrame({"image_id": key[0], "label": names, "onto": names[onto]})

    placed = border.withColumns({"strip": F.floor(F.col("r") / size), "block": F.floor(F.col("s") / size)})
    return placed.groupBy("image_id", "strip", "block").applyInPandas(join, "image_id long, label long, onto long")


def tier_passes(runs: DataFrame, connectivity: int = 4, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """All blobs of disjoint runs (image_id, run_id, r, s, e) by passes over tiles; runs jobs when called.

    Returns image_id, blob_id, area, tile_tier (size of the first pass whose frames the blob doesn't touch, null if all
    are touched), frame_pixels and frame_r, frame_c (number and first pixel on the frames of the smallest tiles). Each size
    must be a multiple of the one before. What a pass puts off (`put_off_<size>`) and hands on as pieces
    (`border_pieces_<size>`) is counted by the jobs that write it."""
    if any(b % a for a, b in zip(tiers, tiers[1:])):
        raise ValueError(f"each tile size must be a multiple of the one before: {tiers}")
    small = tiers[0]
    pieces = written(labelled_pieces(runs, connectivity, (small, small)))
    measures = [F.sum(F.col("e") - F.col("s") + 1).alias("area"), F.sum(frame_pixels(small)).alias("frame_pixels"), F.min(F.when(first_frame_column(small).isNotNull(), F.struct(F.col("r").alias("r"), first_frame_column(small).alias("c")))).alias("first")]
    measures += [F.max((frame_pixels(t) > 0).cast("int")).alias(f"on_{t}") for t in tiers]
    blobs = pieces.groupBy("image_id", F.col("local").alias("label")).agg(*measures)
    border = pieces.filter(_on_border(small)).select("image_id", F.col("local").alias("label"), "r", "s", "e")
    again = [F.sum("area").alias("area"), F.sum("frame_pixels").alias("frame_pixels"), F.min("first").alias("first"), *(F.max(f"on_{t}").alias(f"on_{t}") for t in tiers)]
    done = []

    def moved(table: DataFrame, onto: DataFrame) -> DataFrame:
        return table.join(onto, ["image_id", "label"], "left").withColumn("label", F.coalesce("onto", "label")).drop("onto")

    for size, larger in zip(tiers, (*tiers[1:], None)):
        seen = Observation()
        blobs = written(blobs.observe(seen, F.count_if(F.col(f"on_{size}") == 1).alias("put_off")))
        counted(f"put_off_{size}", seen.get["put_off"])
        done.append(blobs.filter(F.col(f"on_{size}") == 0).withColumn("tile_tier", F.lit(size)))
        blobs = blobs.filter(F.col(f"on_{size}") == 1)
        seen = Observation()
        border = written(border.filter(_on_border(size)).observe(seen, F.count(F.lit(1)).alias("n")))
        counted(f"border_pieces_{size}", seen.get["n"])
        if larger:
            onto = written(_joined_in_tiles(border, larger, connectivity))
            blobs = moved(blobs, onto).groupBy("image_id", "label").agg(*again)
            border = moved(border, onto)
    last = tiers[-1]
    links = border_links(border.select("image_id", F.col("label").alias("local"), "r", "s", "e", F.col("r").alias("run_id"), F.col("s").alias("piece")), connectivity, (last, last))
    onto = merged_labels(links).select("image_id", F.col("local").alias("label"), F.col("root").alias("onto"))
    done.append(moved(blobs, onto).groupBy("image_id", "label").agg(*again).withColumn("tile_tier", F.lit(None).cast("int")))
    names = ["image_id", F.col("label").alias("blob_id"), "area", "tile_tier", "frame_pixels", F.col("first.r").alias("frame_r"), F.col("first.c").alias("frame_c")]
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select(*names)


def pass_counts(passes: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(tile_size, done, put_off): the blobs that a pass over tiles of a size finds whole, and those that it puts off."""
    tier = F.coalesce("tile_tier", F.lit(tiers[-1] + 1))
    per = passes.select(tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))
    sizes = F.explode(F.array(*map(F.lit, tiers))).alias("tile_size")
    return per.select("tier", "n", sizes).groupBy("tile_size").agg(F.coalesce(F.sum(F.when(F.col("tier") == F.col("tile_size"), F.col("n"))), F.lit(0)).alias("done"), F.coalesce(F.sum(F.when(F.col("tier") > F.col("tile_size"), F.col("n"))), F.lit(0)).alias("put_off"))


def states(tiers: DataFrame, first: int = TIERS[0], second: int = TIERS[1]) -> DataFrame:
    """1: done in the first pass; 2: put off by the first, done in the second; 3: put off by both."""
    state = F.when(F.col("tile_tier") == first, 1).when(F.col("tile_tier") == second, 2).otherwise(3)
    return tiers.withColumn("state", state)


def boundary_pixels(passes: DataFrame, size: int = TIERS[0]) -> DataFrame:
    """For each blob that touches a frame of the smallest tiles, its first frame pixel in scan order."""
    return passes.filter("frame_r is not null").select("image_id", "blob_id", F.col("frame_r").alias("r"), F.col("frame_c").alias("c"), F.lit(size).alias("tile_size"))


def without_frames(runs: DataFrame, size: int) -> DataFrame:
    """Runs cut at tiles, without the pixels on their frames."""
    inner = runs.filter(~on_frame_row(size)).withColumn("tile", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor(F.col("e") / size))))
    s, e = F.greatest(F.col("s"), F.col("tile") * size + 1), F.least(F.col("e"), F.col("tile") * size + size - 2)
    return inner.select("image_id", (F.col("run_id") + s - F.col("s")).alias("run_id"), "r", s.alias("s"), e.alias("e")).filter("s <= e")


def tile_components(runs: DataFrame, tile: int, connectivity: int = 4) -> tuple[DataFrame, DataFrame]:
    """(runs, labels) of components inside each tile with its frame pixels left out."""
    inner = without_frames(runs, tile)
    return inner, label_runs(inner, connectivity, (tile, tile), merge=False)
