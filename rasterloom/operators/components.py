"""Connected components of runs: blob_id is the smallest linear index in the component.

Runs are cut at the borders of tiles, each tile is labelled by a task of its own, and only what touches a border goes on
to the rounds of joins that merge labels over tiles. An image may have any number of tiles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from rasterloom.operators.runs import lookup, runs_of_pixels, touching

#: Rows and columns of the tiles in which runs are labelled side by side.
TILE = (128, 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, a temporary one on a local master only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="spark-raster-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


#: Folders that this process has written in a shared folder.
_made: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    _made.append(f"{shared_folder(spark)}/raster-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder and read it back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the steps that this process has written; DataFrames that read them are lost. Returns their number."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


#: Counts that iterative operators have observed while they wrote their steps, by name, in order.
_counts: list[tuple[str, int]] = []


def counted(name: str, n: int) -> None:
    _counts.append((name, int(n)))


def counters() -> list[tuple[str, int]]:
    """What has been counted since the last call: (name, count) of each step, taken by the jobs that wrote it."""
    out = list(_counts)
    _counts.clear()
    return out


def label_runs(runs: DataFrame, connectivity: int = 4, tile: tuple[int, int] = TILE, merge: bool = True) -> DataFrame:
    """(image_id, run_id, blob_id) for every run. Runs jobs when called.

    tile: rows and columns of the tiles. Without merge, runs end at tiles and components too."""
    pieces = labelled_pieces(runs, connectivity, tile)
    if not merge:
        return pieces.select("image_id", "run_id", F.col("local").alias("blob_id"))
    pieces = written(pieces)
    roots = merged_labels(border_links(pieces, connectivity, tile))
    first = pieces.filter("piece = run_id").select("image_id", "run_id", "local")
    return first.join(roots, ["image_id", "local"], "left").select("image_id", "run_id", F.coalesce("root", "local").alias("blob_id"))


def touching_pairs(r: np.ndarray, s: np.ndarray, e: np.ndarray, reach: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of runs that touch in neighbouring rows; runs are in scan order, columns from 0 to width - 1."""
    wide = width + 4  # room for the reach
    low = np.searchsorted(r * wide + e + 2, (r + 1) * wide + s + 2 - reach)  # runs of the next row that end behind this one's start
    high = np.searchsorted(r * wide + s + 2, (r + 1) * wide + e + 2 + reach, side="right")
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(r)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that links a - b reach, for each: larger roots are hooked under smaller, then all paths shortened."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        live = la != lb
        a, b = a[live], b[live]
        np.minimum.at(lab, np.maximum(la, lb)[live], np.minimum(la, lb)[live])
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return lab


def labelled_pieces(runs: DataFrame, connectivity: int, tile: tuple[int, int]) -> DataFrame:
    """Runs cut at tiles: image_id, run_id, piece (linear index of its first pixel), r, s, e, local (the smallest piece of
    its component inside the tile)."""
    reach, width = int(connectivity == 8), tile[1]
    cut = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    left, right = F.greatest(F.col("s"), F.col("block") * width), F.least(F.col("e"), F.col("block") * width + width - 1)
    cut = cut.select("image_id", F.floor(F.col("r") / tile[0]).alias("strip"), "block", "run_id", (F.col("run_id") + left - F.col("s")).alias("piece"), "r", left.alias("s"), right.alias("e"))

    def label(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        r, s, e = ((rows[c] - o).to_numpy(np.int64) for c, o in (("r", key[1] * tile[0]), ("s", key[2] * width), ("e", key[2] * width)))
        lab = joined(len(r), *touching_pairs(r, s, e, reach, width))
        return rows.assign(local=rows["piece"].to_numpy()[lab])[["image_id", "run_id", "piece", "r", "s", "e", "local"]]

    return cut.groupBy("image_id", "strip", "block").applyInPandas(label, "image_id long, run_id long, piece long, r long, s long, e long, local long")


def border_links(pieces: DataFrame, connectivity: int, tile: tuple[int, int]) -> DataFrame:
    """(image_id, a, b): labels of pieces that touch over the border of a tile."""
    rows, columns = tile
    on = (F.col("r") % rows).isin(0, rows - 1) | (F.col("s") % columns == 0) | ((F.col("e") + 1) % columns == 0)
    border = pieces.filter(on)
    place = lambda r, s: F.struct(F.floor(F.col(r) / rows), F.floor(F.col(s) / columns))
    over = touching(border, connectivity, ["local"]).filter(place("r_a", "s_a") != place("r_b", "s_b")).select("image_id", F.col("local_a").alias("a"), F.col("local_b").alias("b"))
    after = border.select("image_id", "run_id", (F.col("piece") + F.col("e") - F.col("s") + 1).alias("piece"), F.col("local").alias("a"))
    along = after.join(border.select("image_id", "run_id", "piece", F.col("local").alias("b")), ["image_id", "run_id", "piece"]).select("image_id", "a", "b")
    return over.union(along).filter("a != b").distinct()


def merged_labels(links: DataFrame) -> DataFrame:
    """(image_id, local, root): the smallest label that links reach, for labels with a link to another.

    Alternating large-star and small-star steps, a written table a round; a hot label is pre-aggregated."""
    def step(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        """A written round, and its number and checksum of pairs, both taken while it is written."""
        seen = Observation()
        out = written(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)")).alias("h")))
        counted("label_links", seen.get["n"])
        return out, (seen.get["n"], seen.get["h"])

    (now, state), before = step(links.select("image_id", F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()), None

    def with_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("image_id", "u").agg(F.min("v").alias("m")).select("image_id", "u", F.least("u", "m").alias("m"))
        return pairs.join(least, ["image_id", "u"])

    while state[0] and state != before:
        before = state
        both = now.select("image_id", "u", "v").union(now.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large)
        now, state = step(small.select("image_id", "u", "m").union(small.select("image_id", "v", "m")).filter("u != m").select("image_id", "u", F.col("m").alias("v")).distinct())
    return now.select("image_id", F.col("u").alias("local"), F.col("v").alias("root"))


def blob_table(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, blob_id, area and bounding box of each blob."""
    return runs.join(labels, ["image_id", "run_id"]).groupBy("image_id", "blob_id").agg(
        F.sum(F.col("e") - F.col("s") + 1).alias("area"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("s").alias("c_min"), F.max("e").alias("c_max")
    )


def blobs(pixels: DataFrame, width: int, connectivity: int = 4) -> DataFrame:
    runs = runs_of_pixels(pixels, width)
    return blob_table(runs, label_runs(runs, connectivity))


def labelled_pixels(runs: DataFrame, labels: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """The pixels of each blob, with further columns of the labels on demand."""
    return runs.join(labels, ["image_id", "run_id"]).select("image_id", "blob_id", *(carried or []), "r", F.explode(F.sequence("s", "e")).alias("c"))


def ordinals(table: DataFrame) -> DataFrame:
    """object_id 1..n of each image's blobs in scan order, which is the order of blob_id.

    The rows are dealt out by ranges and numbered inside each; a small table adds what lies before a range. Runs a job."""
    at = ["image_id", "blob_id"]
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(table.repartitionByRange(n, *at).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("image_id", "range").agg(F.count("*").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy("image_id").orderBy("range")) - F.col("held")
    inside = F.row_number().over(Window.partitionBy("image_id", "range").orderBy("blob_id"))
    numbered = ranged.withColumn("inside", inside).join(counts.select("image_id", "range", ahead.alias("ahead")), ["image_id", "range"])
    return numbered.withColumn("object_id", (F.col("ahead") + F.col("inside")).cast("int")).select(*table.columns, "object_id")


def object_chunks(runs: DataFrame, labels: DataFrame, size: int = 10_000) -> DataFrame:
    """The points of each object in scan order as rows of bounded size; runs jobs when called.

    Returns image_id, object_id, blob_id, chunk, first (ordinal of its first point in the object, from 0), points and runs, an array of
    (first, r, s, e). A chunk has the runs that begin within the next `size` points, so under twice as many, since longer runs are cut.
    The runs are dealt out in ranges of their order and summed inside each; a small table adds what an object has before a range, so
    a blob of any size is many tasks."""
    at = ["image_id", "blob_id"]
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = runs.join(labels, ["image_id", "run_id"]).select(*at, "r", "e", F.explode(F.sequence(F.col("s"), F.col("e"), F.lit(size).cast("long"))).alias("s"))
    cut = cut.select(*at, "r", "s", F.least(F.col("e"), F.col("s") + size - 1).alias("e"))
    ranged = written(cut.repartitionByRange(n, *at, "r", "s").withColumn("range", F.spark_partition_id()))
    length = F.col("e") - F.col("s") + 1
    held = ranged.groupBy(*at, "range").agg(F.sum(length).alias("held"))
    ahead = held.select(*at, "range", (F.sum("held").over(Window.partitionBy(*at).orderBy("range")) - F.col("held")).alias("ahead"))
    inside = F.sum(length).over(Window.partitionBy(*at, "range").orderBy("r", "s")) - length
    placed = ranged.withColumn("inside", inside).join(ahead, [*at, "range"]).withColumn("first", F.col("ahead") + F.col("inside"))
    run = F.struct("first", "r", "s", "e")
    chunks = placed.groupBy(*at, F.floor(F.col("first") / size).alias("chunk")).agg(F.min("first").alias("first"), F.sum(length).alias("points"), F.array_sort(F.collect_list(run)).alias("runs"))
    return chunks.join(ordinals(labels.select(*at).distinct()), at).select("image_id", "object_id", "blob_id", "chunk", "first", "points", "runs")


def chunk_points(chunks: DataFrame) -> DataFrame:
    """(image_id, object_id, ordinal, r, c) of the points in chunks."""
    runs = chunks.select("image_id", "object_id", F.explode("runs").alias("x"))
    points = runs.select("image_id", "object_id", "x", F.explode(F.sequence("x.s", "x.e")).alias("c"))
    return points.select("image_id", "object_id", (F.col("x.first") + F.col("c") - F.col("x.s")).alias("ordinal"), "x.r", "c")


def object_summary(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, object_id, blob_id, number of points, column of the first and row of the last point in scan order."""
    per = runs.join(labels, ["image_id", "run_id"]).groupBy("image_id", "blob_id").agg(
        F.sum(F.col("e") - F.col("s") + 1).alias("points"), F.min(F.struct("r", "s")).alias("first"), F.max("r").alias("last_r")
    )
    return ordinals(per).select("image_id", "object_id", "blob_id", "points", F.col("first.s").alias("first_c"), "last_r")


def components_with_seeds(expansion: DataFrame, seeds: DataFrame, width: int, connectivity: int = 4) -> DataFrame:
    """Blobs of the expansion and seed pixels together that hold a seed: for variants whose two predicates differ."""
    runs = runs_of_pixels(expansion.union(seeds).distinct(), width)
    labels = label_runs(runs, connectivity)
    with_seed = labels.join(lookup(runs, seeds), ["image_id", "run_id"], "left_semi").select("image_id", "blob_id").distinct()
    return blob_table(runs, labels).join(with_seed, ["image_id", "blob_id"], "left_semi")
