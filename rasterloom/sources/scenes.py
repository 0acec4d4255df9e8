"""Scenes: rectangles, squares, discs, walks, packed blocks and organic blobs, as rectangles, runs or pixels.

Rectangles stay rectangles as long as possible: runs come from them row by row, so a scene of 81 million pixels is a
few hundred thousand rows. Sequential recipes (walks, packing, growth) are made in Python, a
group for each walk, strip of a packed scene or cell of an organic one."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rasterloom.operators.components import written

RECT = "image_id long, r0 long, c0 long, h long, w long"
PIXEL = "image_id long, r long, c long"


def clip(rects: DataFrame, height: int, width: int) -> DataFrame:
    """Rectangles cut to the canvas; those outside are dropped."""
    top, left = F.greatest("r0", F.lit(0)), F.greatest("c0", F.lit(0))
    cut = rects.select("image_id", top.alias("r0"), left.alias("c0"), (F.least(F.col("r0") + F.col("h"), F.lit(height)) - top).alias("h"), (F.least(F.col("c0") + F.col("w"), F.lit(width)) - left).alias("w"))
    return cut.filter("h > 0 and w > 0")


def pixels_of_rects(rects: DataFrame) -> DataFrame:
    """The pixels of the union of rectangles, each once: rows are merged as intervals, so pixels are spelt out as the last step and no
    task ever holds them. The rows are dealt to as many partitions as shuffles have, since they are few bytes for their pixels."""
    n = int(rects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _merged(_rows_of_rects(rects).repartition(n, "image_id", "r")).select("image_id", "r", F.explode(F.sequence("s", "e")).alias("c"))


def runs_of_rects(rects: DataFrame, width: int) -> DataFrame:
    """Maximal runs (image_id, run_id, r, s, e) of the union of rectangles, merged as intervals row by row."""
    return _merged(_rows_of_rects(rects)).select("image_id", (F.col("r") * width + F.col("s")).alias("run_id"), "r", "s", "e")


def _rows_of_rects(rects: DataFrame) -> DataFrame:
    """(image_id, r, s, e) of each row of each rectangle."""
    return rects.select("image_id", F.explode(F.sequence(F.col("r0"), F.col("r0") + F.col("h") - 1)).alias("r"), F.col("c0").alias("s"), (F.col("c0") + F.col("w") - 1).alias("e"))


def _merged(rows: DataFrame) -> DataFrame:
    """The intervals (image_id, r, s, e) of each row, those that overlap or adjoin as one."""
    row = Window.partitionBy("image_id", "r").orderBy("s", "e")
    reach = F.max("e").over(row.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
    part = fresh.withColumn("part", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("image_id", "r", "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("image_id", "r", "s", "e")


def centred_square(spark: SparkSession, height: int, width: int, side: int, image_id: int = 0) -> DataFrame:
    """One square [size/2 - side/2, size/2 + side/2) in the middle."""
    r0, c0 = height // 2 - side // 2, width // 2 - side // 2
    return clip(spark.createDataFrame([(image_id, r0, c0, side // 2 * 2, side // 2 * 2)], RECT), height, width)


def rectangle(spark: SparkSession, r0: int, c0: int, h: int, w: int, image_id: int = 0) -> DataFrame:
    return spark.createDataFrame([(image_id, r0, c0, h, w)], RECT)


def random_rectangles(spark: SparkSession, size: int, n: int, low: int, high: int, seed: int = 0, image_id: int = 0) -> DataFrame:
    """n rectangles drawn as column, row, width, height from NumPy's legacy generator, clipped to the canvas."""
    rng = np.random.RandomState(seed)
    drawn = [(rng.randint(0, size), rng.randint(0, size), rng.randint(low, high), rng.randint(low, high)) for _ in range(n)]
    rects = [(image_id, int(y), int(x), int(h), int(w)) for x, y, w, h in drawn]
    return clip(spark.createDataFrame(rects, RECT), size, size)


def pick(objects: DataFrame, widest: int, seed: int) -> DataFrame:
    """One of the objects (column w) of at most the given width, by Spark's generator with a fixed seed."""
    return objects.filter(F.col("w") <= widest).orderBy(F.rand(seed)).limit(1)


def discs(centres: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels with dx^2 + dy^2 <= radius^2 over the half-open box. centres: image_id, r, c, radius."""
    box = centres.withColumn("dr", F.explode(F.sequence(-F.col("radius"), F.col("radius") - 1)))
    box = box.withColumn("dc", F.explode(F.sequence(-F.col("radius"), F.col("radius") - 1)))
    inside = box.filter(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc") <= F.col("radius") * F.col("radius"))
    out = inside.select("image_id", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    return out.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).distinct()


def random_walks(walks: DataFrame, height: int, width: int, steps: int, radius: int = 60) -> DataFrame:
    """walks: image_id, walk, r, c, seed. A step is kept if it stays on the canvas and strictly within the radius."""

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        moves = np.random.default_rng(int(row.seed)).integers(0, 4, steps)
        r, c, seen = int(row.r), int(row.c), {(int(row.r), int(row.c))}
        for m in moves:
            a, b = r + (1, -1, 0, 0)[m], c + (0, 0, 1, -1)[m]
            if 0 <= a < height and 0 <= b < width and (a - row.r) ** 2 + (b - row.c) ** 2 < radius**2:
                r, c = a, b
                seen.add((r, c))
        return pd.DataFrame([(row.image_id, a, b) for a, b in seen], columns=["image_id", "r", "c"]).astype("int64")

    return walks.groupBy("image_id", "walk").applyInPandas(walk, PIXEL).distinct()


def packed_blocks(scenes: DataFrame, size: int, largest: int = 40, pad: int = 3, strip: int = 256) -> DataFrame:
    """Squares of random side 1..largest, placed greedily in scan order wherever one fits with `pad` pixels to all others and
    to the edge of the canvas. scenes: image_id, seed. Runs a job.

    Strips of columns are packed side by side, first those of even number, then the others around what reaches into them; squares
    do not cross strips. At each free pixel the side is drawn from those that fit. A column is blocked down to the row under the last square
    near it, which is all that squares of the own strip need, since they come in scan order; those of the neighbours are a mask."""
    n = max(1, -(-(size - 2 * pad) // strip))

    def pack(rng: np.random.Generator, low: int, wide: int, blocked: np.ndarray) -> list[tuple]:
        out, free_from = [], np.zeros(wide, np.int64)  # the first row in which each column is free
        for r in range(pad, size - pad):
            taken, c = (free_from > r) | blocked[r], 0
            while c < wide:
                if taken[c]:
                    free = ~taken[c:]
                    if not free.any():
                        break
                    c += int(free.argmax())
                ahead = taken[c : c + min(largest, size - pad - r)]
                most = int(ahead.argmax()) if ahead.any() else len(ahead)
                while blocked[r : r + most, c : c + most].any():
                    most -= 1
                side = int(rng.integers(1, most + 1))
                out.append((r, low + c, side, side))
                beside = slice(max(0, c - pad), c + side + pad)
                np.maximum(free_from[beside], r + side + pad, out=free_from[beside])
                taken[beside] = True
                c += side + pad
        return out

    def place(key: tuple, scene: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if scene.empty:
            return pd.DataFrame([], columns=["image_id", "strip", "r0", "c0", "h", "w"]).astype("int64")
        number = int(key[1])
        low = pad + number * strip
        wide = min(strip, size - pad - low)
        blocked = np.zeros((size, wide), bool)
        for x in around.itertuples(index=False):
            blocked[max(0, x.r0 - pad) : x.r0 + x.h + pad, max(0, x.c0 - pad - low) : max(0, x.c0 + x.w + pad - low)] = True
        rows = pack(np.random.default_rng([int(scene.seed.iloc[0]), number]), low, wide, blocked)
        return pd.DataFrame([(key[0], number, *x) for x in rows], columns=["image_id", "strip", "r0", "c0", "h", "w"]).astype("int64")

    strips = scenes.select("image_id", "seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("strip"))
    schema = f"image_id long, strip long, {RECT.partition(', ')[2]}"

    def packed(part: DataFrame, around: DataFrame) -> DataFrame:
        return part.groupBy("image_id", "strip").cogroup(around.groupBy("image_id", "strip")).applyInPandas(place, schema)

    none = scenes.sparkSession.createDataFrame([], schema)
    first = written(packed(strips.filter("strip % 2 = 0"), none))
    reach = first.filter((F.col("c0") - pad < pad + F.col("strip") * strip) | (F.col("c0") + F.col("w") + pad > pad + (F.col("strip") + 1) * strip))
    beside = reach.withColumn("strip", F.explode(F.array(F.col("strip") - 1, F.col("strip") + 1)))
    rest = packed(strips.filter("strip % 2 = 1"), beside)
    return first.unionByName(rest).drop("strip")


def grown(rng: np.random.Generator, r0: int, c0: int, radius: int, height: int, width: int, taken: np.ndarray | None = None) -> set[tuple[int, int]]:
    """A blob from one pixel, first in, first out: a pixel's free 4-neighbours join with a chance of 1 - (its distance
    over the radius) ** 1.5, until a drawn size is met. Empty when it stays below the least size that could be drawn."""
    most = int(np.pi * radius**2 * rng.uniform(0.4, 0.9))
    least = max(5, int(0.3 * most))
    goal = int(rng.integers(least, max(least, most) + 1))
    body, edge = {(r0, c0)}, deque([(r0, c0)])
    while edge and len(body) < goal:
        r, c = edge.popleft()
        chance = 1 - (max(abs(r - r0), abs(c - c0)) / radius) ** 1.5
        for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if len(body) < goal and 0 <= a < height and 0 <= b < width and (a, b) not in body and (taken is None or not taken[a, b]) and rng.random() < chance:
                body.add((a, b))
                edge.append((a, b))
    return body if len(body) >= least else set()


def organic_blobs(seeds: DataFrame, height: int, width: int) -> DataFrame:
    """Blobs grown from seeds (image_id, blob, r, c, radius, seed), each by itself; too small ones are dropped."""

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        body = grown(np.random.default_rng(int(row.seed)), int(row.r), int(row.c), int(row.radius), height, width)
        return pd.DataFrame([(row.image_id, a, b) for a, b in body], columns=["image_id", "r", "c"]).astype("int64")

    return seeds.groupBy("image_id", "blob").applyInPandas(grow, PIXEL).distinct()


#: A blob as a row: its number in its scene, the phase and order in which it was drawn, its seed, its runs.
BODY = "image_id long, blob long, phase int, number long, r long, c long, rs array<long>, ss array<long>, es array<long>"


def organic_bodies(scenes: DataFrame, height: int, width: int, target: int, separation: int = 20, radius: tuple[int, int] = (5, 100), tries: int = 20) -> DataFrame:
    """Up to `target` blobs a scene (image_id, seed) as rows (BODY), with at most tries * target attempts. Runs jobs.

    A seed has no pixel of an earlier blob within `separation`, and no blob grows into another. The canvas is cut into
    cells of at least twice the largest radius and the separation, dealt to four phases like the fields of a chessboard, so that
    cells of one phase can't reach each other; each cell is a group that knows the earlier blobs near it, and has its share of the
    target and the attempts by its area."""
    reach = radius[1] + separation
    cell = max(512, 2 * radius[1] + separation + 1)
    low, high, right = reach, max(reach + 1, height - reach), max(reach + 1, width - reach)  # where seeds lie
    long = lambda n: F.lit(n).cast("long")
    cells = scenes.select("image_id", "seed", F.explode(F.sequence(long(0), long((height - 1) // cell))).alias("strip"))
    cells = cells.select("*", F.explode(F.sequence(long(0), long((width - 1) // cell))).alias("block"))
    ahead = lambda n, top: F.least(F.greatest(n * cell, F.lit(low)), F.lit(top)) - low
    a0, a1, b0, b1 = ahead(F.col("strip"), high), ahead(F.col("strip") + 1, high), ahead(F.col("block"), right), ahead(F.col("block") + 1, right)
    before, after = a0 * (right - low) + (a1 - a0) * b0, a0 * (right - low) + (a1 - a0) * b1
    share = lambda area: F.floor(area * target / ((high - low) * (right - low)))
    cells = cells.withColumns({"quota": share(after) - share(before), "phase": (F.col("strip") % 2 * 2 + F.col("block") % 2).cast("int")}).filter("quota > 0")
    across = (width - 1) // cell + 1

    def draw(key: tuple, own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in own.itertuples(index=False):
            r0, c0 = max(0, x.strip * cell - reach), max(0, x.block * cell - reach)
            r1, c1 = min(height, (x.strip + 1) * cell + reach), min(width, (x.block + 1) * cell + reach)
            taken = np.zeros((r1 - r0, c1 - c0), bool)
            for rs, ss, es in zip(around["rs"], around["ss"], around["es"]):
                for r, s, e in zip(rs, ss, es):
                    if r0 <= r < r1 and e >= c0:
                        taken[r - r0, max(0, s - c0) : max(0, e + 1 - c0)] = True
            rng, made = np.random.default_rng([int(x.seed), int(x.strip), int(x.block)]), 0
            rows, columns = (max(x.strip * cell, low), min((x.strip + 1) * cell, high)), (max(x.block * cell, low), min((x.block + 1) * cell, right))
            for _ in range(tries * int(x.quota)):
                if made == x.quota:
                    break
                r, c = int(rng.integers(*rows)) - r0, int(rng.integers(*columns)) - c0
                if taken[max(0, r - separation) : r + separation + 1, max(0, c - separation) : c + separation + 1].any():
                    continue
                body = grown(rng, r, c, int(rng.integers(radius[0], radius[1] + 1)), r1 - r0, c1 - c0, taken)
                if body:
                    at = np.array(sorted(body))
                    taken[at[:, 0], at[:, 1]] = True
                    begins = np.flatnonzero((np.diff(at[:, 0], prepend=-1) != 0) | (np.diff(at[:, 1], prepend=-9) != 1))
                    ends = np.append(begins[1:] - 1, len(at) - 1)
                    number = (int(x.strip) * across + int(x.block)) * tries * target + made
                    out.append((x.image_id, number, x.phase, made, r + r0, c + c0, at[begins, 0] + r0, at[begins, 1] + c0, at[ends, 1] + c0))
                    made += 1
        return pd.DataFrame(out, columns=["image_id", "blob", "phase", "number", "r", "c", "rs", "ss", "es"]).astype({k: "int64" for k in ("image_id", "blob", "number", "r", "c")} | {"phase": "int32"})

    at = ["image_id", "strip", "block"]
    done = scenes.sparkSession.createDataFrame([], BODY)
    for phase in range(4):
        span = lambda low, high, size: F.explode(F.sequence(F.greatest(F.floor((low - reach) / cell), F.lit(0)), F.floor((high + reach) / cell)))
        near = done.withColumn("strip", span(F.array_min("rs"), F.array_max("rs"), height)).withColumn("block", span(F.array_min("ss"), F.array_max("es"), width))
        now = cells.filter(F.col("phase") == phase)
        made = now.groupBy(*at).cogroup(near.join(now.select(*at), at, "left_semi").groupBy(*at)).applyInPandas(draw, BODY)
        done = done.unionByName(written(made))
    return done


def organic_scenes(scenes: DataFrame, height: int, width: int, target: int, separation: int = 20, radius: tuple[int, int] = (5, 100), tries: int = 20) -> DataFrame:
    """(image_id, blob, r, c): the pixels of organic_bodies()."""
    made = organic_bodies(scenes, height, width, target, separation, radius, tries)
    runs = made.select("image_id", "blob", F.explode(F.arrays_zip("rs", "ss", "es")).alias("x"))
    return runs.select("image_id", "blob", F.col("x.rs").alias("r"), F.explode(F.sequence("x.ss", "x.es")).alias("c"))
