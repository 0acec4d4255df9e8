"""Breadth-first levels of a seeded fill over a graph of tile borders.

Each tile is packed into one row, once. From it the shortest ways between its crossing cells, those with a neighbour over the
border, are taken, once; tiles that are all foreground need no such table. Levels then spread over the graph of crossing cells
by rounds of joins, in which only tiles that got a nearer entry take part, a row each; and one last pass inside the tiles
gives the pixels. No round reads or writes pixels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from rasterloom.operators.components import counted, written

OFFSETS = {4: [(1, 0), (-1, 0), (0, 1), (0, -1)], 8: [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]}
#: Rows and columns of a tile: its table has at most 16 entries for each of its pixels.
TILE = (64, 64)
#: Entries up to which the keys of the tiles that take part in a round are broadcast, 24 bytes each; more are joined.
BROADCAST = 200_000
#: Rounds after which what is known of the tiles is put together.
ROUNDS = 16
_AT = ["image_id", "strip", "block"]
_FAR = np.int64(1) << 52
_PLACE = "array<struct<r:bigint,c:bigint,level:bigint>>"


def packed_tiles(runs: DataFrame, seeds: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """A row for each tile with foreground: its runs with one pixel of what lies around it, by places inside that frame, and its seeds."""
    h, w = tile
    near = runs.withColumn("strip", F.explode(F.array_distinct(F.array(F.floor((F.col("r") - 1) / h), F.floor((F.col("r") + 1) / h)))))
    near = near.withColumn("block", F.explode(F.sequence(F.floor((F.col("s") - 1) / w), F.floor((F.col("e") + 1) / w))))
    r0, c0 = F.col("strip") * h - 1, F.col("block") * w - 1
    part = F.struct((F.col("r") - r0).cast("int").alias("r"), F.greatest(F.col("s") - c0, F.lit(0)).cast("int").alias("s"), F.least(F.col("e") - c0, F.lit(w + 1)).cast("int").alias("e"))
    own = F.col("r").between(r0 + 1, r0 + h) & (F.col("e") > c0) & (F.col("s") <= c0 + w)
    body = near.groupBy(*_AT).agg(F.collect_list(part).alias("runs"), F.max(own).alias("own")).filter("own").drop("own")
    placed = seeds.select("image_id", F.floor(F.col("r") / h).alias("strip"), F.floor(F.col("c") / w).alias("block"), "r", "c")
    return body.join(placed.groupBy(*_AT).agg(F.collect_set(F.struct("r", "c")).alias("seeds")), _AT, "left")


def _mask(runs, tile: tuple[int, int]) -> np.ndarray:
    """Foreground of a tile and the frame around it."""
    change = np.zeros((tile[0] + 2, tile[1] + 3), np.int32)
    r, s, e = (np.array([x[k] for x in runs]) for k in ("r", "s", "e"))
    np.add.at(change, (r, s), 1)
    np.add.at(change, (r, e + 1), -1)
    return change.cumsum(axis=1)[:, :-1] > 0


def _spread(inside: np.ndarray, sources: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Steps from each source to each place (-1: none), all sources at once; inside and places are flat."""
    size, n = len(inside), len(sources)
    far = np.full(n * size, -1, np.int32)
    seen = np.zeros(n * size, np.int32)
    now, level = np.arange(n) * size + sources, 0
    far[now] = 0
    closed = np.tile(~inside, n)
    while len(now):
        level += 1
        near = (now[:, None] + steps[None]).ravel()
        near = near[(far[near] < 0) & ~closed[near]]
        seen[near] = np.arange(len(near))
        now = near[seen[near] == np.arange(len(near))]  # each once
        far[now] = level
    return far.reshape(n, size)


def _from_known(inside: np.ndarray, places: np.ndarray, levels: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The level of each place, from places whose levels are known; _FAR where none leads."""
    far = np.full(len(inside), _FAR)
    np.minimum.at(far, places, levels)
    order = np.argsort(levels, kind="stable")
    places, levels = places[order], levels[order]
    now, at, level = np.zeros(0, np.int64), 0, -1
    while len(now) or at < len(levels):
        level = level + 1 if len(now) else int(levels[at])
        upto = np.searchsorted(levels, level, side="right")
        due = np.concatenate([now, places[at:upto]])
        at = upto
        due = np.unique(due[far[due] == level])
        near = (due[:, None] + steps[None]).ravel()
        near = np.unique(near[inside[near] & (far[near] > level + 1)])
        far[near] = level + 1
        now = near
    return far


def _shape(tile: tuple[int, int], connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps inside a flat frame, and which of its places are the tile's own."""
    wide = tile[1] + 2
    own = np.zeros((tile[0] + 2, wide), bool)
    own[1:-1, 1:-1] = True
    return np.array([i * wide + j for i, j in OFFSETS[connectivity]]), own.ravel()


def _metric(cells: np.ndarray, wide: int, connectivity: int) -> np.ndarray:
    """Steps between places of a tile that is all foreground."""
    r, c = np.abs(np.subtract.outer(cells // wide, cells // wide)), np.abs(np.subtract.outer(cells % wide, cells % wide))
    return np.maximum(r, c) if connectivity == 8 else r + c


def border_graph(body: DataFrame, tile: tuple[int, int], connectivity: int) -> DataFrame:
    """For each packed tile its crossing cells (places in the frame), the ways over the border from each (cell's number and
    pixel), the table of steps between the cells (null: all foreground), and from its seeds the levels of the cells."""
    steps, own = _shape(tile, connectivity)
    wide = tile[1] + 2

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                mask = _mask(row.runs, tile).ravel()
                inside, around = mask & own, mask & ~own
                places = np.flatnonzero(inside)
                over = places[:, None] + steps[None]
                crosses = around[over]
                held = crosses.any(axis=1)
                cells = places[held]
                ways = np.nonzero(crosses[held])
                to = over[held][ways]
                full = len(places) == tile[0] * tile[1]
                table = None if full else _spread(inside, cells, steps)[:, cells].astype("<i4").tobytes()
                start = None
                if row.seeds is not None:
                    at = np.array([(s["r"] - row.strip * tile[0] + 1) * wide + s["c"] - row.block * tile[1] + 1 for s in row.seeds])
                    at = at[inside[at]]
                    if len(at):
                        start = _from_known(inside, at, np.zeros(len(at), np.int64), steps)[cells]
                out.append((row.image_id, row.strip, row.block, cells, ways[0], to // wide + row.strip * tile[0] - 1, to % wide + row.block * tile[1] - 1, table, start))
            yield pd.DataFrame(out, columns=[*_AT, "cells", "way_from", "way_r", "way_c", "table", "start"])

    return body.mapInPandas(build, "image_id long, strip long, block long, cells array<int>, way_from array<int>, way_r array<long>, way_c array<long>, table binary, start array<long>")


def _nearer(tile: tuple[int, int], connectivity: int):
    """One round inside the tiles that got entries: what is known now, and what goes on over the border."""
    wide = tile[1] + 2

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                cells = np.array(row.cells, np.int64)
                before = np.full(len(cells), _FAR) if row.known is None else np.array(row.known, np.int64)
                if row.entries is None:
                    now = np.array(row.start, np.int64)
                else:
                    at = np.searchsorted(cells, [(x["r"] - row.strip * tile[0] + 1) * wide + x["c"] - row.block * tile[1] + 1 for x in row.entries])
                    level = np.array([x["level"] for x in row.entries], np.int64)
                    better = level < before[at]
                    if not better.any():
                        continue
                    at, level = at[better], level[better]
                    table = _metric(cells, wide, connectivity) if row.table is None else np.frombuffer(row.table, "<i4").reshape(len(cells), -1)
                    ways = table[at].astype(np.int64)
                    now = np.minimum(before, np.where(ways < 0, _FAR, ways + level[:, None]).min(axis=0))
                fresh = now < before
                gone = [(int(r), int(c), int(now[i]) + 1) for i, r, c in zip(row.way_from, row.way_r, row.way_c) if fresh[i]]
                out.append((row.image_id, row.strip, row.block, now, [{"r": r, "c": c, "level": x} for r, c, x in gone]))
            yield pd.DataFrame(out, columns=[*_AT, "known", "gone"])

    return step, f"image_id long, strip long, block long, known array<long>, gone {_PLACE}"


def levels_of_runs(runs: DataFrame, seeds: DataFrame, connectivity: int = 8, tile: tuple[int, int] = TILE) -> DataFrame:
    """(image_id, r, c, level): geodesic distance of each reached pixel from its image's nearest seed. Runs jobs when called.

    runs: image_id, r, s, e, disjoint; seeds: image_id, r, c; a seed on background fills nothing. Rounds follow the number of tiles on the
    longest of the shortest paths; each writes a row for each tile that has come nearer, and ends on the
    counts of that write."""
    h, w = tile
    steps, own = _shape(tile, connectivity)
    body = written(packed_tiles(runs, seeds, tile))
    graph = written(border_graph(body, tile, connectivity))
    step, schema = _nearer(tile, connectivity)

    def done(made: DataFrame, number: int) -> tuple[DataFrame, int]:
        seen = Observation()
        out = written(made.observe(seen, F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("gone")).withColumn("round", F.lit(number)))
        counted("level_entries", seen.get["gone"])
        return out, seen.get["gone"]

    def latest(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(*_AT).agg(F.max_by("known", "round").alias("known"), F.max("round").alias("round"))

    none = {"entries": F.lit(None).cast(_PLACE), "known": F.lit(None).cast("array<long>")}
    last, n = done(graph.filter("start is not null").withColumns(none).mapInPandas(step, schema), 0)
    parts, number = [last.drop("gone")], 0
    while n:
        number += 1
        entry = last.select("image_id", F.explode("gone").alias("x")).select("image_id", F.floor(F.col("x.r") / h).alias("strip"), F.floor(F.col("x.c") / w).alias("block"), "x")
        entries = entry.groupBy(*_AT).agg(F.collect_list("x").alias("entries"))
        active, known = graph.drop("start"), latest(parts)
        if n <= BROADCAST:  # the few tables that are needed are picked before they are shuffled
            keys = F.broadcast(entry.select(*_AT).distinct())
            active, known = active.join(keys, _AT, "left_semi"), known.join(keys, _AT, "left_semi")
        rows = active.join(entries, _AT).join(known.drop("round"), _AT, "left").withColumn("start", F.lit(None).cast("array<long>"))
        last, n = done(rows.mapInPandas(step, schema), number)
        parts.append(last.drop("gone"))
        if len(parts) > ROUNDS:
            parts = [written(latest(parts))]

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = w + 2
        for frame in frames:
            for row in frame.itertuples(index=False):
                inside = _mask(row.runs, tile).ravel() & own
                around = _mask(row.runs, tile).ravel() & ~own
                places = np.flatnonzero(inside)
                cells = places[around[places[:, None] + steps[None]].any(axis=1)]
                known = np.array(row.known, np.int64)
                at = np.array([(s["r"] - row.strip * h + 1) * wide + s["c"] - row.block * w + 1 for s in (() if row.seeds is None else row.seeds)], np.int64)
                at = at[inside[at]]
                far = _from_known(inside, np.concatenate([cells[known < _FAR], at]), np.concatenate([known[known < _FAR], np.zeros(len(at), np.int64)]), steps)
                got = places[far[places] < _FAR]
                yield pd.DataFrame({"image_id": row.image_id, "r": got // wide + row.strip * h - 1, "c": got % wide + row.block * w - 1, "level": far[got]})

    return body.join(latest(parts).drop("round"), _AT).mapInPandas(fill, "image_id long, r long, c long, level long")


def levels(blob: DataFrame, seeds: DataFrame, connectivity: int = 8, tile: tuple[int, int] = TILE) -> DataFrame:
    """levels_of_runs() of single pixels (image_id, r, c)."""
    return levels_of_runs(blob.select("image_id", "r", F.col("c").alias("s"), F.col("c").alias("e")).distinct(), seeds, connectivity, tile)
