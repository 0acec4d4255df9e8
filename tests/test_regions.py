"""Golden scenes, both labelling ways, generators, sinks and odd scenes."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import reports
from rasterloom.functions.colour import random_colour
from rasterloom.functions.predicates import FOREGROUND
from rasterloom.operators import components, fill, runs, stats, tiles
from rasterloom.sinks import png, tables
from rasterloom.sources import images, scenes


def pixels(spark, points, image=0):
    return spark.createDataFrame([(image, r, c) for r, c in points], scenes.PIXEL)


def dots(t):
    return [(r, c) for r in range(40) for c in range(40) if (r * r * 31 + c * c * 17 + r * c * 13 + r * 7 + c * 3) % 101 < t]


@pytest.mark.parametrize("t,n4,s4,n8,s8", [(30, 214, 164216, 100, 68206), (45, 184, 131238, 31, 21625), (60, 68, 44331, 2, 1560)])
def test_dots(spark, t, n4, s4, n8, s8):
    made = runs.runs_of_pixels(pixels(spark, dots(t)), 40).cache()
    for connectivity, n, total in ((4, n4, s4), (8, n8, s8)):
        for tile in (components.TILE, (7, 5), (1, 3)) if t == 45 else ((40, 40), (16, 9)):
            table = components.blob_table(made, components.label_runs(made, connectivity, tile))
            assert table.agg(F.count("*"), F.sum("blob_id"), F.sum("area")).first() == (n, total, len(dots(t)))


@pytest.mark.parametrize("n,low,high,red,rows,blobs,total,ring", [(100, 5, 100, 197459, 3700, 57, 26299652, 211210), (1000, 20, 50, 611593, 7675, 8, 2957347, 640640)])
def test_rectangles(spark, n, low, high, red, rows, blobs, total, ring):
    made = scenes.runs_of_rects(scenes.random_rectangles(spark, 900, n, low, high), 900).cache()
    labels = components.label_runs(made).cache()
    assert made.count() == rows
    assert components.blob_table(made, labels).agg(F.count("*"), F.sum("blob_id"), F.sum("area")).first() == (blobs, total, red)
    assert fill.visited_ring(made, 900, 900).count() == ring
    want = {100: {57: (7, 33, 6, 11)}.get(blobs), 1000: (3, 4, 0, 1)}[n]
    got = {r.tile_tier: r["count"] for r in tiles.tier_passes(made).groupBy("tile_tier").count().collect()}
    assert tuple(got.get(k, 0) for k in (100, 400, 800, None)) == want


def test_pixels_of_rects_are_spelt_out_last(spark):
    """Each pixel of overlapping, adjoining and repeated rectangles once; after pixels are made nothing sorts, groups or deals them."""
    rects = [(i, 3 * k % 17, 5 * k % 23, 1 + k % 6, 1 + k * i % 9) for i in range(3) for k in range(25)] + [(0, 0, 40, 2, 3), (0, 0, 43, 2, 3), (0, 0, 40, 2, 3), (7, 5, 5, 1, 1)]
    made = scenes.pixels_of_rects(spark.createDataFrame(rects, scenes.RECT).repartition(3))
    want = {(i, r, c) for i, r0, c0, h, w in rects for r in range(r0, r0 + h) for c in range(c0, c0 + w)}
    assert sorted(map(tuple, made.collect())) == sorted(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(x for x in plan if "Project" not in x).lstrip(" +-").startswith("Generate explode(sequence(")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scenes.pixels_of_rects(spark.createDataFrame([], scenes.RECT)).isEmpty()


def test_square_levels(spark):
    square = scenes.pixels_of_rects(scenes.centred_square(spark, 80, 80, 40)).cache()
    seed = spark.createDataFrame([(0, 40, 40)], scenes.PIXEL)
    for tile in ((80, 80), (11, 17)):
        reached = fill.levels(square, seed, 8, tile).cache()
        sizes = {r.level: r.pixels for r in fill.frontier_sizes(reached).collect()}
        assert sizes == {0: 1, **{k: 8 * k for k in range(1, 20)}, 20: 79}
    assert fill.visited_ring(runs.runs_of_pixels(square, 80), 80, 80).count() == 1764
    for side, want in ((500, 550), (1000, 1050), (1500, 1550), (2000, 2050)):
        assert spark.range(1).select(fill.checked_iterations(F.lit(side)).alias("x")).first().x == want
    assert fill.seed_blobs(square, spark.createDataFrame([(0, 0, 0)], scenes.PIXEL), 80, 8).count() == 0


def test_maze_levels(spark):
    """Shortest ways that leave a tile and come back, against a plain search."""
    walls = {(r, c) for r in range(1, 14, 2) for c in range(14)} - {(r, 13 if r % 4 == 1 else 0) for r in range(1, 14, 2)}
    body = {(r, c) for r in range(14) for c in range(14)} - walls
    far, now = {(0, 0): 0, (12, 3): 0}, [(0, 0), (12, 3)]
    while now:
        near = {(r + i, c + j) for r, c in now for i, j in fill.OFFSETS[4]} & body - far.keys()
        far |= {p: far[now[0]] + 1 for p in near}
        now = list(near)
    seeds = pixels(spark, [(0, 0), (12, 3), (1, 1)])
    for tile in ((14, 14), (9, 6)):
        assert {(r.r, r.c): r.level for r in fill.levels(pixels(spark, sorted(body)), seeds, 4, tile).collect()} == far


def test_odd_scenes(spark):
    none = pixels(spark, [])
    assert components.blobs(none, 10).count() == 0 and fill.visited_ring(runs.runs_of_pixels(none, 10), 10, 10).count() == 0 and fill.levels(none, none).count() == 0
    full = pixels(spark, [(r, c) for r in range(6) for c in range(9)])
    assert components.blobs(full, 9).first().area == 54 and fill.visited_ring(runs.runs_of_pixels(full, 9), 6, 9).count() == 54
    assert {(r.r, r.c) for r in fill.edge_pixels(runs.runs_of_pixels(full, 9)).collect()} == {(r, c) for r in range(6) for c in range(9) if r in (0, 5) or c in (0, 8)}
    corner = pixels(spark, [(0, 0), (1, 1), (5, 8)])
    assert components.blobs(corner, 9).count() == 3 and components.blobs(corner, 9, 8).count() == 2
    assert fill.visited_ring(runs.runs_of_pixels(pixels(spark, [(0, 0)]), 9), 6, 9).count() == 4
    near = spark.createDataFrame([(201, 49, 49), (200, 0, 0), (255, 50, 0), (255, 0, 0), (255, 255, 255), (250, 5, 5)], "red int, green int, blue int")
    assert {k: near.filter(f()).count() for k, f in FOREGROUND.items()} == {"exact_red": 1, "red_tolerant": 3, "not_white": 5}


def test_seed_and_expansion_differ(spark):
    red, grey = pixels(spark, [(0, 0), (0, 1)]), pixels(spark, [(0, 2), (3, 3)])
    got = components.components_with_seeds(red.union(grey), red, 10).collect()
    assert [(r.blob_id, r.area) for r in got] == [(0, 3)]


def test_generators(spark):
    walks = spark.createDataFrame([(0, i, 200, 200, i) for i in range(3)], "image_id long, walk long, r long, c long, seed long")
    walked = scenes.random_walks(walks, 400, 400, 1000).cache()
    assert walked.filter("(r - 200) * (r - 200) + (c - 200) * (c - 200) >= 3600").count() == 0
    assert components.blobs(walked, 400).count() == 1 and 1 < walked.count() <= 3001
    blocks = scenes.packed_blocks(spark.createDataFrame([(0, 1), (1, 2)], "image_id long, seed long"), 200, strip=45).cache()
    cells = scenes.pixels_of_rects(blocks)
    for image in (0, 1):  # nowhere inside the edge does another pixel with its padding fit, and no two squares are nearer than that
        near = np.zeros((200, 200), np.int64)
        for b in blocks.filter(F.col("image_id") == image).collect():
            near[max(0, b.r0 - 3) : b.r0 + b.h + 3, max(0, b.c0 - 3) : b.c0 + b.w + 3] += 1
            near[b.r0 : b.r0 + b.h, b.c0 : b.c0 + b.w] += 100
        assert near[3:-3, 3:-3].min() > 0 and near.max() == 101 and near[:3].max() < 100 and near[:, :3].max() < 100 and near[-3:].max() < 100 and near[:, -3:].max() < 100
    assert cells.count() == blocks.agg(F.sum(F.col("h") * F.col("w"))).first()[0] and blocks.filter("h not between 1 and 40").count() == 0
    grown = scenes.organic_blobs(spark.createDataFrame([(0, i, 50 + 100 * i, 100, 20, i) for i in range(3)], "image_id long, blob long, r long, c long, radius long, seed long"), 400, 400)
    table = components.blobs(grown, 400)
    assert 1 <= table.count() <= 3 and table.agg(F.min("area")).first()[0] >= int(0.3 * int(np.pi * 400 * 0.4))
    drawn = scenes.organic_scenes(spark.createDataFrame([(0, 5)], "image_id long, seed long"), 300, 300, 8, 20, (5, 30)).cache()
    own = drawn.select("image_id", "r", "c").distinct()
    assert own.count() == drawn.count() and 3 < drawn.select("blob").distinct().count() <= 8
    disc = scenes.discs(spark.createDataFrame([(0, 20, 20, 5)], "image_id long, r long, c long, radius long"), 100, 100)
    assert disc.count() == sum(a * a + b * b <= 25 for a in range(-5, 5) for b in range(-5, 5))


def test_png_and_reader(spark, tmp_path):
    made = png.painted(pixels(spark, [(0, 0), (2, 3), (299, 1)]), F.struct(F.lit(255).alias("red"), F.lit(0).alias("green"), F.lit(7).alias("blue")))
    data = bytes(png.png_files(made, 300, 5).first().png)
    assert struct.unpack(">II", data[16:24]) == (5, 300)
    at = data.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]), np.uint8).reshape(300, 16)[:, 1:].reshape(300, 5, 3)
    assert (raw[2, 3] == (255, 0, 7)).all() and (raw[2, 2] == 255).all() and (raw[299, 1] == (255, 0, 7)).all()
    (tmp_path / "a.png").write_bytes(data)
    back = images.pixels(images.read_images(spark, str(tmp_path)), "not_white")
    assert {(r.r, r.c, r.red, r.green, r.blue) for r in back.collect()} == {(0, 0, 255, 0, 7), (2, 3, 255, 0, 7), (299, 1, 255, 0, 7)}


def test_png_from_runs(spark):
    """Runs give the files that their pixels give, over several bands, one of them empty; what lies off the canvas is told or left out."""
    red = F.struct(F.lit(255).alias("red"), F.lit(0).alias("green"), F.lit(7).alias("blue"))
    drawn = [(i, 30 * r + s, r, s, s + n) for i in range(3) for r in (*range(0, 256, 7), 600, 699) for s, n in ((0, i), (9, 0), (20, 9))]
    made = spark.createDataFrame(drawn, images.RUN)
    files = {x.image_id: bytes(x.png) for x in png.png_files(png.painted(made, red), 700, 30).collect()}
    assert files == {x.image_id: bytes(x.png) for x in png.png_files(png.painted(fill.pixels_of_runs(made), red), 700, 30).collect()}
    back = images.runs_of_png(spark.createDataFrame(list(files.items()), "image_id long, png binary"), "not_white")
    assert sorted(map(tuple, back.collect())) == sorted(drawn)
    bands = png.png_bands(png.painted(made, red), 700, 30)
    assert sorted((x.image_id, x.band) for x in bands.collect()) == [(i, b) for i in range(3) for b in range(3)]
    below = png.painted(spark.createDataFrame([(0, 0, 700 + 256, 3, 4)], images.RUN), red)
    assert [x.band for x in png.png_bands(below, 700, 30).orderBy("band").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="leave the canvas"):
        png.png_bands(png.painted(spark.createDataFrame([(0, 0, 5, 28, 30)], images.RUN), red), 700, 30).collect()


@pytest.mark.parametrize("query", ["image_blobs", "image_file_blobs"])
def test_canvases_are_drawn_from_runs(spark, sf_dir, query, monkeypatch):
    """No row for each pixel is sorted and grouped, and the bands are dealt to all shuffle partitions even if their cells are few bytes."""
    from rasterloom.plans import catalog

    seen, drawn = [], png.png_bands

    def watched(cells, *rest):
        bands = drawn(cells, *rest)
        seen.append((cells.count(), bands.rdd.getNumPartitions()))
        return bands

    monkeypatch.setattr(png, "png_bands", watched)
    catalog.QUERIES[query](spark, sf_dir)
    assert seen == [(catalog.scene_runs(spark, sf_dir).count(), int(spark.conf.get("spark.sql.shuffle.partitions")))]


def test_image_file_of_16_million_pixels(spark, tmp_path):
    """A 4000 x 4000 file becomes runs by bands, from Spark's image source and from the bytes, within 3 GB."""
    import resource

    import pandas as pd

    r, c = np.ogrid[:4000, :4000]
    rgb = np.full((4000, 4000, 3), 255, np.uint8)
    rgb[(r // 50 + c // 70) % 2 == 0] = (255, 0, 0)
    rows = np.zeros((4000, 12001), np.uint8)
    rows[:, 1:] = rgb.reshape(4000, -1)
    rows[1::2, 1:], rows[1::2, 0] = rows[1::2, 1:] - rows[::2, 1:], 2  # every other row by the row above
    body = zlib.compress(rows.tobytes(), 1)
    header = struct.pack(">IIBBBBB", 4000, 4000, 8, 2, 0, 0, 0)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + png.chunk(b"IHDR", header) + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b""))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.lit(0).cast("long").alias("image_id"), F.col("content").alias("png"))
    made = images.runs(images.read_images(spark, str(tmp_path)), "exact_red").drop("image_id"), images.runs_of_png(files, "exact_red").drop("image_id")
    for df in made:
        assert df.agg(F.count("*"), F.sum(F.col("e") - F.col("s") + 1), F.sum("run_id")).first() == _plain_runs(rgb)
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 3 << 20


def _plain_runs(rgb):
    n = pixels = ids = 0
    for i, row in enumerate(rgb[:, :, 1] == 0):
        edge = np.flatnonzero(np.diff(np.pad(row.astype(np.int8), 1)))
        n, pixels, ids = n + len(edge) // 2, pixels + int(row.sum()), ids + int((edge[::2] + i * 4000).sum())
    return n, pixels, ids


def test_png_filters():
    """Every filter and colour type of a PNG file is undone."""
    rng = np.random.default_rng(1)
    for colour, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        a = rng.integers(0, 256, (10, 7 * channels)).astype(np.int64)
        raw = b""
        for i, row in enumerate(a):
            kind, up = i % 5, a[i - 1] if i else np.zeros_like(row)
            left, corner = (np.concatenate([np.zeros(channels, np.int64), x[:-channels]]) for x in (row, up))
            guess = left + up - corner
            d = [abs(guess - x) for x in (left, up, corner)]
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
            minus = (np.zeros_like(row), left, up, (left + up) // 2, paeth)[kind]
            raw += bytes([kind]) + ((row - minus) % 256).astype(np.uint8).tobytes()
        header = struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0)
        data = b"\x89PNG\r\n\x1a\n" + png.chunk(b"IHDR", header) + png.chunk(b"IDAT", zlib.compress(raw)) + png.chunk(b"IEND", b"")
        got = np.concatenate(list(images.png_bands(memoryview(data))))
        want = a.reshape(10, 7, channels)
        assert (got == (want[:, :, :3] if channels > 2 else want[:, :, :1])).all()


def test_readers_and_writers(spark, tmp_path):
    """Result files come back as they were written; broken reports keep a row; images that arrive are handled once."""
    from rasterloom.streaming.images import watch_images

    row = (24.0, 64.0, 16.0, 50.9, 550.0, 1_000_000, 1.9e7, 24, 1536, 48, 100.0, 6.25, 3.1, 0.09)
    table = spark.createDataFrame([row], images.BENCHMARK)
    tables.write_csv(table, str(tmp_path / "csv"))
    assert images.read_benchmark_csv(spark, str(tmp_path / "csv")).collect() == table.collect()
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"improvement_claim": "x",\n "test_results": [{"iterations": 550}]}')
    (tmp_path / "json" / "b.json").write_text("{broken")
    got = images.read_reports(spark, str(tmp_path / "json")).collect()
    assert sorted(r.improvement_claim or "" for r in got) == ["", "x"] and sum(r._corrupt_record is not None for r in got) == 1
    runs_table = spark.createDataFrame([("a", 1, 2.0, "p", 1), ("a", 2, 4.0, "q", 2), ("b", 1, 1.0, "r", 1)], "k string, run int, ms double, note string, seq int")
    mean = stats.mean_runs(runs_table, ["k"], ["ms"], ["note"], "seq")
    assert sorted(map(tuple, mean.collect())) == [("a", 3.0, "p"), ("b", 1.0, "r")]
    assert scenes.rectangle(spark, 2, 3, 4, 5).collect()[0][1:] == (2, 3, 4, 5)
    k = spark.range(300).select(random_colour(3).alias("k")).select("k.*")
    assert k.filter("red not between 0 and 255 or green not between 0 and 255 or blue not between 0 and 255").count() == 0 and k.distinct().count() > 200
    assert spark.range(1).select(reports.rate(F.lit(10), F.lit(0.0)).alias("a"), reports.rate(F.lit(10), F.lit(4.0)).alias("b"), reports.percent(F.lit(1), F.lit(0)).alias("c")).first() == (0.0, 2.5, 0.0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(bytes(png.mask_files(pixels(spark, [(0, 1), (1, 1), (1, 4)]), 2, 6).first().png))
    seen = []

    def handle(files):
        made = images.runs_of_png(files.select(F.xxhash64("path").alias("image_id"), F.col("content").alias("png")), "not_white")
        seen.append(made.filter("s > 0 or e < 5").count())

    for _ in range(2):
        watch_images(spark, str(tmp_path / "in"), handle, str(tmp_path / "state")).awaitTermination(120)
    assert sum(seen) == 5  # black beside the white points: 2 runs in the first row, 3 in the second


def test_stats(spark):
    assert stats.sweep_grid(spark).count() == 48
    text = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 30,)], "n long").select(reports.bytes_text(F.col("n")).alias("t"))
    assert [r.t for r in text.collect()] == ["0.00 B", "1023.00 B", "1.50 KB", "5.00 GB"]


def test_memory_text(spark):
    sizes = [0, 999, 1000, 1023, 10 * 1024, 102912, 999 * 1024, 1000 * 1024, 5 << 30, 3 << 50]
    text = spark.createDataFrame([(n,) for n in sizes], "n long").select(reports.memory_text(F.col("n")).alias("t"))
    assert [r.t for r in text.collect()] == ["0.00 B", "999 B", "0.98 KB", "1.00 KB", "10.0 KB", "100 KB", "999 KB", "0.98 MB", "5.00 GB", "3072 TB"]


def test_harness(spark, tmp_path):
    took = stats.timed_runs(spark, lambda: spark.range(10), repeats=2, warm_ups=1)
    assert [r.run for r in took.orderBy("run").collect()] == [0, 1] and took.filter("seconds <= 0").count() == 0
    assert reports.engine_info(spark).filter("name = 'master' and value like 'local%'").count() == 1
    rects = spark.createDataFrame([(0, 0, 0, 5, w) for w in (3, 4, 50)], scenes.RECT)
    assert scenes.pick(rects, 4, 1).first().w <= 4 and scenes.pick(rects, 2, 1).count() == 0
    tables.write_json(rects, str(tmp_path / "out"))
    assert tables.file_sizes(spark, str(tmp_path / "out")).agg(F.sum("bytes")).first()[0] > 0
    data = png.mask_files(pixels(spark, [(0, 1)]), 2, 3).first().png
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert np.frombuffer(raw, np.uint8).reshape(2, 10)[:, 1:].sum() == 3 * 255


def plain_levels(body, seeds, connectivity):
    far, now = {p: 0 for p in seeds if p in body}, [p for p in seeds if p in body]
    while now:
        near = {(r + i, c + j) for r, c in now for i, j in fill.OFFSETS[connectivity]} & body - far.keys()
        far |= {p: far[now[0]] + 1 for p in near}
        now = list(near)
    return far


def test_levels_over_many_tiles(spark, monkeypatch):
    """A maze over 64 tiles, random scenes and a full one; what is written is linear in the pixels and read from counters."""
    import random

    from rasterloom.operators import levels as module

    rows = []

    def recorded(df, write=components.written):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, "written", recorded)
    maze = {(r, c) for r in range(64) for c in range(64) if r % 2 == 0 or c == 0} - {(r, 20) for r in range(0, 64, 6)}  # corridors from a spine, some cut
    rng = random.Random(4)
    noise = {(r, c) for r in range(60) for c in range(75) if rng.random() < 0.66} | {(30, 30)}
    full = {(r, c) for r in range(33) for c in range(47)}
    for body, seeds, connectivity, tile, limit in ((maze, [(0, 0), (1, 1)], 4, (8, 8), 16), (noise, [(0, 1), (1, 1), (30, 30)], 4, (20, 19), 2), (noise, [(30, 30)], 8, (16, 25), 16), (full, [(32, 46), (99, 99)], 8, (12, 12), 16), (full, [(5, 5)], 4, (7, 50), 16)):
        monkeypatch.setattr(module, "ROUNDS", limit)
        monkeypatch.setattr(module, "BROADCAST", 10 if limit == 2 else 200_000)
        rows.clear()
        components.counters()
        got = {(r.r, r.c): r.level for r in fill.levels(pixels(spark, sorted(body)), pixels(spark, seeds), connectivity, tile).collect()}
        assert got == plain_levels(body, seeds, connectivity)
        assert sum(rows) <= len(body)
        told = [n for name, n in components.counters() if name == "level_entries"]
        assert told[-1] == 0 and len(told) > 2


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tier_passes(spark, connectivity):
    """Passes over small tiles on noise, against tiers read off the pixels of labelled blobs; counts of each pass."""
    import random

    from rasterloom.functions.predicates import on_tile_frame

    rng = random.Random(connectivity)
    cells = [(i, r, c) for i in range(3) for r in range(70) for c in range(67) if rng.random() < (0.3, 0.5, 0.64)[i]]
    made = runs.runs_of_pixels(spark.createDataFrame(cells, scenes.PIXEL), 67).cache()
    sizes = (6, 12, 36)
    components.counters()
    got = {(r.image_id, r.blob_id): tuple(r)[2:] for r in tiles.tier_passes(made, connectivity, sizes).collect()}
    told = dict(components.counters())
    per = components.labelled_pixels(made, components.label_runs(made, connectivity)).groupBy("image_id", "blob_id").agg(
        F.count("*").alias("n"), *[F.max(on_tile_frame(t)).alias(f"on_{t}") for t in sizes], F.count_if(on_tile_frame(6)).alias("frame"), F.min(F.when(on_tile_frame(6), F.struct("r", "c"))).alias("first")
    )
    want = {(r.image_id, r.blob_id): (r.n, next((t for t in sizes if not r[f"on_{t}"]), None), r.frame, *(r["first"] or (None, None))) for r in per.collect()}
    assert got == want
    # what a pass puts off are its own parts of blobs, never fewer than the blobs
    for t in sizes:
        left = sum(v[1] is None or v[1] > t for v in want.values())
        assert told[f"put_off_{t}"] >= left > 0 and told[f"border_pieces_{t}"] > 0
    assert told["border_pieces_6"] > told["border_pieces_12"] > told["border_pieces_36"]
    counts = {r.tile_size: (r.done, r.put_off) for r in tiles.pass_counts(tiles.tier_passes(made, connectivity, sizes), sizes).collect()}
    assert counts == {t: (sum(v[1] == t for v in want.values()), sum(v[1] is None or v[1] > t for v in want.values())) for t in sizes}
    with pytest.raises(ValueError):
        tiles.tier_passes(made, connectivity, (6, 9))


@pytest.mark.parametrize("size", [2, 5, 10])
def test_frames_in_closed_form(spark, size):
    from collections import Counter

    from rasterloom.functions.predicates import frame_layer, on_tile_frame

    made = spark.createDataFrame([(0, 100 * r + s, r, s, s + n) for r in range(23) for s, n in ((0, r), (30, 2 * r), (80 + r % 7, r % 3))], "image_id long, run_id long, r long, s long, e long").cache()
    cells = fill.pixels_of_runs(made).cache()
    assert made.agg(F.sum(tiles.frame_pixels(size))).first()[0] == cells.filter(on_tile_frame(size)).count()
    first = {(r.r, r.s): r.c for r in made.select("r", "s", tiles.first_frame_column(size).alias("c")).collect()}
    on = {(r.r, r.c) for r in cells.filter(on_tile_frame(size)).collect()}
    assert first == {(r.r, r.s): next((c for c in range(r.s, r.e + 1) if (r.r, c) in on), None) for r in made.collect()}
    assert {r.layer: r.pixels for r in tiles.layer_counts(made, size).collect()} == dict(Counter(r.x for r in cells.select(frame_layer(size).alias("x")).collect()))
    inner = tiles.without_frames(made, size)
    assert {(r.r, r.c) for r in fill.pixels_of_runs(inner).collect()} == {(r.r, r.c) for r in cells.collect()} - on and inner.filter(F.col("run_id") != 100 * F.col("r") + F.col("s")).isEmpty()


def _png(rgb_or_samples, depth, colour, laced=False, palette=None, cut=None):
    """A PNG file made plainly: samples (height, width, channels), filter by row number."""
    height, width, channels = rgb_or_samples.shape

    def packed(rows):
        if depth == 16:
            return rows.astype(">u2").reshape(len(rows), -1).view(np.uint8).reshape(len(rows), -1)
        if depth == 8:
            return rows.astype(np.uint8).reshape(len(rows), -1)
        bits = (rows.reshape(len(rows), -1)[:, :, None] >> np.arange(depth)[::-1]) & 1
        return np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1)

    def filtered(rows):
        out, above, n = b"", np.zeros(rows.shape[1], np.int64), max(1, channels * depth // 8)
        for i, row in enumerate(rows.astype(np.int64)):
            kind = (0, 1, 2)[i % 3]
            left = np.concatenate([np.zeros(n, np.int64), row[:-n]]) if len(row) > n else np.zeros(len(row), np.int64)
            out += bytes([kind]) + ((row - (0, left, above)[kind]) % 256).astype(np.uint8).tobytes()
            above = row
        return out

    steps = images.PASSES if laced else ((0, 0, 1, 1),)
    raw = b"".join(filtered(packed(rgb_or_samples[t::d, l::a])) for l, t, a, d in steps if l < width and t < height)
    data = zlib.compress(raw)[:cut]
    parts = [png.chunk(b"IDAT", data[i : i + 50]) for i in range(0, len(data), 50)]
    head = png.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(laced)))
    return b"\x89PNG\r\n\x1a\n" + head + (png.chunk(b"PLTE", bytes(palette)) if palette is not None else b"") + b"".join(parts) + png.chunk(b"IEND", b"")


def test_png_kinds(spark):
    """Every colour type, depth and interlacing; broken files keep a row with their error."""
    rng = np.random.default_rng(1)
    files, want = [], {}
    for colour, depths in images.DEPTHS.items():
        for depth in depths:
            for laced in (False, True):
                for height, width in ((11, 13), (1, 1), (5, 3)):
                    samples = rng.integers(0, 1 << depth, (height, width, images.CHANNELS[colour]))
                    if colour in (2, 6):
                        samples[rng.random((height, width)) < 0.5, :3] = ((1 << depth) - 1, 0, 0)
                    palette = rng.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
                    if colour == 3:
                        palette[: len(palette) // 2 + 1] = (255, 255, 255)
                    eight = samples >> 8 if depth == 16 else samples if depth == 8 or colour == 3 else samples * (255 // ((1 << depth) - 1))
                    rgb = palette[samples[:, :, 0]] if colour == 3 else eight[:, :, :3] if colour in (2, 6) else np.repeat(eight[:, :, :1], 3, axis=2)
                    data = _png(samples, depth, colour, laced, None if palette is None else palette.astype(np.uint8).ravel())
                    assert np.array_equal(np.concatenate(list(images.png_bands(memoryview(data)))), rgb), (colour, depth, laced)
                    want[len(files)] = {(r, c) for r, c in zip(*np.nonzero((rgb != 255).any(axis=2)))}
                    files.append((len(files), bytearray(data)))
    good = _png(rng.integers(0, 256, (9, 9, 3)), 8, 2)
    broken = [None, b"", b"no image", good[:60], good[:-30], _png(rng.integers(0, 256, (9, 9, 3)), 8, 2, cut=-20), good.replace(b"IDAT", b"JDAT"), _png(np.full((3, 3, 1), 200), 8, 3, palette=[1, 2, 3]), good[:24] + b"\x03" + good[25:]]
    files += [(1000 + i, None if b is None else bytearray(b)) for i, b in enumerate(broken)]
    df = spark.createDataFrame(files, "image_id long, png binary")
    got = images.read_png(df, "not_white").collect()
    assert {r.image_id: bool(r.error) for r in got if r.error} == {1000 + i: True for i in range(len(broken))}
    found = {}
    for r in got:
        if not r.error:
            found.setdefault(r.image_id, set()).update((r.r, c) for c in range(r.s, r.e + 1))
    assert found == {k: v for k, v in want.items() if v}
    assert images.runs_of_png(df, "not_white").count() == len(got) - len(broken)


def test_png_source(spark, tmp_path):
    """Files of several bands from several partitions are written and read back; broken ones keep a row; a failed write leaves none."""
    from rasterloom.sources import png_source

    points = [(i, r, (r * 7 + i) % 40) for i in range(3) for r in range(0, 1000, 3)]
    red = F.struct(F.lit(255).alias("red"), F.lit(0).alias("green"), F.lit(0).alias("blue"))
    bands = png.named_bands(png.painted(spark.createDataFrame(points, scenes.PIXEL).repartition(5), red), 1000, 40)
    folder = tmp_path / "files"
    png_source.write_png_files(bands, str(folder))
    assert sorted(p.name for p in folder.iterdir()) == [f"image_{i}.png" for i in range(3)]
    assert (folder / "image_0.png").read_bytes().count(b"IDAT") == 5
    (folder / "broken.png").write_bytes((folder / "image_0.png").read_bytes()[:300])
    (folder / "other.txt").write_text("no image")
    got = png_source.read_png_files(spark, str(folder), "exact_red").collect()
    assert {(int(r.path[-5]), r.r, c) for r in got if r.error is None for c in range(r.s, r.e + 1)} == set(points)
    assert [r.path.endswith("broken.png") for r in got if r.error] == [True]
    one = spark.read.format(png_source.NAME).load(str(folder)).filter(f"path = '{folder}/image_1.png' and foreground = 'red_tolerant'")
    assert one.rdd.getNumPartitions() == 1 and {r.path[-5] for r in one.collect()} == {"1"} and one.count() == len(points) // 3
    png_source.write_png_files(bands.filter("name like '%2.png'"), str(folder), "overwrite")
    assert sorted(p.name for p in folder.iterdir()) == ["image_2.png", "other.txt"]
    # a band that is missing fails the task: nothing is left, the old file stays
    with pytest.raises(Exception, match="missing"):
        png_source.write_png_files(bands.filter("band != 1"), str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["image_2.png", "other.txt"]
    with pytest.raises(Exception, match="write bands"):
        spark.range(1).write.format(png_source.NAME).mode("append").save(str(folder))


def test_lookup_of_a_long_row(spark):
    """A row of 1e5 runs and 1e5 points, a run over all columns, repeated points and points beside runs."""
    import time

    row = spark.range(100_000).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") * 4).alias("run_id"), F.lit(7).cast("long").alias("r"), (F.col("id") * 4).alias("s"), (F.col("id") * 4 + 1).alias("e"))
    wide = spark.createDataFrame([(0, 900_000, 9, 0, 399_999)], row.schema)
    points = spark.range(100_000).select(F.lit(0).cast("long").alias("image_id"), F.lit(7).cast("long").alias("r"), (F.col("id") * 4 + F.col("id") % 4).alias("c"), F.col("id").alias("name"))
    points = points.union(points.withColumn("r", F.lit(9).cast("long"))).union(points.limit(1).withColumn("r", F.lit(9).cast("long")))
    began = time.time()
    got = runs.lookup(row.union(wide), points).groupBy("r").agg(F.count("*").alias("n"), F.count_if(F.col("run_id") == F.col("name") * 4).alias("own")).collect()
    assert {r.r: (r.n, r.own) for r in got} == {7: (50_000, 50_000), 9: (100_001, 0)}
    assert time.time() - began < 60


def test_object_chunks(spark):
    """A blob of 1e7 pixels as rows of bounded size, in scan order."""
    made = scenes.runs_of_rects(scenes.centred_square(spark, 3200, 3200, 3164), 3200)
    made = made.union(spark.createDataFrame([(0, 5, 0, 5, 9)], made.schema)).withColumns({c: F.col(c).cast("long") for c in made.columns})
    labels = components.label_runs(made)
    chunks = components.object_chunks(made, labels, 10_000).cache()
    rows = chunks.select("object_id", "chunk", "first", "points", F.size("runs").alias("n"), F.col("runs")[0].alias("a"), F.expr("runs[size(runs) - 1]").alias("z")).collect()
    big = sorted((r for r in rows if r.object_id == 2), key=lambda r: r.chunk)
    assert sum(r.points for r in big) == 3164**2 and max(r.points for r in rows) < 20_000 and max(r.n for r in rows) <= 5 and len(rows) == len(big) + 1
    at = 0
    for r, after in zip(big, [*big[1:], None]):
        assert r.first == at == r.a.first
        at += r.points
        assert after is None or (r.z.r, r.z.e) < (after.a.r, after.a.s)
    few = components.chunk_points(components.object_chunks(*(lambda m: (m, components.label_runs(m, 8)))(runs.runs_of_pixels(pixels(spark, dots(45)), 40)), size=3))
    want = {}
    for b, r, c in sorted((r.blob_id, r.r, r.c) for r in components.labelled_pixels(*(lambda m: (m, components.label_runs(m, 8)))(runs.runs_of_pixels(pixels(spark, dots(45)), 40))).collect()):
        want.setdefault(b, []).append((r, c))
    got = {}
    for o, k, r, c in sorted((r.object_id, r.ordinal, r.r, r.c) for r in few.collect()):
        assert k == len(got.setdefault(o, []))
        got[o].append((r, c))
    assert [got[o] for o in sorted(got)] == [want[b] for b in sorted(want)]


def test_table_functions(spark):
    from rasterloom.functions import tables as functions

    functions.register(spark)
    cells = pixels(spark, dots(45)).union(pixels(spark, [(0, 0), (0, 0), (39, 39)], 3))
    made = spark.sql("SELECT * FROM raster_runs(TABLE({cells}) PARTITION BY (image_id, r) ORDER BY (c), 40)", cells=cells)
    want = runs.runs_of_pixels(cells.distinct(), 40)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(made) == key(want)
    for connectivity in (4, 8):
        labels = spark.sql(f"SELECT * FROM raster_tile_labels(TABLE({{made}}) PARTITION BY (image_id), {connectivity})", made=made)
        assert key(labels) == key(components.label_runs(want, connectivity))
    assert spark.sql("SELECT * FROM raster_runs(TABLE({none}) PARTITION BY (image_id, r) ORDER BY (c), 40)", none=cells.limit(0)).collect() == []


def test_rounds_end_on_observed_counts(spark, monkeypatch):
    """Label rounds take their end from the writes: no job but those of the writes runs."""
    made = runs.runs_of_pixels(pixels(spark, dots(60)), 40).cache()
    made.count()
    components.counters()
    components.label_runs(made, 4, (5, 5))
    told = [n for name, n in components.counters() if name == "label_links"]
    assert len(told) >= 2 and told[-1] == told[-2] > 0


def test_organic_scene_of_81_million_pixels(spark):
    """Separation of seeds, disjoint blobs, least sizes and counts over many cells; every cell is a group of its own."""
    made = scenes.organic_bodies(spark.createDataFrame([(0, 5), (1, 6)], "image_id long, seed long"), 9000, 9000, 350, 20, (5, 60)).collect()
    assert {i: sum(r.image_id == i for r in made) for i in (0, 1)} == {0: 350, 1: 350}
    canvas = {i: np.zeros((9000, 9000), bool) for i in (0, 1)}
    for row in sorted(made, key=lambda r: (r.phase, r.blob)):
        own = canvas[row.image_id]
        assert 80 <= row.r < 8920 and 80 <= row.c < 8920 and not own[row.r - 20 : row.r + 21, row.c - 20 : row.c + 21].any()
        assert sum(e - s + 1 for s, e in zip(row.ss, row.es)) >= 5
        for r, s, e in zip(row.rs, row.ss, row.es):
            assert not own[r, s : e + 1].any()
            own[r, s : e + 1] = True
        assert own[row.r, row.c]
    crowded = scenes.organic_bodies(spark.createDataFrame([(0, 5)], "image_id long, seed long"), 700, 700, 400, 20, (20, 60), 3).collect()
    assert len({r.blob for r in crowded}) == len(crowded) < 400
