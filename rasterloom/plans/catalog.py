"""Registered queries over scenes that are derived from the given tables, and the SQL of each.

The canonical scene has one rectangle for each supplier; each 400 suppliers get a 400 x 400 canvas of their own, on which
their number shifts the places, so pixels and blobs grow with the table. The multi-image scene gives each nation canvases
of its own. The dots lay out orders on 200 x 200 canvases, seven for each 15,000 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.functions import colour, reports, tables
from rasterloom.functions.predicates import is_red, is_red_tolerant, not_white
from rasterloom.operators import components, fill, runs, scan, stats, tiles
from rasterloom.sinks import png
from rasterloom.sources import images, png_source, scenes

#: Sides of the canvases, and the keys that share one (dots: seven).
SIZE, DOTS, ORDERS = 400, 200, 15_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rects(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    k, q = F.col("s_suppkey"), F.expr(f"s_suppkey div {SIZE}")
    image = F.col("s_nationkey") + 25 * q if by_nation else q
    rects = _table(spark, sf_dir, "supplier").select(
        image.cast("long").alias("image_id"), ((k * 104729 + q * 211) % SIZE).alias("r0"), ((k * 7919 + q * 157) % SIZE).alias("c0"), (5 + (k * 17 + q) % 20).alias("h"), (5 + (k * 31 + q) % 20).alias("w")
    )
    return scenes.clip(rects, SIZE, SIZE)


def _dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered pixels, where 4- and 8-connectivity differ."""
    k = F.col("o_orderkey")
    image = F.pmod(F.col("o_custkey"), F.lit(7)) + 7 * F.expr(f"o_orderkey div {ORDERS}")
    return _table(spark, sf_dir, "orders").select(image.cast("long").alias("image_id"), (k * 7919 % DOTS).alias("r"), (k * 104729 % 49999 % DOTS).alias("c")).distinct()


def _runs(spark, sf_dir, by_nation=False):
    return scenes.runs_of_rects(_rects(spark, sf_dir, by_nation), SIZE)


def _labelled(spark, sf_dir, connectivity=4):
    made = _runs(spark, sf_dir)
    return made, components.label_runs(made, connectivity)


def _blobs(spark, sf_dir, connectivity=4):
    return components.blob_table(*_labelled(spark, sf_dir, connectivity))


def _pixels(spark, sf_dir):
    return components.labelled_pixels(*_labelled(spark, sf_dir))


def scene_pixels(spark, sf_dir):
    return scenes.pixels_of_rects(_rects(spark, sf_dir))


def scene_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


def pixel_runs(spark, sf_dir):
    return runs.runs_of_pixels(_dots(spark, sf_dir), DOTS)


def blob_table_4(spark, sf_dir):
    return _blobs(spark, sf_dir)


def blob_table_8(spark, sf_dir):
    return _blobs(spark, sf_dir, 8)


def dots_blobs_4(spark, sf_dir):
    return components.blobs(_dots(spark, sf_dir), DOTS, 4)


def dots_blobs_8(spark, sf_dir):
    return components.blobs(_dots(spark, sf_dir), DOTS, 8)


def blob_count(spark, sf_dir):
    return _blobs(spark, sf_dir).groupBy("image_id").agg(F.countDistinct("blob_id").alias("blobs"), F.sum("area").alias("area"), F.max("area").alias("largest"))


def multi_image_blob_counts(spark, sf_dir):
    made = _runs(spark, sf_dir, by_nation=True)
    table = components.blob_table(made, components.label_runs(made))
    return table.groupBy("image_id").agg(F.count("*").alias("blobs"), F.sum("area").alias("area"))


def object_points(spark, sf_dir):
    return components.object_summary(*_labelled(spark, sf_dir))


def object_chunks(spark, sf_dir):
    """The points of each object as chunks of runs in scan order."""
    made = components.object_chunks(*_labelled(spark, sf_dir), size=50)
    first = F.col("runs")[0]
    return made.select("image_id", "object_id", "chunk", "first", "points", F.size("runs").cast("long").alias("n_runs"), first.r.alias("first_r"), first.s.alias("first_c"))


def sql_tile_labels(spark, sf_dir):
    """Runs of rows and components of tiles by table functions in SQL."""
    tables.register(spark)
    made = spark.sql(
        f"""WITH cells AS (SELECT image_id, r, c, c div 100 AS block FROM {{dots}}),
        made AS (SELECT * FROM raster_runs(TABLE(cells) PARTITION BY (image_id, r, block) ORDER BY (c), {DOTS})),
        placed AS (SELECT *, r div 100 AS strip, s div 100 AS block FROM made)
        SELECT * FROM raster_tile_labels(TABLE(placed) PARTITION BY (image_id, strip, block), 4)""",
        dots=_dots(spark, sf_dir),
    )
    return made.select("image_id", "run_id", "blob_id")


def points_in_runs(spark, sf_dir):
    """Which of the places where orders lie on each canvas are covered by a rectangle, and by which run."""
    k, q = F.col("o_orderkey"), F.expr(f"o_orderkey div {ORDERS}")
    points = _table(spark, sf_dir, "orders").select(k, q.cast("long").alias("image_id"), (k * 7919 % SIZE).alias("r"), (k * 104729 % 49999 % SIZE).alias("c"))
    return runs.lookup(_runs(spark, sf_dir), points).select("o_orderkey", "image_id", "run_id")


def _recolour(scheme: str):
    def query(spark, sf_dir):
        table = components.ordinals(_blobs(spark, sf_dir))
        by = {"label": F.col("blob_id"), "ordinal": F.col("object_id") - 1, "patch": F.col("object_id"), "dense": F.col("object_id")}[scheme]
        return table.withColumn("k", colour.SCHEMES[scheme](by)).select("image_id", "blob_id", "k.red", "k.green", "k.blue")

    return query


def seed_first_red(spark, sf_dir):
    return fill.first_of_runs(_runs(spark, sf_dir, by_nation=True))


def _filled(spark, sf_dir):
    """The runs of the blob that holds each image's seed, and the seeds."""
    made = _runs(spark, sf_dir, True)
    seeds = fill.first_of_runs(made)
    return fill.seeded_runs(made, seeds, 8), seeds


def seeded_fill(spark, sf_dir):
    return fill.pixels_of_runs(_filled(spark, sf_dir)[0])


def bfs_levels(spark, sf_dir):
    filled, seeds = _filled(spark, sf_dir)
    return fill.levels_of_runs(filled, seeds)


def frontier_sizes(spark, sf_dir):
    return fill.frontier_sizes(bfs_levels(spark, sf_dir))


def fill_iterations(spark, sf_dir):
    per = bfs_levels(spark, sf_dir).groupBy("image_id").agg(F.max("level").alias("deepest"), F.count("*").alias("pixels"))
    return per.select("image_id", "pixels", (F.col("deepest") + 1).alias("levels"), fill.checked_iterations(F.col("deepest"), 10).alias("iterations"))


def chunk_distribution(spark, sf_dir):
    return fill.chunk_plan(frontier_sizes(spark, sf_dir), blocks=4, chunk=3, warps=2)


def slice_distribution(spark, sf_dir):
    return fill.slice_plan(frontier_sizes(spark, sf_dir), workers=8)


def visited_ring(spark, sf_dir):
    return fill.visited_ring(_filled(spark, sf_dir)[0], SIZE, SIZE)


def edge_pixels(spark, sf_dir):
    return fill.edge_pixels(_runs(spark, sf_dir))


def _passes(spark, sf_dir):
    return tiles.tier_passes(_runs(spark, sf_dir))


def tile_tier(spark, sf_dir):
    return _passes(spark, sf_dir).select("image_id", "blob_id", "area", "tile_tier", "frame_pixels")


def tier_passes(spark, sf_dir):
    """What each pass over growing tiles finds whole and what it puts off."""
    return tiles.pass_counts(_passes(spark, sf_dir))


def visited_state(spark, sf_dir):
    return tiles.states(_passes(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("blobs"), F.sum("area").alias("pixels"))


def boundary_pixels(spark, sf_dir):
    return tiles.boundary_pixels(_passes(spark, sf_dir))


def boundary_overlay(spark, sf_dir):
    return png.boundary_overlay(tiles.boundary_pixels(_passes(spark, sf_dir)))


def state_overlay(spark, sf_dir):
    """The pixels of each blob in the colour of its state."""
    made, labels = _labelled(spark, sf_dir)
    state = tiles.states(tiles.tier_passes(made)).select("image_id", "blob_id", "state")
    return png.painted(components.labelled_pixels(made, labels.join(state, ["image_id", "blob_id"]), ["state"]), png.state_colour())


def grid_overlay(spark, sf_dir):
    cells = _pixels(spark, sf_dir).withColumn("k", colour.by_label(F.col("blob_id")))
    return png.grid_lines(cells.select("image_id", "r", "c", "k.*"), 100)


def frame_pixel_count(spark, sf_dir):
    on = lambda size: F.sum(tiles.frame_pixels(size))
    return _runs(spark, sf_dir).groupBy("image_id").agg(on(100).alias("on_100"), on(400).alias("on_400"), F.sum(F.col("e") - F.col("s") + 1).alias("pixels"))


def tile_local_components(spark, sf_dir):
    return components.blob_table(*tiles.tile_components(_runs(spark, sf_dir), 100)).select("image_id", "blob_id", "area")


def frame_layers(spark, sf_dir):
    return tiles.layer_counts(_runs(spark, sf_dir), 100)


def scan_ticks(spark, sf_dir):
    return scan.scan_clock(_dots(spark, sf_dir), DOTS, 10, "row")


def scan_first_found(spark, sf_dir):
    return scan.first_found(scan.scan_clock(_dots(spark, sf_dir), DOTS, 10, "diagonal"))


def scan_last_found(spark, sf_dir):
    return scan.last_found(scan.scan_clock(_dots(spark, sf_dir), DOTS, 10, "row"))


def scan_colours(spark, sf_dir):
    p = scan.scan_clock(_dots(spark, sf_dir), DOTS, 10, "row").withColumn("k", colour.brightened(colour.golden_hue(F.col("worker")), F.col("tick")))
    return p.groupBy("image_id").agg(F.sum("k.red").alias("red"), F.sum("k.green").alias("green"), F.sum("k.blue").alias("blue"))


def _channels(spark, sf_dir):
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(k, (k * 53 % 256).cast("int").alias("red"), (k * 17 % 64).cast("int").alias("green"), (k * 29 % 64).cast("int").alias("blue"))


def tolerant_vs_exact(spark, sf_dir):
    p = _channels(spark, sf_dir)
    k = F.col("p_partkey")
    exact = p.withColumns({"red": F.when(k % 5 == 0, 255).otherwise(F.col("red")), "green": F.when(k % 5 == 0, 0).otherwise(F.when(k % 7 == 0, 255).otherwise(F.col("green"))), "blue": F.when(k % 5 == 0, 0).otherwise(F.when(k % 7 == 0, 255).otherwise(F.col("blue")))})
    exact = exact.withColumn("red", F.when(k % 7 == 0, 255).otherwise(F.col("red")))
    return exact.agg(F.count_if(is_red()).alias("exact_red"), F.count_if(is_red_tolerant()).alias("red_tolerant"), F.count_if(not_white()).alias("not_white"))


def pack_unpack_rgb(spark, sf_dir):
    p = _channels(spark, sf_dir).withColumn("packed", colour.pack(F.col("red"), F.col("green"), F.col("blue"))).withColumn("k", colour.unpack(F.col("packed")))
    return p.select("p_partkey", "packed", "k.red", "k.green", "k.blue")


def worker_blue(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy(colour.worker_blue(F.col("o_custkey")).alias("blue")).agg(F.count("*").alias("n"))


def size_and_duration_text(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k, reports.bytes_text(k * k * 37).alias("size_text"), reports.duration_text(k % 2000 / F.lit(1024.0)).alias("duration_text"))


def memory_text(spark, sf_dir):
    k = F.col("o_orderkey").cast("double")
    return _table(spark, sf_dir, "orders").select("o_orderkey", reports.memory_text(k * k * k * 37).alias("memory_text"))


def occupancy(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    threads, blocks = F.col("p_size") * 32, 1 + F.col("p_partkey") % 12
    share = reports.occupancy(threads, blocks)
    return p.select("p_partkey", share.alias("share"), reports.occupancy_class(share).alias("class"))


def blocks_per_processor(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select((F.col("p_size") * 32).alias("threads"), (F.col("p_partkey") % 5 * 16).alias("shared_kb")).distinct()
    return p.withColumn("blocks", reports.blocks_per_processor(F.col("threads"), F.col("shared_kb")).cast("long"))


def queue_work(spark, sf_dir):
    sizes = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("queued"))
    work = reports.work_per_warp(F.col("queued"), F.lit(32)).cast("long")
    return sizes.select("l_suppkey", "queued", reports.queue_bytes(F.col("queued")).alias("bytes"), work.alias("work"), reports.percent(F.col("queued"), work * 32).alias("efficiency"))


def sweep_grid(spark, sf_dir):
    """The grid of sweep parameters over which the mean value of each event type is laid out."""
    grid = stats.sweep_grid(spark)
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events")).crossJoin(F.broadcast(grid))


def bench_group_stats(spark, sf_dir):
    out = stats.run_statistics(_table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", "runs", F.round("mean", 6).alias("mean"), "least", "most", F.round("deviation", 6).alias("deviation"))


def bench_topk(spark, sf_dir):
    return stats.top(_table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", 5, ["event_id"])


def bench_argmax(spark, sf_dir):
    """The event with the largest value of each type; of equal ones the first."""
    per = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.struct("value", (-F.col("event_id")).alias("less"))).alias("x"))
    return per.select("event_type", (-F.col("x.less")).alias("event_id"), "x.value")


def bench_grouping_sets(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("slot", F.col("user_id") % 4)
    type_, slot = F.col("event_type"), F.col("slot")
    return e.groupingSets([[type_], [slot], []], type_, slot).agg(F.count("*").alias("runs"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


def first_and_last(spark, sf_dir):
    out = stats.first_and_last(_table(spark, sf_dir, "events"), "value", "event_id")
    return out.select(F.round("mean", 6).alias("mean"), "most", "first", "last")


def used_workers(spark, sf_dir):
    per = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))
    return stats.used_workers(per, "n", 100)


def tanh_sum(spark, sf_dir):
    """Each value plus the sum of the hyperbolic tangents of the diagonal, with all events laid out as a square matrix."""
    e = _table(spark, sf_dir, "events")
    side = e.agg(F.ceil(F.sqrt(F.max("event_id") + 1)).alias("side"))  # one row
    laid = e.crossJoin(F.broadcast(side)).withColumns({"row": F.expr("event_id div side"), "column": F.col("event_id") % F.col("side")})
    total = laid.filter(F.col("row") == F.col("column")).agg(F.sum(F.tanh(F.col("value") / 100)).alias("total"))  # one row
    return e.crossJoin(F.broadcast(total)).groupBy("event_type").agg(F.round(F.sum(F.col("value") + F.col("total")), 4).alias("value"))


def image_blobs(spark, sf_dir):
    """The blobs of PNG images: each canvas is encoded, and the bytes of the files are decoded to runs again."""
    red = F.struct(F.lit(255).alias("red"), F.lit(0).alias("green"), F.lit(0).alias("blue"))
    drawn = png.png_files(png.painted(_runs(spark, sf_dir), red), SIZE, SIZE)
    made = images.runs_of_png(drawn, "exact_red")
    return components.blob_table(made, components.label_runs(made))


def image_file_blobs(spark, sf_dir):
    """The blobs of PNG files on disk: canvases are written by the data source, band after band, and read back through it."""
    red = F.struct(F.lit(255).alias("red"), F.lit(0).alias("green"), F.lit(0).alias("blue"))
    folder = components.new_folder(spark)
    png_source.write_png_files(png.named_bands(png.painted(_runs(spark, sf_dir), red), SIZE, SIZE), folder)
    read = png_source.read_png_files(spark, folder, "exact_red").filter("error is null")
    image = F.regexp_extract("path", r"image_(\d+)\.png\z", 1).cast("long")
    made = read.select(image.alias("image_id"), "run_id", "r", "s", "e")
    return components.blob_table(made, components.label_runs(made))


def vector_add(spark, sf_dir):
    o = _table(spark, sf_dir, "lineitem")
    return o.select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_extendedprice")).alias("total"))


_OWN = (
    scene_pixels, scene_runs, pixel_runs, blob_table_4, blob_table_8, dots_blobs_4, dots_blobs_8, blob_count, multi_image_blob_counts, object_points, seed_first_red, seeded_fill,
    bfs_levels, frontier_sizes, fill_iterations, chunk_distribution, slice_distribution, visited_ring, edge_pixels, tile_tier, tier_passes, visited_state, boundary_pixels, boundary_overlay, state_overlay, grid_overlay, frame_pixel_count, tile_local_components,
    frame_layers, scan_ticks, scan_first_found, scan_last_found, scan_colours, tolerant_vs_exact, pack_unpack_rgb, worker_blue, size_and_duration_text, memory_text, occupancy, blocks_per_processor,
    queue_work, sweep_grid, bench_group_stats, bench_topk, bench_argmax, bench_grouping_sets, first_and_last, used_workers, tanh_sum, vector_add, image_blobs, image_file_blobs, object_chunks, sql_tile_labels,
    points_in_runs,
)
QUERIES = {f.__name__: f for f in _OWN} | {f"blob_recolour_{k}": _recolour(k) for k in colour.SCHEMES}

from rasterloom.plans.sql import ORACLE_SQL  # noqa: E402, F401
