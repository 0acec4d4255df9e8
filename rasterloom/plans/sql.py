"""DuckDB SQL for the registered queries."""

from __future__ import annotations


def _rects(image: str) -> str:
    return f"""
rects AS (SELECT {image} AS image_id, (s_suppkey * 104729 + s_suppkey // 400 * 211) % 400 AS r0, (s_suppkey * 7919 + s_suppkey // 400 * 157) % 400 AS c0,
  5 + (s_suppkey * 17 + s_suppkey // 400) % 20 AS h, 5 + (s_suppkey * 31 + s_suppkey // 400) % 20 AS w FROM supplier),
tall AS (SELECT image_id, c0, w, unnest(range(r0, least(r0 + h, 400))) AS r FROM rects),
px AS (SELECT DISTINCT image_id, r, unnest(range(c0, least(c0 + w, 400))) AS c FROM tall)"""


_ONE, _NATIONS = _rects("s_suppkey // 400"), _rects("s_nationkey + 25 * (s_suppkey // 400)")
_DOTS = "px AS (SELECT DISTINCT o_custkey % 7 + 7 * (o_orderkey // 15000) AS image_id, o_orderkey * 7919 % 200 AS r, o_orderkey * 104729 % 49999 % 200 AS c FROM orders)"


def _labels(width: int, reach: int = 0, source: str = "px", same: str = "TRUE") -> str:
    return f"""
isl AS (SELECT *, c - row_number() OVER (PARTITION BY image_id, r, {'c // 100' if same != 'TRUE' else '0'} ORDER BY c) AS g FROM {source}),
runs AS (SELECT image_id, r * {width} + min(c) AS run_id, r, min(c) AS s, max(c) AS e FROM isl GROUP BY image_id, r, g{', c // 100' if same != 'TRUE' else ''}),
touch AS (SELECT a.image_id, a.run_id AS a, b.run_id AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.r = a.r + 1 AND a.s <= b.e + {reach} AND b.s <= a.e + {reach} AND {same}),
ways AS (SELECT image_id, a, b FROM touch UNION ALL SELECT image_id, b, a FROM touch),
reach(image_id, v, lab) AS (SELECT image_id, run_id, run_id FROM runs UNION SELECT w.image_id, w.b, reach.lab FROM reach JOIN ways w ON w.image_id = reach.image_id AND w.a = reach.v WHERE reach.lab < w.b),
labels AS (SELECT image_id, v AS run_id, min(lab) AS blob_id FROM reach GROUP BY image_id, v),
cells AS (SELECT runs.image_id, labels.blob_id, r, unnest(range(s, e + 1)) AS c FROM runs JOIN labels USING (image_id, run_id)),
blobs AS (SELECT image_id, blob_id, sum(e - s + 1)::BIGINT AS area, min(r) AS r_min, max(r) AS r_max, min(s) AS c_min, max(e) AS c_max FROM runs JOIN labels USING (image_id, run_id) GROUP BY image_id, blob_id)"""


_SCENE = f"WITH RECURSIVE {_ONE}, {_labels(400)}"
_FILL = f"""WITH RECURSIVE {_NATIONS}, {_labels(400, 1)},
lead AS (SELECT image_id, min(blob_id) AS blob_id FROM labels GROUP BY image_id),
body AS (SELECT cells.image_id, r, c FROM cells JOIN lead USING (image_id, blob_id)),
seed AS (SELECT image_id, blob_id // 400 AS r, blob_id % 400 AS c FROM lead)"""
_STEP = "(SELECT unnest([-1, 0, 1]) AS i) x, (SELECT unnest([-1, 0, 1]) AS j) y"
_LEVELS = _FILL + f""",
bfs(image_id, r, c, level) USING KEY (image_id, r, c) AS (
  SELECT image_id, r, c, 0::BIGINT FROM seed
  UNION
  SELECT DISTINCT n.image_id, n.r, n.c, f.level + 1 FROM bfs f JOIN body n ON n.image_id = f.image_id AND abs(n.r - f.r) <= 1 AND n.c BETWEEN f.c - 1 AND f.c + 1 AND n.r BETWEEN f.r - 1 AND f.r + 1
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs o WHERE o.image_id = n.image_id AND o.r = n.r AND o.c = n.c))"""
_SIZES = "SELECT image_id, level, count(*) AS pixels FROM bfs GROUP BY image_id, level"
_ON = "(r % {0} IN (0, {0} - 1) OR c % {0} IN (0, {0} - 1))".format
_TIERS = f"""{_SCENE}, per AS (SELECT image_id, blob_id, count(*) AS area, bool_or({_ON(100)}) AS a, bool_or({_ON(400)}) AS b, bool_or({_ON(800)}) AS d, count(*) FILTER ({_ON(100)}) AS frame_pixels FROM cells GROUP BY image_id, blob_id),
tiers AS (SELECT image_id, blob_id, area, CASE WHEN NOT a THEN 100 WHEN NOT b THEN 400 WHEN NOT d THEN 800 END::INT AS tile_tier, frame_pixels FROM per)"""
_CLOCK = f"""WITH {_DOTS}, k AS (SELECT *, (c // 10) * 20 + r // 10 AS worker, r % 10 AS i, c % 10 AS j FROM px),
rowwise AS (SELECT image_id, r, c, worker, i * 10 + j AS step, (i * 10 + j) * 400 + worker + 1 AS tick FROM k),
diagonal AS (SELECT image_id, r, c, worker, CASE WHEN i + j < 10 THEN (i + j) * (i + j + 1) // 2 + i ELSE 100 - (19 - i - j) * (20 - i - j) // 2 + i - (i + j - 9) END AS step FROM k)"""
_NUMBERED = f"{_SCENE}, n AS (SELECT image_id, blob_id, row_number() OVER (PARTITION BY image_id ORDER BY blob_id) AS i FROM blobs)"
_RGB = "p_partkey * 53 % 256 AS red, p_partkey * 17 % 64 AS green, p_partkey * 29 % 64 AS blue"
_HUE = "(worker * 0.618033988749895 - floor(worker * 0.618033988749895)) * 6"


def _units(n: str) -> str:
    cases = " ".join(f"WHEN {n} >= {1024**i} THEN printf('%.2f {u}', round({n} / {1024.0**i}::DOUBLE, 2))" for i, u in ((3, "GB"), (2, "MB"), (1, "KB")))
    return f"CASE {cases} ELSE printf('%.2f B', ({n})::DOUBLE) END"


def _memory(n: str) -> str:
    unit = lambda i, u: f"CASE WHEN s{i} >= 100 THEN printf('%.0f {u}', s{i}) WHEN s{i} >= 10 THEN printf('%.1f {u}', s{i}) ELSE printf('%.2f {u}', s{i}) END"
    sizes = ", ".join(f"{n} / {1024**i}::DOUBLE AS s{i}" for i in range(5))
    cases = " ".join(f"WHEN s{i - 1} >= 1000 THEN {unit(i, u)}" for i, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
    return f"SELECT o_orderkey, CASE {cases} ELSE {unit(0, 'B')} END AS memory_text FROM (SELECT o_orderkey, {sizes} FROM orders)"


ORACLE_SQL = {
    "scene_pixels": f"WITH {_ONE} SELECT image_id, r, c FROM px",
    "scene_runs": f"{_SCENE} SELECT * FROM runs",
    "pixel_runs": f"WITH RECURSIVE {_DOTS}, {_labels(200)} SELECT * FROM runs",
    "blob_table_4": f"{_SCENE} SELECT * FROM blobs",
    "blob_table_8": f"WITH RECURSIVE {_ONE}, {_labels(400, 1)} SELECT * FROM blobs",
    "dots_blobs_4": f"WITH RECURSIVE {_DOTS}, {_labels(200)} SELECT * FROM blobs",
    "dots_blobs_8": f"WITH RECURSIVE {_DOTS}, {_labels(200, 1)} SELECT * FROM blobs",
    "blob_count": f"{_SCENE} SELECT image_id, count(DISTINCT blob_id) AS blobs, sum(area)::BIGINT AS area, max(area) AS largest FROM blobs GROUP BY image_id",
    "multi_image_blob_counts": f"WITH RECURSIVE {_NATIONS}, {_labels(400)} SELECT image_id, count(*) AS blobs, sum(area)::BIGINT AS area FROM blobs GROUP BY image_id",
    "object_points": f"{_SCENE}, p AS (SELECT image_id, blob_id, count(*) AS points, arg_min(c, r * 400 + c) AS first_c, max(r) AS last_r FROM cells GROUP BY image_id, blob_id) SELECT row_number() OVER (PARTITION BY image_id ORDER BY blob_id)::INT AS object_id, * FROM p",
    "object_chunks": f"""{_SCENE}, cut AS (SELECT image_id, blob_id, r, unnest(range(s, e + 1, 50)) AS s, e FROM runs JOIN labels USING (image_id, run_id)),
o AS (SELECT image_id, blob_id, row_number() OVER (PARTITION BY image_id ORDER BY blob_id)::INT AS object_id FROM blobs),
n AS (SELECT image_id, blob_id, r, s, least(e, s + 49) - s + 1 AS n FROM cut),
f AS (SELECT *, (sum(n) OVER (PARTITION BY image_id, blob_id ORDER BY r, s) - n)::BIGINT AS first FROM n)
SELECT image_id, object_id, first // 50 AS chunk, min(first) AS first, sum(n)::BIGINT AS points, count(*) AS n_runs, arg_min(r, first) AS first_r, arg_min(s, first) AS first_c FROM f JOIN o USING (image_id, blob_id) GROUP BY image_id, object_id, chunk""",
    "sql_tile_labels": f"WITH RECURSIVE {_DOTS}, {_labels(200, 0, 'px', 'a.r // 100 = b.r // 100 AND a.s // 100 = b.s // 100')} SELECT image_id, run_id, blob_id FROM labels",
    "points_in_runs": f"{_SCENE} SELECT o_orderkey, o.image_id, run_id FROM (SELECT o_orderkey, o_orderkey // 15000 AS image_id, o_orderkey * 7919 % 400 AS r, o_orderkey * 104729 % 49999 % 400 AS c FROM orders) o JOIN runs USING (image_id, r) WHERE c BETWEEN s AND e",
    "seed_first_red": f"WITH {_NATIONS}, m AS (SELECT image_id, min(r * 400 + c) AS p FROM px GROUP BY image_id) SELECT image_id, p // 400 AS r, p % 400 AS c FROM m",
    "seeded_fill": f"{_FILL} SELECT * FROM body",
    "bfs_levels": f"{_LEVELS} SELECT * FROM bfs",
    "frontier_sizes": f"{_LEVELS} {_SIZES}",
    "fill_iterations": f"{_LEVELS} SELECT image_id, count(*) AS pixels, max(level) + 1 AS levels, (ceil((max(level) + 1) / 10.0) * 10)::BIGINT AS iterations FROM bfs GROUP BY image_id",
    "chunk_distribution": f"""{_LEVELS}, z AS ({_SIZES}), q AS (SELECT *, (pixels + 2) // 3 AS chunks FROM z),
f AS (SELECT *, CASE WHEN chunks >= 4 THEN chunks // 4 + (chunks % 4 > 0)::INT ELSE 1 END AS one FROM q)
SELECT image_id, level, pixels, chunks, least(chunks, 4) AS busy_blocks, one::BIGINT AS chunks_first_block, (CASE WHEN chunks >= 4 THEN chunks // 4 ELSE 0 END)::BIGINT AS chunks_last_block, greatest(1, (least(one * 3, pixels) + 1) // 2)::BIGINT AS items_per_warp FROM f""",
    "slice_distribution": f"{_LEVELS}, z AS ({_SIZES}), q AS (SELECT *, greatest(1, (pixels + 7) // 8) AS items FROM z) SELECT *, (pixels + items - 1) // items AS busy, pixels - ((pixels + items - 1) // items - 1) * items AS last_items FROM q",
    "visited_ring": f"{_FILL} SELECT DISTINCT image_id, r + i AS r, c + j AS c FROM body, {_STEP} WHERE r + i BETWEEN 0 AND 399 AND c + j BETWEEN 0 AND 399",
    "edge_pixels": f"WITH {_ONE} SELECT a.image_id, a.r, a.c FROM px a JOIN px b ON a.image_id = b.image_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND abs(b.r - a.r) <= 1 GROUP BY ALL HAVING count(*) < 9",
    "tile_tier": f"{_TIERS} SELECT * FROM tiers",
    "tier_passes": f"{_TIERS} SELECT size::INT AS tile_size, count(*) FILTER (tile_tier = size) AS done, count(*) FILTER (coalesce(tile_tier, 801) > size) AS put_off FROM tiers, (SELECT unnest([100, 400, 800]) AS size) GROUP BY size",
    "visited_state": f"{_TIERS}, s AS (SELECT CASE tile_tier WHEN 100 THEN 1 WHEN 400 THEN 2 ELSE 3 END AS state, area FROM tiers) SELECT state, count(*) AS blobs, sum(area)::BIGINT AS pixels FROM s GROUP BY state",
    "boundary_pixels": f"{_SCENE}, m AS (SELECT image_id, blob_id, min(r * 400 + c) AS p FROM cells WHERE {_ON(100)} GROUP BY image_id, blob_id) SELECT image_id, blob_id, p // 400 AS r, p % 400 AS c, 100 AS tile_size FROM m",
    "boundary_overlay": f"{_SCENE}, m AS (SELECT image_id, min(r * 400 + c) AS p FROM cells WHERE {_ON(100)} GROUP BY image_id, blob_id) SELECT image_id, p // 400 AS r, p % 400 AS c, 0 AS red, 255 AS green, 0 AS blue FROM m",
    "state_overlay": f"{_TIERS}, s AS (SELECT image_id, blob_id, CASE tile_tier WHEN 100 THEN 1 WHEN 400 THEN 2 ELSE 3 END AS state FROM tiers) SELECT image_id, r, c, [128, 255, 0][state] AS red, [128, 0, 255][state] AS green, [128, 0, 0][state] AS blue FROM cells JOIN s USING (image_id, blob_id)",
    "grid_overlay": f"{_SCENE}, p AS (SELECT *, (r % 100 > 0 AND c % 100 > 0)::INT AS shown FROM cells) SELECT image_id, r, c, shown * (blob_id * 123457 % 256)::INT AS red, shown * (blob_id * 98765 % 256)::INT AS green, shown * (blob_id * 54321 % 256)::INT AS blue FROM p",
    "frame_pixel_count": f"WITH {_ONE} SELECT image_id, count(*) FILTER ({_ON(100)}) AS on_100, count(*) FILTER ({_ON(400)}) AS on_400, count(*) AS pixels FROM px GROUP BY image_id",
    "tile_local_components": f"WITH RECURSIVE {_ONE}, inner_px AS (SELECT * FROM px WHERE NOT {_ON(100)}), {_labels(400, 0, 'inner_px', 'a.r // 100 = b.r // 100 AND a.s // 100 = b.s // 100')} SELECT image_id, blob_id, area FROM blobs",
    "frame_layers": f"WITH {_ONE} SELECT least(r % 100, c % 100, 99 - r % 100, 99 - c % 100) AS layer, count(*) AS pixels FROM px GROUP BY layer",
    "scan_ticks": f"{_CLOCK} SELECT * FROM rowwise",
    "scan_first_found": f"{_CLOCK}, t AS (SELECT *, step * 400 + worker + 1 AS tick FROM diagonal) SELECT image_id, TRUE AS found, arg_min(r, tick) AS r, arg_min(c, tick) AS c, min(tick) AS tick FROM t GROUP BY image_id",
    "scan_last_found": f"{_CLOCK} SELECT image_id, TRUE AS found, arg_max(r, tick) AS r, arg_max(c, tick) AS c, max(tick) AS tick FROM rowwise GROUP BY image_id",
    "scan_colours": f"""{_CLOCK}, h AS (SELECT *, floor({_HUE})::INT AS x, {_HUE} - floor({_HUE}) AS f, 0.2 + 0.8 * least(1.0::DOUBLE, tick / 10000.0::DOUBLE) AS b FROM rowwise),
g AS (SELECT *, floor(f * 255) AS hi, floor((1 - f) * 255) AS lo FROM h),
w AS (SELECT image_id, b, [255, lo, 0, 0, hi, 255][x + 1] AS red, [hi, 255, 255, lo, 0, 0][x + 1] AS green, [0, 0, hi, 255, 255, lo][x + 1] AS blue FROM g)
SELECT image_id, sum(least(255, floor(red * b)))::BIGINT AS red, sum(least(255, floor(green * b)))::BIGINT AS green, sum(least(255, floor(blue * b)))::BIGINT AS blue FROM w GROUP BY image_id""",
    "tolerant_vs_exact": f"""WITH a AS (SELECT p_partkey AS k, {_RGB} FROM part),
b AS (SELECT CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 255 ELSE red END AS red, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN 255 ELSE green END AS green, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN 255 ELSE blue END AS blue FROM a)
SELECT count(*) FILTER (red = 255 AND green = 0 AND blue = 0) AS exact_red, count(*) FILTER (red > 200 AND green < 50 AND blue < 50) AS red_tolerant, count(*) FILTER (NOT (red = 255 AND green = 255 AND blue = 255)) AS not_white FROM b""",
    "pack_unpack_rgb": f"WITH a AS (SELECT p_partkey, {_RGB} FROM part) SELECT p_partkey, (red * 65536 + green * 256 + blue)::INT AS packed, red::INT AS red, green::INT AS green, blue::INT AS blue FROM a",
    "worker_blue": "SELECT o_custkey * 4 % 255 AS blue, count(*) AS n FROM orders GROUP BY blue",
    "size_and_duration_text": f"SELECT o_orderkey, {_units('o_orderkey * o_orderkey * 37')} AS size_text, CASE WHEN s < 0.001 THEN printf('%.3f ms', round(s * 1000, 3)) WHEN s < 1 THEN printf('%.2f ms', round(s * 1000, 2)) ELSE printf('%.2f s', round(s, 2)) END AS duration_text FROM (SELECT o_orderkey, (o_orderkey % 2000) / 1024.0::DOUBLE AS s FROM orders)",
    "memory_text": _memory("o_orderkey::DOUBLE * o_orderkey::DOUBLE * o_orderkey::DOUBLE * 37"),
    "occupancy": "WITH a AS (SELECT p_partkey, p_size * 32 * (1 + p_partkey % 12) / 1536::DOUBLE AS share FROM part) SELECT p_partkey, share, CASE WHEN share >= 0.75 THEN 'high' WHEN share >= 0.5 THEN 'medium' ELSE 'low' END AS class FROM a",
    "blocks_per_processor": "WITH a AS (SELECT DISTINCT p_size * 32 AS threads, p_partkey % 5 * 16 AS shared_kb FROM part) SELECT threads, shared_kb, least(24, 1536 // threads, CASE WHEN shared_kb > 0 THEN 100 // shared_kb ELSE 24 END)::BIGINT AS blocks FROM a",
    "queue_work": "WITH a AS (SELECT l_suppkey, count(*) AS queued FROM lineitem GROUP BY l_suppkey), b AS (SELECT *, greatest(1, (queued + 31) // 32) AS work FROM a) SELECT l_suppkey, queued, queued * 8 AS bytes, work, 100.0::DOUBLE * queued / (work * 32) AS efficiency FROM b",
    "sweep_grid": "WITH e AS (SELECT event_type, count(*) AS events FROM events GROUP BY event_type) SELECT event_type, events, blocks_per_grid, threads_per_block, chunk_size FROM e, (SELECT unnest([24, 32, 40, 48, 72, 96]) AS blocks_per_grid), (SELECT unnest([64, 128, 256, 512]) AS threads_per_block), (SELECT unnest([16, 32, 64, 128]) AS chunk_size) WHERE threads_per_block <= 1024 AND blocks_per_grid * threads_per_block <= 8192",
    "bench_group_stats": "SELECT event_type, count(value) AS runs, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type",
    "bench_topk": "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 5",
    "bench_argmax": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1",
    "bench_grouping_sets": "SELECT event_type, user_id % 4 AS slot, count(*) AS runs, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), (slot), ())",
    "first_and_last": "SELECT round(avg(value), 6) AS mean, max(value) AS most, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events",
    "used_workers": "WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id) SELECT count(*) FILTER (n > 0) AS used, 100.0::DOUBLE * count(*) FILTER (n > 0) / 100 AS used_pct FROM a",
    "tanh_sum": "WITH m AS (SELECT ceil(sqrt(max(event_id) + 1))::BIGINT AS side FROM events), t AS (SELECT sum(tanh(value / 100)) AS total FROM events, m WHERE event_id // side = event_id % side) SELECT event_type, round(sum(value + total), 4) AS value FROM events, t GROUP BY event_type",
    "image_blobs": f"{_SCENE} SELECT * FROM blobs",
    "image_file_blobs": f"{_SCENE} SELECT * FROM blobs",
    "vector_add": "SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice AS total FROM lineitem",
    "blob_recolour_label": f"{_SCENE} SELECT image_id, blob_id, (blob_id * 123457 % 256)::INT AS red, (blob_id * 98765 % 256)::INT AS green, (blob_id * 54321 % 256)::INT AS blue FROM blobs",
    "blob_recolour_ordinal": f"{_NUMBERED} SELECT image_id, blob_id, ((53 * (i - 1) + 7) % 253 + 1)::INT AS red, ((101 * (i - 1) + 11) % 253 + 1)::INT AS green, ((197 * (i - 1) + 13) % 253 + 1)::INT AS blue FROM n",
    "blob_recolour_patch": f"{_NUMBERED} SELECT image_id, blob_id, (53 * i % 254)::INT AS red, (101 * i % 254)::INT AS green, (197 * i % 254)::INT AS blue FROM n",
    "blob_recolour_dense": f"{_NUMBERED} SELECT image_id, blob_id, (37 * i % 254)::INT AS red, (73 * i % 254)::INT AS green, (19 * i % 254)::INT AS blue FROM n",
}
