"""PNG files from foreground pixels or runs: bands of rows are drawn and compressed side by side, and only their compressed bytes
come together, so the canvas is never whole. Runs are spelt out in the canvas of their band only, never as rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Rows encoded at once.
BAND = 256
#: Grey levels and colours of the visited states.
STATE_COLOURS = {0: (0, 0, 0), 1: (128, 128, 128), 2: (255, 0, 0), 3: (0, 255, 0)}


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def joined_adler(sums: list[tuple[int, int]]) -> int:
    """The Adler-32 checksum of parts put together, from the checksum and the length of each."""
    base, a, b = 65521, 1, 0
    for checksum, n in sums:
        a2, b2 = checksum & 0xFFFF, checksum >> 16
        b = (b + b2 + n * (a - 1)) % base
        a = (a + a2 - 1) % base
    return b << 16 | a


def png_bands(cells: DataFrame, height: int, width: int, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """(image_id, band, data, adler, size): raw deflate parts of 8-bit RGB rows in bands of BAND, with checksum and length of the
    rows, from pixels (image_id, r, c, red, green, blue) or runs (s and e for c); places that are not listed get the background.

    The bands are dealt to as many partitions as shuffles have, whatever the bytes of their cells: cells shrink so well in a shuffle that
    by size, a few tasks would get all of them to sort and draw."""
    count = -(-height // BAND)

    def band(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(key[1]) * BAND
        rows = np.empty((min(BAND, height - top), width, 3), np.uint8)
        rows[:] = background
        held = pdf.dropna(subset=["r"])
        r, s, e = (held[c].to_numpy(np.int64) for c in ("r", "s", "e"))
        if (s < 0).any() or (e >= width).any():
            raise ValueError(f"cells of image {key[0]} leave the canvas")
        rgb, one = held[["red", "green", "blue"]].to_numpy(np.uint8), s == e
        rows[r[one] - top, s[one]] = rgb[one]
        for i in np.flatnonzero(~one):
            rows[r[i] - top, s[i] : e[i] + 1] = rgb[i]
        raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows.reshape(len(rows), -1)], axis=1).tobytes()
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = squeeze.compress(raw) + squeeze.flush(zlib.Z_FINISH if key[1] == count - 1 else zlib.Z_FULL_FLUSH)
        return pd.DataFrame({"image_id": [key[0]], "band": [key[1]], "data": [data], "adler": [zlib.adler32(raw)], "size": [len(raw)]})

    s, e = ("c", "c") if "c" in cells.columns else ("s", "e")
    listed = cells.select("image_id", F.floor(F.col("r") / BAND).alias("band"), "r", F.col(s).alias("s"), F.col(e).alias("e"), "red", "green", "blue").filter(F.col("band").between(0, count - 1))
    every = cells.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("band"))
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = listed.unionByName(every, allowMissingColumns=True).repartition(n, "image_id", "band")
    return rows.groupBy("image_id", "band").applyInPandas(band, "image_id long, band long, data binary, adler long, size long")


def named_bands(cells: DataFrame, height: int, width: int, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """png_bands() as the PNG data source writes them: image <image_id>.png."""
    name = F.concat(F.lit("image_"), F.col("image_id").cast("string"), F.lit(".png"))
    size = {"height": F.lit(height).cast("long"), "width": F.lit(width).cast("long")}
    return png_bands(cells, height, width, background).select(name.alias("name"), *(v.alias(k) for k, v in size.items()), "band", "data", "adler", "size")


def png_files(cells: DataFrame, height: int, width: int, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """(image_id, png): whole files as rows, for small images; sources.png_source streams bands to files of any size."""

    def put_together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("band")
        body = b"\x78\x9c" + b"".join(pdf["data"]) + struct.pack(">I", joined_adler(list(zip(pdf["adler"].tolist(), pdf["size"].tolist()))))
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
        return pd.DataFrame({"image_id": [key[0]], "png": [b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", body) + chunk(b"IEND", b"")]})

    return png_bands(cells, height, width, background).groupBy("image_id").applyInPandas(put_together, "image_id long, png binary")


def painted(cells: DataFrame, colour) -> DataFrame:
    """Pixels or runs with the channels of a colour struct."""
    at = ("r", "c") if "c" in cells.columns else ("r", "s", "e")
    return cells.withColumn("k", colour).select("image_id", *at, "k.red", "k.green", "k.blue")


def state_colour(state: str = "state"):
    out = None
    for k, rgb in STATE_COLOURS.items():
        value = F.struct(*[F.lit(v).alias(n) for v, n in zip(rgb, ("red", "green", "blue"))])
        out = F.when(F.col(state) == k, value) if out is None else out.when(F.col(state) == k, value)
    return out


def boundary_overlay(boundary: DataFrame) -> DataFrame:
    """Boundary pixels in green, for a white canvas."""
    return painted(boundary, F.struct(F.lit(0).alias("red"), F.lit(255).alias("green"), F.lit(0).alias("blue")))


def mask_files(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, png) of masks: listed pixels white on black."""
    white = F.struct(*[F.lit(255).alias(k) for k in ("red", "green", "blue")])
    return png_files(painted(pixels, white), height, width, (0, 0, 0))


def grid_lines(pixels: DataFrame, every: int = 400) -> DataFrame:
    """Pixels on every n-th row or column turn black."""
    on = (F.col("r") % every == 0) | (F.col("c") % every == 0)
    return pixels.withColumns({k: F.when(on, 0).otherwise(F.col(k)) for k in ("red", "green", "blue")})
