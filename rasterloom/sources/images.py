"""Image files as runs or pixels, and the readers of result files.

Images are decoded in bands of rows inside tasks and leave them as runs of foreground pixels, so neither a row per pixel
nor a second copy of an image is ever made."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows decoded at once.
BAND = 256
RUN = "image_id long, run_id long, r long, s long, e long"
BENCHMARK = (
    "blocks_per_grid double, threads_per_block double, chunk_size double, execution_time_ms double, iterations double, pixels_processed bigint, "
    "pixels_per_second double, blocks_used bigint, threads_used bigint, warps_used bigint, block_utilization_pct double, thread_utilization_pct double, "
    "warp_utilization_pct double, time_per_iteration_ms double"
)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id (digest of the file name), height, width, channels, data (rows of B, G, R or grey bytes)."""
    im = spark.read.format("image").load(path)
    return im.select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def pixels(images: DataFrame, foreground: str | None = None) -> DataFrame:
    """One row per pixel (image_id, r, c, red, green, blue) of read_images(); grey files repeat their channel. With a
    foreground, only its pixels are made."""
    schema = "image_id long, r long, c long, red int, green int, blue int"

    def rows(key: int, top: int, band: np.ndarray) -> Iterator[dict]:
        r, c = np.nonzero(_chosen(band, foreground) if foreground else np.ones(band.shape[:2], bool))
        for at in range(0, len(r), 100_000):
            i, j = r[at : at + 100_000], c[at : at + 100_000]
            rgb = band[i, j].astype(np.int32)
            yield {"image_id": np.full(len(i), key), "r": i + top, "c": j, "red": rgb[:, 0], "green": rgb[:, 1], "blue": rgb[:, 2]}

    return _by_bands(images, _bands_of_image, rows, schema, ["image_id", "height", "width", "channels", "data"])


def runs(images: DataFrame, foreground: str) -> DataFrame:
    """Runs (image_id, run_id, r, s, e) of the foreground of read_images()."""
    return _by_bands(images, _bands_of_image, lambda key, top, band: _band_runs(key, top, _chosen(band, foreground)), RUN, ["image_id", "height", "width", "channels", "data"])


def read_png(files: DataFrame, foreground: str) -> DataFrame:
    """Runs of the foreground of PNG bytes (image_id, png) with a column error: a file that is null or broken has one row, without a run,
    whose error tells why."""
    return _by_bands(files, png_bands, lambda key, top, band: _band_runs(key, top, _chosen(band, foreground)), f"{RUN}, error string", ["image_id", "png"])


def runs_of_png(files: DataFrame, foreground: str) -> DataFrame:
    """The runs of read_png() without the rows that tell of broken files."""
    return read_png(files, foreground).filter("error is null").drop("error")


def _by_bands(images: DataFrame, bands, rows, schema: str, columns: list[str]) -> DataFrame:
    """mapInArrow over images, one at a time: bands(*columns after the first) gives (RGB) bands, rows(key, top, band) columns.

    Runs of a broken image are held back by their first fault; images without bytes have no rows. With a column error, both have one."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    tells = "error" in arrow.names

    def record(made: dict) -> pa.RecordBatch:
        n = len(next(iter(made.values())))
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, *rest = (batch.column(j)[i] for j in range(len(columns)))
                if not all(v.is_valid for v in rest):
                    if tells:
                        yield record({"image_id": [key.as_py()], "error": ["no bytes"]})
                    continue
                rest = [memoryview(v.as_buffer()) if pa.types.is_binary(v.type) else v.as_py() for v in rest]
                if tells:
                    error = fault(bands, rest)
                    if error:
                        yield record({"image_id": [key.as_py()], "error": [error]})
                        continue
                top = 0
                for band in bands(*rest):
                    for made in rows(key.as_py(), top, band):
                        yield record(made)
                    top += len(band)

    return images.select(*columns).mapInArrow(run, out)


def fault(bands, rest: list) -> str | None:
    """What is wrong with an image, found by decoding it once without keeping anything."""
    try:
        for _ in bands(*rest):
            pass
    except ValueError as found:
        return str(found)
    return None


def _bands_of_image(height: int, width: int, channels: int, data: memoryview) -> Iterator[np.ndarray]:
    """RGB bands of rows of B, G, R(, A) or grey bytes."""
    whole = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)
    for top in range(0, height, BAND):
        band = whole[top : top + BAND]
        yield band[:, :, 2::-1] if channels >= 3 else np.repeat(band[:, :, :1], 3, axis=2)


#: Fixed values of the PNG standard: samples of a pixel by colour type, and first column, first row and steps of each interlaced pass.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Bits of a sample that each colour type allows.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def png_bands(data: memoryview) -> Iterator[np.ndarray]:
    """8-bit RGB bands of a PNG file of any kind, inflated band by band; ValueError tells what is wrong with a broken one.

    Samples of 16 bits give their upper byte, those under 8 bits are stretched, palettes are looked up, transparency is left out.
    An interlaced image is put together before it is given out, so its task holds it whole."""
    if bytes(data[:8]) != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, squeezed, header, palette = 8, [], None, None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n:
            raise ValueError("truncated chunk")
        if kind == b"IHDR" and n == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8, n - n % 3).reshape(-1, 3)
        elif kind == b"IDAT":
            squeezed.append(body)
        at += n + 12
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, laced = header
    if depth not in DEPTHS.get(colour, ()) or laced > 1 or not width or not height or colour == 3 and palette is None:
        raise ValueError("unsupported kind of PNG file")
    lines = _Lines(squeezed, CHANNELS[colour] * depth)
    rgb = lambda raw, across: _rgb(raw, across, depth, colour, palette)
    if not laced:
        for top in range(0, height, BAND):
            yield rgb(lines.take(min(BAND, height - top), width), width)
        return
    whole = np.empty((height, width, 3), np.uint8)
    for left, top, across, down in PASSES:
        w, h = -(-(width - left) // across), -(-(height - top) // down)
        if w > 0 and h > 0:
            lines.above = None
            whole[top::down, left::across] = rgb(lines.take(h, w), w)
    for top in range(0, height, BAND):
        yield whole[top : top + BAND]


class _Lines:
    """Unfiltered rows of bytes from the compressed parts of a file."""

    def __init__(self, parts: list[memoryview], bits: int):
        self.inflated, self.left, self.bits, self.above = _inflate(parts), b"", bits, None

    def take(self, count: int, width: int) -> np.ndarray:
        stride = -(-width * self.bits // 8) + 1
        need = count * stride
        while len(self.left) < need:
            more = next(self.inflated, None)
            if more is None:
                raise ValueError("truncated image data")
            self.left += more
        rows = np.frombuffer(self.left, np.uint8, need).reshape(count, stride)
        self.left = self.left[need:]
        out = np.empty((count, stride - 1), np.uint8)
        above = np.zeros(stride - 1, np.uint8) if self.above is None else self.above
        for i, row in enumerate(rows):
            if row[0] > 4:
                raise ValueError("unknown filter")
            above = out[i] = _unfiltered(row[0], row[1:], above, max(1, self.bits // 8))
        self.above = above
        return out


def _rgb(raw: np.ndarray, width: int, depth: int, colour: int, palette: np.ndarray | None) -> np.ndarray:
    """RGB pixels of rows of bytes."""
    if depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(len(raw), -1, depth)
        samples = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width, None]
        if colour == 0:
            samples *= 255 // ((1 << depth) - 1)
    else:
        samples = raw.reshape(len(raw), width, -1)[:, :, :: depth // 8]
    if colour == 3:
        if samples.max(initial=0) >= len(palette):
            raise ValueError("colour beyond the palette")
        return palette[samples[:, :, 0]]
    return samples[:, :, :3] if colour in (2, 6) else np.repeat(samples[:, :, :1], 3, axis=2)


def _inflate(parts: list[memoryview], step: int = 1 << 20) -> Iterator[bytes]:
    inflater = zlib.decompressobj()
    try:
        for part in parts:
            rest = part
            while len(rest):
                yield inflater.decompress(rest, step)
                rest = inflater.unconsumed_tail
        yield inflater.flush()
    except zlib.error as fault:
        raise ValueError(f"broken image data: {fault}") from fault


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    """A row of samples from its filtered bytes and the row above (filters of the PNG standard)."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out, raw, up = [0] * len(row), row.tolist(), above.tolist()
    for i, x in enumerate(raw):
        a, c = (out[i - channels], up[i - channels]) if i >= channels else (0, 0)
        b = up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def _chosen(band: np.ndarray, foreground: str) -> np.ndarray:
    """The pixels of an RGB band that the named predicate takes (functions.predicates has it for columns)."""
    red, green, blue = band[:, :, 0], band[:, :, 1], band[:, :, 2]
    if foreground == "exact_red":
        return (red == 255) & (green == 0) & (blue == 0)
    if foreground == "red_tolerant":
        return (red > 200) & (green < 50) & (blue < 50)
    if foreground == "not_white":
        return ~((red == 255) & (green == 255) & (blue == 255))
    raise ValueError(f"no foreground of this name: {foreground}")


def _band_runs(key: int, top: int, chosen: np.ndarray) -> Iterator[dict]:
    """The maximal runs of the chosen pixels of a band."""
    height, width = chosen.shape
    edge = np.diff(np.pad(chosen, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, s = np.nonzero(edge == 1)
    e = np.nonzero(edge == -1)[1] - 1
    if len(r):
        yield {"image_id": np.full(len(r), key), "run_id": (r + top) * width + s, "r": r + top, "s": s, "e": e}


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).option("header", True).csv(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON reports, one document a file; broken files give a row with _corrupt_record."""
    return spark.read.option("multiLine", True).json(path)
