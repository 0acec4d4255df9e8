"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, written as NPY
tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import arrow_map

#: Width in samples of the images that carry text payloads.
WIDTH = 64


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_ppm(a: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """8-bit grey (2-D) or 24-bit colour (3-D, RGB) BMP, rows bottom-up."""
    h, w = a.shape[:2]
    grey = a.ndim == 2
    palette = b"".join(struct.pack("<BBBB", i, i, i, 0) for i in range(256)) if grey else b""
    rows = a[::-1] if grey else a[::-1, :, ::-1].reshape(h, 3 * w)
    pad = -rows.shape[1] % 4
    body = (np.pad(rows, ((0, 0), (0, pad))) if pad else rows).astype(np.uint8).tobytes()
    start = 54 + len(palette)
    return (
        struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
        + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0)
        + palette
        + body
    )


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1..P6 to uint8 arrays (bitmaps become 0 and 255); 16-bit samples keep uint16."""
    m = re.match(rb"P([1-6])", data)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, at, nums = int(m[1]), 2, []
    while len(nums) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        nums.append(int(m[1]))
        at = m.end()
    w, h = nums[:2]
    planes = 3 if kind in (3, 6) else 1
    if kind == 1:
        body = re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", data[at:]))
        a = np.where(np.frombuffer(body, np.uint8, w * h) == 49, 0, 255).astype(np.uint8)
    elif kind in (2, 3):
        a = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * planes], dtype=np.uint16)
        a = a.astype(np.uint8) if nums[2] < 256 else a
    elif kind == 4:
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w]
        a = np.where(bits, 0, 255).astype(np.uint8).ravel()
    else:
        a = np.frombuffer(data, np.uint8 if nums[2] < 256 else ">u2", w * h * planes, at + 1)
    return a.reshape((h, w, 3) if planes == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-, 24- and 32-bit BMP to uint8 arrays; a grey palette gives a 2-D array, others RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, w, h = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits != 8:
        return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        levels = palette[:, 0]
        return rows if len(levels) == 256 and (levels == np.arange(256)).all() else levels[rows]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP file; ValueError for broken and unsupported ones."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"broken image: {e}") from e


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each output cell's area, from the integral image read at fractional corners."""
    if a.ndim == 3:
        return np.stack([area_resize(a[:, :, i], h, w) for i in range(a.shape[2])], axis=2)
    rows, cols = np.linspace(0, a.shape[0], h + 1), np.linspace(0, a.shape[1], w + 1)
    need = np.unique(np.concatenate([[0], np.floor(rows), np.ceil(rows)]).astype(np.int64))
    need = need[need < a.shape[0]]
    sums = np.add.reduceat(a, need, axis=0, dtype=np.int64)  # the integral image only at the rows that are read
    integral = np.zeros((len(need) + 1, a.shape[1] + 1))
    integral[1:, 1:] = np.cumsum(np.cumsum(sums, axis=0), axis=1)
    at = np.append(need, a.shape[0])

    def along(x: np.ndarray, grid: np.ndarray, where: np.ndarray) -> np.ndarray:
        low = np.searchsorted(grid, np.floor(where))
        high = np.searchsorted(grid, np.minimum(np.floor(where) + 1, grid[-1]))
        high = np.minimum(high, len(grid) - 1)
        f = (where - np.floor(where))[:, None]
        return x[low] * (1 - f) + x[high] * f

    corners = along(along(integral, at, rows).T, np.arange(a.shape[1] + 1), cols).T
    return np.diff(np.diff(corners, axis=0), axis=1) / ((a.shape[0] / h) * (a.shape[1] / w))


def difference_hash(a: np.ndarray) -> str:
    grey = a if a.ndim == 2 else a.mean(axis=2)
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(a: np.ndarray, side: int = 32) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(a, side, side)).astype(np.uint8))
    return out.getvalue()


def payload_image(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the image file that holds the text: samples of WIDTH a row, zeros up to a full row.

    An odd number of rows is written as BMP, an even one as PGM, so equal texts give equal files."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    full = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
    a = np.frombuffer(full, np.uint8).reshape(-1, WIDTH)
    return len(raw), (encode_bmp if len(a) % 2 else encode_pgm)(a)


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", tiles: bool = True) -> DataFrame:
    """Store each text as an image, read it back, and describe it.

    Returns key, n_bytes, media (the file), payload (samples read back), tile (NPY of a 32 x 32 area-resized copy),
    dhash. Null and empty texts give one row of zero samples; null keys stay; repeated rows give repeated results; texts
    may be of any length; other columns are ignored; an empty table gives an empty one."""

    def step(cols: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("key", "n_bytes", "media", "payload", "tile", "dhash")}
        for k, t in zip(cols["key"], cols["text"]):
            n, media = payload_image(t)
            a = decode(media)
            for name, v in zip(out, (k, n, media, a.tobytes(), npy_tile(a) if tiles else None, difference_hash(a))):
                out[name].append(v)
        yield out

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = arrow_map(rows, step, f"key {kind}, n_bytes long, media binary, payload binary, tile binary, dhash string")
    return made.withColumnRenamed("key", key)


def decode_column(df: DataFrame, key: str = "doc_id", data: str = "data", side: int = 32) -> DataFrame:
    """Decode a column of image files. Returns key, height, width, channels, tile (NPY of a side x side copy), dhash, error.

    Null, empty, broken and unsupported files keep their row, with the reason in error and nulls beside it; repeated
    rows give repeated results; other columns are ignored; an empty table gives none."""

    def step(cols: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("key", "height", "width", "channels", "tile", "dhash", "error")}
        for k, raw in zip(cols["key"], cols["data"]):
            row = (None,) * 5
            try:
                a, error = decode(raw or b""), None
                row = (*a.shape[:2], a.shape[2] if a.ndim == 3 else 1, npy_tile(a, side), difference_hash(a))
            except ValueError as e:
                error = str(e)
            for name, v in zip(out, (k, *row, error)):
                out[name].append(v)
        yield out

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(data).alias("data"))
    return arrow_map(rows, step, f"key {kind}, height int, width int, channels int, tile binary, dhash string, error string").withColumnRenamed("key", key)


def media_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """media_columns() with digests in place of the binary columns, taken in the task that reads the file back.

    Nulls, empty and long texts, repeated rows, other columns and empty tables are treated as there."""

    def step(cols: dict) -> Iterator[dict]:
        names = ("key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")
        out: dict[str, list] = {k: [] for k in names}
        for k, t in zip(cols["key"], cols["text"]):
            n, media = payload_image(t)
            a = decode(media)
            got = a.tobytes()
            row = (k, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(a), hashlib.sha256(npy_tile(a)).hexdigest())
            for name, v in zip(names, row):
                out[name].append(v)
        yield out

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    return arrow_map(rows, step, schema).withColumnRenamed("key", key)
