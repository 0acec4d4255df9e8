"""PNG files as a Spark data source: `spark.read.format("raster_png")` gives runs of foreground, and writing bands
makes files.

    register(spark)
    spark.read.format("raster_png").load(folder).filter("foreground = 'exact_red'")

Files are reached through pyarrow's file systems (local, S3, GCS, HDFS). Stores that only Spark reads are read with its
own binaryFile source and images.read_png()."""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.functions.predicates import FOREGROUND
from rasterloom.sources.images import fault, _band_runs, _chosen, png_bands
from rasterloom.sinks.png import chunk, joined_adler

NAME = "raster_png"
SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in ("run_id", "r", "s", "e") else T.StringType()) for c in ("path", "foreground", "run_id", "r", "s", "e", "error")])
#: Bands as the writer takes them: raw deflate parts of rows in order, with checksum and length of what they hold.
BANDS = {"name": T.StringType(), "height": T.LongType(), "width": T.LongType(), "band": T.LongType(), "data": T.BinaryType(), "adler": T.LongType(), "size": T.LongType()}
#: Small files are read together, up to this many bytes a partition.
TOGETHER = 16_000_000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def register(spark: SparkSession) -> None:
    """Make the format known to a session; filters on path and foreground then go to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PngSource)


class PngSource(DataSource):
    """Options: path (a file or a folder, whose .png files are read)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PngReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if {f.name: f.dataType for f in schema} != BANDS:
            raise ValueError(f"write bands of the columns {', '.join(BANDS)}")
        return PngWriter(self.options["path"], overwrite)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class PngReader(DataSourceReader):
    """A partition for each large file or several small ones; each file's runs by foreground, a broken file one row with its error."""

    def __init__(self, path: str):
        self.path, self.paths, self.foregrounds = path, None, tuple(sorted(FOREGROUND))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            values = {x.value} if isinstance(x, EqualTo) else set(x.value) if isinstance(x, In) else None
            if values is None or x.attribute not in (("path",), ("foreground",)):
                yield x
            elif x.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            else:
                self.foregrounds = tuple(f for f in self.foregrounds if f in values)
                yield x  # rows of broken files have no foreground: Spark looks again

    def partitions(self) -> list[Files]:
        system, root = located(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root))
        found = sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith(".png"))
        parts, held, size = [], [], 0
        for path, n in found:
            if self.paths is not None and path not in self.paths:
                continue
            if held and size + n > TOGETHER:
                parts.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(SCHEMA)
        system, _ = located(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                data = memoryview(f.read_buffer())
            error = fault(png_bands, [data])
            if error:
                yield pa.RecordBatch.from_arrays([pa.array([path if c.name == "path" else error if c.name == "error" else None], c.type) for c in arrow], schema=arrow)
                continue
            top = 0
            for band in png_bands(data):
                for foreground in self.foregrounds:
                    for made in _band_runs(0, top, _chosen(band, foreground)):
                        n = len(made["r"])
                        cols = {"path": [path] * n, "foreground": [foreground] * n, "error": [None] * n}
                        yield pa.RecordBatch.from_arrays([pa.array(cols.get(c.name, made.get(c.name)), c.type) for c in arrow], schema=arrow)
                top += len(band)


@dataclass
class Staged(WriterCommitMessage):
    names: tuple[str, ...]
    folder: str


class PngWriter(DataSourceWriter):
    """Streams bands into files. A task writes into a folder of its own; commit moves the files of the tasks that
    counted to their place, abort leaves none."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[T.Row]) -> Staged:
        system, root = located(self.path)
        folder = posixpath.join(root, self.staging, uuid.uuid4().hex)
        system.create_dir(folder, recursive=True)
        names, out, sums, last = [], None, [], None
        try:
            for row in rows:
                if row.name != (names[-1] if names else None):
                    if out:
                        _finish(out, sums)
                    if row.name in names:
                        raise ValueError(f"the bands of {row.name} are not together")
                    out, sums, last = system.open_output_stream(posixpath.join(folder, row.name)), [], -1
                    names.append(row.name)
                    out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", row.width, row.height, 8, 2, 0, 0, 0)))
                if row.band != last + 1:
                    raise ValueError(f"band {last + 1} of {row.name} is missing")
                out.write(chunk(b"IDAT", (b"\x78\x9c" if not sums else b"") + bytes(row.data)))
                sums.append((row.adler, row.size))
                last = row.band
            if out:
                _finish(out, sums)
        except BaseException:
            if out and not out.closed:
                out.close()
            raise
        return Staged(tuple(names), folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = located(self.path)
        staged = [(m.folder, name) for m in messages if m for name in m.names]
        times = Counter(name for _, name in staged)
        twice = [name for name, n in times.items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several tasks have bands of the same files: {twice[:3]}")
        if self.overwrite:
            for x in system.get_file_info(pafs.FileSelector(root)):
                if x.path.endswith(".png"):
                    system.delete_file(x.path)
        for folder, name in staged:
            system.move(posixpath.join(folder, name), posixpath.join(root, name))
        system.delete_dir(posixpath.join(root, self.staging))

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = located(self.path)
        if system.get_file_info(posixpath.join(root, self.staging)).type != pafs.FileType.NotFound:
            system.delete_dir(posixpath.join(root, self.staging))


def _finish(out, sums: list[tuple[int, int]]) -> None:
    out.write(chunk(b"IDAT", struct.pack(">I", joined_adler(sums))) + chunk(b"IEND", b""))
    out.close()


def read_png_files(spark: SparkSession, path: str, foreground: str) -> DataFrame:
    """path, run_id, r, s, e, error: runs of the foreground of the files in a folder, and a row with the error of each broken one."""
    register(spark)
    read = spark.read.format(NAME).load(path)
    return read.filter((read.foreground == foreground) | read.error.isNotNull()).drop("foreground")


def write_png_files(bands: DataFrame, path: str, mode: str = "append") -> None:
    """Write bands (BANDS) as files: the bands of a file come together in order and are streamed, so no file is ever one row."""
    register(bands.sparkSession)
    bands.select(*BANDS).repartition("name").sortWithinPartitions("name", "band").write.format(NAME).mode(mode).save(path)
