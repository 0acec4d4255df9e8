"""Shared helpers: table access, written stages in the shared folder, bounded Arrow batches."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Regular expression of the white space that separates words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text handled at once inside a task; bounds the numpy temporaries.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identity(key: Column, text: Column) -> Column:
    """Digest of a row's key and text that tells null, empty and equal ones apart; rows with both equal share it."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return F.substring(F.sha2(F.concat(mark(key), F.lit(" "), mark(text)), 256), 1, 32)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, a temporary one on a local master only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="spark-llm-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


#: Folders that this process has written in a shared folder.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    folder = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written; DataFrames that read them are lost. Returns their number."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def arrow_map(df: DataFrame, step: Callable[[dict[str, list]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow whose step gets and yields columns as Python lists, for pieces of a bounded number of bytes.

    step(cols) gets a dict column -> list of values and returns (or yields) dicts of the same kind."""
    out, arrow_schema = schemas(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                for cols in step({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)}):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, out)


def schemas(ddl: str) -> tuple[T.StructType, pa.Schema]:
    """The Spark and the Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType.fromDDL(ddl)
    return out, to_arrow_schema(out)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES each (a longer row makes a slice of its own)."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * CHUNK_BYTES / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
