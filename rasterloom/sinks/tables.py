"""Result tables as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, megabytes) of the files under a path; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), (F.col("length") / 1024**2).alias("megabytes"))
