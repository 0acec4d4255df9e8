"""Exact dedup by content sort: sampled splitters range-partition the normalised bytes, external sorting places
equal texts next to each other, neighbours are compared in full, and one row of each group stays.

DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.llm.common import written

#: Code points of the normalised text that the splitters hold; within a range rows are sorted by the whole text.
SPLITTER_CHARS = 32
#: Rows a range that are sampled to tell hot beginnings and hot texts.
SAMPLED = 64


def normalised(text: Column) -> Column:
    """Without white space; null counts as empty."""
    return F.coalesce(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), F.lit(""))


def _sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _bodies(df: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = df.select(F.col(key).alias("id"), (-F.length(F.coalesce(F.col(text), F.lit("")))).alias("less"), normalised(F.col(text)).alias("body"))
    return rows.withColumns({"head": F.substring("body", 1, SPLITTER_CHARS), "text_sha256": digest(F.col("body"))})


def _hot(sample: DataFrame, by: str, rows: float, n: int, name: str) -> DataFrame:
    """The values that hold more than half a range's share of the sample, and into how many parts their rows are dealt
    (two a range). There are at most 2 n such values, whatever the table, so they can be broadcast."""
    parts = F.ceil(F.count("*") * (2 * n) / F.lit(rows)).cast("int")
    return F.broadcast(sample.groupBy(by).agg(parts.alias(name)).filter(F.col(name) > 1))


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after all white space is deleted; of equal ones the row with the most
    code points stays, then the smallest key. Null texts equal empty ones. Rows repeated with the same key and text
    count in group_size and get the same result. A null key sorts first. Texts may be of any length; an empty table gives
    none. Extra columns are ignored, whatever their names.

    Rows are dealt to ranges of their first characters and sorted there by the whole text; a row that equals its
    neighbour in full belongs to its run, and a run is a group. Nothing is decided by the digest. Two exceptions, told by
    a sample that only deals rows out: where many texts begin alike they go to several sorts, equal ones to the same; and
    rows of one hot text go to several sorts, whose runs then meet by the text of one row each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    share = min(1.0, SAMPLED * n / max(total, 1))
    sample = written(_bodies(df.sample(share, seed=7), key, text, digest).select("head", "text_sha256"), "sample")
    size = max(share * total, 1.0)
    rows = _bodies(df, key, text, digest).withColumn("place", F.monotonically_increasing_id())
    rows = rows.join(_hot(sample, "head", size, n, "lanes"), "head", "left").join(_hot(sample, "text_sha256", size, n, "salts"), "text_sha256", "left")
    lane = F.coalesce(F.pmod(F.xxhash64("body"), F.col("lanes")), F.lit(0))
    salt = F.coalesce(F.pmod(F.xxhash64("place"), F.col("salts")), F.lit(0))
    rows = rows.select("id", "less", "text_sha256", "head", lane.alias("lane"), salt.alias("salt"), F.col("salts").isNotNull().alias("split"), "body")

    sort = ["head", "lane", "salt"]
    near = Window.partitionBy(*sort).orderBy("body", "less", "id")
    rows = rows.repartitionByRange(n, *sort).withColumn("opens", F.coalesce(F.lag("body").over(near) != F.col("body"), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("opens").cast("long")).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("told", F.when(F.col("split") & F.col("opens"), F.col("body"))).drop("body")
    run = Window.partitionBy(*sort, "run")
    rows = rows.withColumns({"keep_id": F.first("id").over(run.orderBy("less", "id")), "group_size": F.count("*").over(run)})
    rows = written(rows.withColumn("head", F.when(F.col("split"), F.col("head"))).drop("opens"), "runs")

    opening = rows.filter("told is not null").select(F.struct("less", "id").alias("row"), "group_size", F.struct(*sort, "run").alias("at"), "told")
    groups = opening.groupBy("told").agg(F.min("row").alias("row"), F.sum("group_size").alias("group_size"), F.collect_list("at").alias("at"))
    groups = groups.select(F.explode("at").alias("at"), F.col("row.id").alias("keep_id"), "group_size").select("at.*", "keep_id", "group_size")
    out = ["id", "keep_id", "group_size", "text_sha256"]
    hot = rows.filter("split").drop("keep_id", "group_size").join(F.broadcast(groups), [*sort, "run"])  # a run each part: at most 4 n rows
    every = rows.filter("not split").select(out).union(hot.select(out))
    return every.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
