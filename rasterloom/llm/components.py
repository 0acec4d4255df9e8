"""Connected components by alternating large-star and small-star steps; every step is joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import written


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its partners; partial aggregation comes before the shuffle, and the join
    lets Spark split a hot u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Returns node, component: the smallest node that is reachable; nodes without an
    edge between two different nodes are not listed. Repeated edges and both directions may occur."""
    now = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct()
    now, before = written(now, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _with_least(both.select("u", "v")).filter("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        small = _with_least(large.select("u", "v"))
        small = small.select("u", "m").union(small.select(F.col("v").alias("u"), "m")).filter("u != m").distinct()
        now = written(small.select(F.col("m").alias("v"), "u"), "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def merged(joined: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components (node, component) that further edges a, b make of those given; only edges between two of them
    take part in the rounds."""
    if joined is None:
        return written(components(edges), "components")
    between = apart(edges, joined).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    between = written(between.distinct(), "between")
    if between.isEmpty():
        return joined
    more = components(between)
    onto = more.select(F.col("node").alias("component"), F.col("component").alias("onto"))
    old = joined.join(onto, "component", "left").select("node", F.coalesce("onto", "component").alias("component"))
    return written(old.union(more.join(joined, "node", "left_anti")), "components")


def apart(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """The edges between two components, with component_a and component_b."""
    for end in ("a", "b"):
        own = joined.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
        edges = edges.join(own, end, "left").withColumn(f"component_{end}", F.coalesce(f"component_{end}", end))
    return edges.filter("component_a != component_b").select("a", "b", "component_a", "component_b")
