"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.session import landed


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (``a, b``) but the roots themselves; a root is the least node
    of its component. Each round hangs every node's larger neighbours, then its smaller ones, on the
    least node near it, until all components are stars. The rounds grow with the logarithm of the
    longest path. Links of a node to itself and nulls are ignored; without links the result is empty."""
    edges = landed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(),
        "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(
            edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", "m").distinct()
        near = large.groupBy("v").agg(F.min("m").alias("k"))
        small = large.join(near, "v").select(F.col("m").alias("high"), F.col("k").alias("low")).filter(
            "high <> low").unionAll(near.select(F.col("v").alias("high"), F.col("k").alias("low"))).distinct()
        edges = landed(small, "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
