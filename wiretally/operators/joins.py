"""Joins of a large table with one that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wiretally.session import landed


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with an aggregate whose size a planner cannot know. The small side is landed first: the planner then
    knows its bytes, broadcasts it below Spark's own threshold, and otherwise shuffles both sides and
    splits skewed partitions."""
    return big.join(landed(small, "small-side"), on, how)
