"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def row_digest(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """32 hex digits that depend on a row's id and text; rows alike in both share it."""
    return F.md5(F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text_of(text_col)))


def unit(digest: Column, *salt: object) -> Column:
    """A hash-seeded number in [0, 1) of 52 bits, from a hex digest and a salt."""
    parts = [c if isinstance(c, Column) else F.lit(str(c)) for c in salt]
    hexed = F.substring(F.md5(F.concat_ws("|", *parts, digest)), 1, 13)
    return F.conv(hexed, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))
