"""Trigrams of texts, and joins on texts that contain others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def grams(text: Column, size: int = SIZE) -> Column:
    """The distinct strings of ``size`` code points in a text; none in shorter texts."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.coalesce(
        F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size)))), F.array().cast("array<string>"))


def containing(needles: DataFrame, haystacks: DataFrame, group: str) -> DataFrame:
    """``group, needle, haystack`` of all pairs of a group where the haystack contains the needle.

    Where a needle lies in a haystack, the haystack has at that place a string of the needle's first character and length.
    A group's needles have few first characters (paths: one) and lengths, so each haystack gives the hashes of its
    strings of these kinds only, and an equality join finds the needles among them: it gives the pairs that match and no
    others. Both sides: distinct ``group, needle`` or ``haystack``; nulls match nothing."""
    kinds = needles.filter("needle is not null").groupBy(group, F.substring("needle", 1, 1).alias("first")).agg(
        F.collect_set(F.length("needle")).alias("lengths")).groupBy(group).agg(
        F.collect_list(F.struct("first", "lengths")).alias("kinds"))
    text = F.col("haystack")

    def strings(kind: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
                          lambda i: F.substr(text, i, F.length(kind["first"])) == kind["first"])
        return F.flatten(F.transform(kind["lengths"], lambda n: F.transform(
            F.filter(places, lambda i: i + n - 1 <= F.length(text)), lambda i: F.xxhash64(F.substr(text, i, n)))))

    found = haystacks.filter("haystack is not null").join(kinds, group).select(
        group, "haystack", F.explode(F.array_distinct(F.flatten(F.transform("kinds", strings)))).alias("key"))
    wanted = needles.select(group, "needle", F.xxhash64("needle").alias("key"))
    return found.join(wanted, [group, "key"]).filter(text.contains(F.col("needle"))).select(group, "needle", "haystack")
