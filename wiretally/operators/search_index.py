"""Search over catalog endpoints through postings of trigrams.

An index has two tables. ``entries`` are the endpoints with the text that is searched. ``postings`` list, for every gram of
one to three code points and every slice of a domain, the numbers of the entries that have it, sorted by gram. A search
reads the postings of its terms' grams only, which Parquet's statistics find, intersects the lists of each slice from the
rarest gram on, and fetches and checks the entries that are left. Lists never join entries of two domains or slices.

On disk both tables are clustered by a bucket of the domain: replacing a domain rewrites its bucket and no other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.grams import SIZE, grams
from wiretally.operators.catalog import BUCKETS, bucket

#: Entries of a domain in one slice, about.
SLICE = 4096
SHOWN = ["domain", "id", "method", "path", "tier", "verified"]


@dataclass(frozen=True)
class SearchIndex:
    """``entries``: the shown columns, ``text``, ``entry``, ``bucket``; ``postings``: ``gram, domain, slice, n, found``,
    ``bucket``."""

    entries: DataFrame
    postings: DataFrame


def index_entries(endpoints: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Endpoints with defaults filled, the searched text, and a number that depends on what is searched."""
    rows = endpoints.select(
        "domain", F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("method", F.lit("GET")).alias("method"),
        F.coalesce("path", F.lit("/")).alias("path"),
        F.coalesce("tier", F.lit("unknown")).alias("tier"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
    ).withColumn("text", F.lower(F.concat_ws(" ", "domain", "id", "path", "method")))
    return rows.withColumn("entry", F.xxhash64("text")).withColumn("bucket", bucket("domain", buckets))


def entry_postings(entries: DataFrame) -> DataFrame:
    """Postings of entries. Entries of equal text share a number and are one posting."""
    slices = F.greatest(F.ceil(F.col("size") / SLICE), F.lit(1))
    sizes = entries.groupBy(F.col("domain").alias("sized")).agg(F.count("*").alias("size"))
    one = entries.select("domain", "bucket", "entry", "text").dropDuplicates(["domain", "entry"])
    found = one.join(sizes, F.col("domain").eqNullSafe(F.col("sized"))).select(
        "domain", "bucket", "entry", F.pmod("entry", slices).cast("int").alias("slice"),
        F.explode(F.concat(*[grams(F.col("text"), n) for n in range(1, SIZE + 1)])).alias("gram"))
    return found.groupBy("gram", "domain", "bucket", "slice").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("entry")).alias("found"))


def build_search_index(endpoints: DataFrame, buckets: int = BUCKETS) -> SearchIndex:
    entries = index_entries(endpoints, buckets)
    return SearchIndex(entries, entry_postings(entries))


# ------------------------------------------------------------------------------------------
# on disk
# ------------------------------------------------------------------------------------------
_ORDER = {"entries": ["bucket", "domain"], "postings": ["bucket", "gram", "domain"]}


def _write(df: DataFrame, folder: str, name: str, mode: str) -> None:
    df.repartition("bucket").sortWithinPartitions(*_ORDER[name]).write.mode("overwrite").option(
        "partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{folder}/{name}")


def save_search_index(index: SearchIndex, folder: str) -> None:
    _write(index.entries, folder, "entries", "static")
    _write(index.postings, folder, "postings", "static")


def open_search_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The saved index. Rows without an entry number or gram mark buckets that were emptied."""
    return SearchIndex(spark.read.parquet(f"{folder}/entries").filter("entry is not null"),
                       spark.read.parquet(f"{folder}/postings").filter("gram is not null"))


def replace_in_search_index(spark: SparkSession, folder: str, domains: DataFrame, endpoints: DataFrame | None = None,
                            buckets: int = BUCKETS) -> None:
    """Replace everything that the index at ``folder`` has on ``domains`` by ``endpoints`` of these domains; without
    endpoints the domains are removed. Buckets of other domains are neither read nor written."""
    gone = domains.select("domain").distinct()
    touched = gone.select(bucket("domain", buckets).alias("bucket")).distinct()
    new = None if endpoints is None else build_search_index(endpoints.join(gone, "domain", "left_semi"), buckets)
    for name in ("entries", "postings"):
        saved = spark.read.parquet(f"{folder}/{name}")
        kept = saved.join(touched, "bucket", "left_semi").join(gone, "domain", "left_anti")
        # a row of nulls in every touched bucket, so that a bucket with nothing left is overwritten too
        marks = touched.select(*[
            F.col("bucket").cast(f.dataType).alias("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in saved.schema])
        rows = kept.filter("domain is not null").unionByName(marks)
        if new is not None:
            rows = rows.unionByName(getattr(new, name))
        _write(rows, folder, name, "dynamic")


# ------------------------------------------------------------------------------------------
# search
# ------------------------------------------------------------------------------------------
def query_grams(terms: list[str]) -> list[str]:
    """Grams that the text of a hit has: the trigrams of every term, or a shorter term itself."""
    found = {t[i:i + SIZE] for t in terms for i in range(max(1, len(t) - SIZE + 1))}
    return sorted(found)


def candidates(postings: DataFrame, terms: list[str]) -> DataFrame:
    """``domain, bucket, entry`` of the entries that have every gram of every term."""
    wanted = query_grams(terms)
    lists = postings.filter(F.col("gram").isin(wanted)).groupBy("domain", "bucket", "slice").agg(
        F.sort_array(F.collect_list(F.struct("n", "found"))).alias("lists"))
    # a slice's lists, one per gram of the query, from the rarest on
    whole = lists.filter(F.size("lists") == len(wanted))
    found = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0]["found"],
                        lambda acc, one: F.array_intersect(acc, one["found"]))
    return whole.select("domain", "bucket", F.explode(found).alias("entry"))


def has_terms(text: Column, terms: list[str]) -> Column:
    hit = F.lit(True)
    for term in terms:
        hit = hit & text.contains(term)
    return hit


def search(index: SearchIndex, query: str) -> DataFrame:
    """Endpoints whose text has every term. A term that starts a word is also inside the text, so
    containment is the whole rule. An empty query matches everything."""
    terms = query.lower().split()
    if not terms:
        return index.entries.select(*SHOWN)
    near = candidates(index.postings, terms)
    hits = index.entries.join(near, ["bucket", "domain", "entry"], "left_semi")
    return hits.filter(has_terms(F.col("text"), terms)).select(*SHOWN)
