"""The passive index: one row per (domain, template path) seen, and its lifecycle.

Observations are first counted per combination of small values (method, auth kind, pagination,
parameter names …) by a hash aggregate with map-side combine. Sets and "first seen" choices are then
made over these few combinations, so a hot domain costs no more than a cold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions import headers, paths, urls
from wiretally.functions.common import ordinal


def is_observable() -> Column:
    """Whether a completed exchange may enter the index."""
    return (
        urls.is_index_content_type("content_type")
        & ((F.col("status") >= 200) | (F.col("status") == 0))
        & urls.is_allowed_url("url")
        & ~urls.is_sensitive_path(F.regexp_extract("url", urls.URL_RE, 4))
    )


def observations(ex: DataFrame) -> DataFrame:
    """One narrow row per admitted exchange."""
    length = headers.header(F.col("response_headers"), "content-length").try_cast("bigint")
    path, names = F.col("__path"), F.col("params")
    # a URL is taken apart once, not at each use of a part
    parts = ex.filter(is_observable()).select(
        "ts", "ts_us", "seq", "method", "request_headers", "response_headers",
        urls.url_host("url").alias("domain"), urls.url_path("url").alias("__path"), urls.query_names("url").alias("params"))
    return parts.select(
        "ts",
        "ts_us",
        "seq",
        "domain",
        paths.parameterize_path(path).alias("path"),
        "method",
        headers.auth_type("request_headers").alias("auth_type"),
        headers.observed_pagination("response_headers", names).alias("pagination"),
        F.when(path.endswith("/graphql") | path.endswith("/gql"), "graphql").alias("type"),
        F.coalesce(length > 0, F.lit(True)).alias("has_body"),
        "params",
    )


def combinations(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per combination: the map-side half of the index; ``by``: more columns to keep apart."""
    return obs.groupBy(
        *by, "domain", "path", "method", "auth_type", "pagination", "type", "has_body", "params"
    ).agg(
        F.count("*").alias("hits"),
        F.min(ordinal("ts_us", "seq")).alias("first_ord"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )


# columns of which the first known value is kept, with the time it was first known
KNOWN = ["auth_type", "pagination", "type"]


def _first_known(column: str) -> list[Column]:
    known = F.col(column).isNotNull()
    return [
        F.min_by(F.col(column), F.when(known, F.col("first_ord"))).alias(column),
        F.min(F.when(known, F.col("first_us"))).alias(f"{column}_us"),
    ]


def _per_name(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows exploded by parameter name, and whether a row is the first of its original: counts take these
    only, while the set of names has one entry per name and not one per list of names."""
    out = rows.select("*", F.posexplode_outer("params").alias("name_pos", "name"))
    return out, F.coalesce(F.col("name_pos"), F.lit(0)) == 0


def endpoint_index(combos: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(domain, path) rows: hits, methods, first known auth kind, pagination and type, parameter
    names, any body. ``lastSeen`` is the true maximum, also under late data."""
    rows, once = _per_name(combos)
    return rows.groupBy(*by, "domain", "path").agg(
        F.sum(F.when(once, F.col("hits"))).alias("hits"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        *[x for name in KNOWN for x in _first_known(name)],
        F.bool_or("has_body").alias("has_body"),
        F.array_sort(F.collect_set("name")).alias("params"),
    )


def domain_index(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("domain").agg(
        F.sum("hits").alias("total_hits"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.count("*").alias("endpoints"),
    )


def passive_index(ex: DataFrame) -> DataFrame:
    return endpoint_index(combinations(observations(ex)))


def merge_index(*parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fold endpoint indexes into one. A value known earlier wins, whichever part it comes from."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def first(column: str) -> list[Column]:
        return [
            F.min_by(F.col(column), F.col(f"{column}_us")).alias(column),
            F.min(f"{column}_us").alias(f"{column}_us"),
        ]

    rows, once = _per_name(rows)
    return rows.groupBy(*by, "domain", "path").agg(
        F.sum(F.when(once, F.col("hits"))).alias("hits"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("methods"),
        *[x for name in KNOWN for x in first(name)],
        F.bool_or("has_body").alias("has_body"),
        F.array_sort(F.collect_set("name")).alias("params"),
    )


def lifecycle(domains: DataFrame, as_of_us: Column | int) -> DataFrame:
    """Days since a domain was last seen, and whether it is fresh, stale or to be deleted."""
    now = as_of_us if isinstance(as_of_us, Column) else F.lit(as_of_us)
    days = (now - F.col("last_us")) / F.lit(86_400_000_000.0)
    return domains.withColumn("inactive_days", days).withColumn(
        "freshness",
        F.when(days >= K.DELETE_DAYS, "deleted").when(days >= K.STALE_DAYS, "stale").otherwise("fresh"),
    )


def over_cap(domains: DataFrame) -> DataFrame:
    """One row: surviving domains and whether they exceed the cap."""
    return domains.filter("freshness <> 'deleted'").agg(
        F.count("*").alias("domains"), (F.count("*") > K.DOMAIN_CAP).alias("over_cap")
    )


def skeleton_endpoints(endpoints: DataFrame) -> DataFrame:
    """Distinct (domain, method, path) rows of the index."""
    return endpoints.select("domain", F.explode("methods").alias("method"), "path").distinct()
