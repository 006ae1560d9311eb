"""Reports over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions import headers
from wiretally.functions.common import round_half_up


def savings_pct(replay: Column, browser: Column) -> Column:
    """One decimal, a half rounded up also below zero; 0 when there is no browser cost."""
    share = F.lit(1.0) - replay / browser
    return F.when(browser > 0, round_half_up(share * 1000) / F.lit(10.0)).otherwise(F.lit(0.0))


def _tokens(size: Column) -> Column:
    return round_half_up(size / F.lit(4.0)).cast("bigint")


def token_savings(domains: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Per domain and, with a null domain, in total: endpoints, replayable ones, browser and replay
    tokens and the savings. The total's percentage comes from the summed tokens.

    ``domains``: (domain, dom_bytes, catalog_bytes); ``endpoints``: (domain, tier, response_bytes).
    """
    per_domain = endpoints.groupBy("domain").agg(
        F.count("*").alias("endpoints"),
        F.count_if(F.col("tier").isin("green", "yellow")).alias("replayable"),
        F.sum(F.coalesce("response_bytes", F.lit(0))).alias("response_bytes"),
    )
    rows = domains.join(per_domain, "domain", "left").select(
        "domain",
        F.coalesce("endpoints", F.lit(0)).alias("endpoints"),
        F.coalesce("replayable", F.lit(0)).alias("replayable"),
        F.coalesce("dom_bytes", F.lit(K.DEFAULT_DOM_BYTES)).cast("bigint").alias("dom_bytes"),
        _tokens(F.coalesce("dom_bytes", F.lit(K.DEFAULT_DOM_BYTES))).alias("browser_tokens"),
        _tokens(F.col("catalog_bytes") + F.coalesce("response_bytes", F.lit(0))).alias("replay_tokens"),
    )
    summed = rows.rollup("domain").agg(
        F.sum("endpoints").alias("endpoints"), F.sum("replayable").alias("replayable"),
        F.sum("dom_bytes").alias("dom_bytes"), F.sum("browser_tokens").alias("browser_tokens"),
        F.sum("replay_tokens").alias("replay_tokens"),
    )
    return summed.withColumn(
        "savings_pct", savings_pct(F.col("replay_tokens"), F.col("browser_tokens"))
    )


def inspect_endpoints(endpoints: DataFrame) -> DataFrame:
    graphql = F.col("id").contains("graphql")
    return endpoints.select(
        "domain", "method", "path",
        F.coalesce("tier", F.lit("unknown")).alias("tier"),
        headers.auth_label("headers").alias("auth"),
        F.coalesce("response_bytes", F.lit(0)).cast("bigint").alias("response_bytes"),
        "response_type",
        "response_fields",
        F.when(graphql, F.regexp_replace("id", "^(?:get|post)-graphql-", "")).alias("graphql"),
        F.col("pagination.kind").alias("pagination"),
        F.col("pagination.param").alias("pagination_param"),
    )


def inspect_summary(inspected: DataFrame, dom_bytes: DataFrame | None = None) -> DataFrame:
    """Per domain: totals, authentication, framework told by paths, and savings."""
    sums = inspected.groupBy("domain").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("tier").isin("green", "yellow")).alias("replayable"),
        F.count_if(F.col("auth") != "none").alias("auth_required"),
        F.bool_or(F.col("path").contains("_next/")).alias("next"),
        F.bool_or(F.col("path").contains("__nuxt")).alias("nuxt"),
        F.bool_or(F.col("graphql").isNotNull()).alias("gql"),
        F.sum("response_bytes").alias("bytes"),
    )
    if dom_bytes is not None:
        sums = sums.join(dom_bytes.select("domain", "dom_bytes"), "domain", "left")
    else:
        sums = sums.withColumn("dom_bytes", F.lit(None).cast("bigint"))
    browser = _tokens(F.coalesce("dom_bytes", F.lit(0)))
    replay = _tokens(F.col("bytes"))
    return sums.select(
        "domain", "total", "replayable", "auth_required",
        F.when(F.col("next"), "Next.js").when(F.col("nuxt"), "Nuxt").when(F.col("gql"), "GraphQL").alias("framework"),
        browser.alias("browser_tokens"), replay.alias("replay_tokens"),
        savings_pct(replay, browser).alias("savings_pct"),
    )


def tier_histogram(endpoints: DataFrame) -> DataFrame:
    tiers = ["green", "yellow", "orange", "red", "unknown"]
    tier = F.coalesce("tier", F.lit("unknown"))
    return endpoints.groupBy("domain").agg(*[F.count_if(tier == t).alias(t) for t in tiers])
