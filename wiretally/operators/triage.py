"""Site triage: access, frameworks, login walls, probe results, and the discovery ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions import headers, pages, paths, urls
from wiretally.functions.common import str_array


def peek(df: DataFrame) -> DataFrame:
    """status + headers → accessible, bot protection, framework, recommendation. A 200 with a JSON
    type is always readable."""
    h = F.col("headers")
    json_ok = F.coalesce(
        (F.col("status") == 200) & headers.header(h, "content-type").contains("application/json"),
        F.lit(False),
    )
    staged = df.withColumn("bot", F.when(~json_ok, headers.bot_protection(h)))
    status = F.col("status")
    recommendation = (
        F.when(json_ok, "read")
        .when(status.isin(401, 407), "auth_required")
        .when(F.col("bot").isNotNull() | status.isin(403, 429) | (status >= 500), "blocked")
        .otherwise("read")
    )
    return staged.select(
        *[c for c in ("page_id",) if c in df.columns],
        "url",
        "status",
        headers.header(h, "content-type").alias("content_type"),
        headers.header(h, "server").alias("server"),
        headers.header_framework(h).alias("framework"),
        F.col("bot").alias("bot_protection"),
        (json_ok | (status.between(200, 399) & F.col("bot").isNull())).alias("accessible"),
        recommendation.alias("recommendation"),
    )


def _targets(candidates: list[str]) -> Column:
    """A constant list of paths with their positions, exploded per origin: no join is needed."""
    return F.posexplode(str_array(candidates)).alias("pos", "path")


def probe_targets(origins: DataFrame, candidates: list[str] = K.PROBE_PATHS) -> DataFrame:
    """(origin, pos, path) to probe for each distinct origin."""
    return origins.select("origin").distinct().select("origin", _targets(candidates))


def probe_results(targets: DataFrame, landed: DataFrame) -> DataFrame:
    """Targets with their landed answers; failing answers are dropped, API answers are flagged."""
    hits = targets.join(landed, ["origin", "path"], "left")
    return hits.filter(pages.is_probe_kept("status")).select(
        "origin", "pos", "path", "status", "content_type",
        pages.is_api_probe("status", "content_type", "body").alias("is_api"),
    )


def discovered_specs(df: DataFrame, probes: DataFrame) -> DataFrame:
    """(origin, spec_url, found_by): the Link header's spec first, then probed spec documents; one
    row per URL."""
    rel = F.coalesce(
        F.nullif(urls.link_header(headers.header(F.col("headers"), "link"), "describedby"), F.lit("")),
        F.nullif(urls.link_header(headers.header(F.col("headers"), "link"), "service-desc"), F.lit("")),
    )
    linked = (
        df.select(urls.url_origin("url").alias("origin"), rel.alias("spec_url"))
        .filter(F.col("spec_url").isNotNull())
        .withColumn("rank", F.lit(-1))
    )
    probed = probes.filter("is_spec").select(
        "origin", F.concat("origin", "path").alias("spec_url"), F.col("pos").alias("rank")
    )
    return (
        linked.unionByName(probed)
        .groupBy("origin", "spec_url")
        .agg(F.min("rank").alias("rank"))
        .withColumn("found_by", F.when(F.col("rank") < 0, "link").otherwise("probe"))
    )


def discovery(df: DataFrame, probes: DataFrame, specs: DataFrame) -> DataFrame:
    """Confidence per origin: a spec with endpoints is high; a high-confidence framework medium; a
    medium framework or an API probe low; else none.

    ``specs``: (origin, endpoints). The best page signals of an origin are aggregated as numbers and
    small sets of names, so an origin with most of the pages is combined map-side.
    """
    found = df.select(
        urls.url_origin("url").alias("origin"),
        pages.page_frameworks("html", "headers").alias("fw"),
        pages.page_auth("html", "headers").alias("auth"),
    ).filter(F.col("origin").isNotNull())
    per_origin = found.groupBy("origin").agg(
        F.count("*").alias("pages"),
        F.min(F.get("fw", F.lit(0))["rank"]).alias("best_rank"),
        F.bool_or("auth.auth_required").alias("auth_required"),
    )
    names = (
        found.select("origin", F.explode("fw").alias("f"))
        .groupBy("origin", F.col("f.name").alias("name"))
        .agg(F.min("f.rank").alias("rank"))
        .groupBy("origin")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("found"))
        .select("origin", F.array_join(F.transform("found", lambda x: x["name"]), ",").alias("frameworks"))
    )
    probe_side = probes.groupBy("origin").agg(F.count_if("is_api").alias("api_probes"))
    spec_side = specs.groupBy("origin").agg(F.max("endpoints").alias("spec_endpoints"))
    joined = (
        per_origin.join(names, "origin", "left")
        .join(probe_side, "origin", "left")
        .join(spec_side, "origin", "left")
    )
    confidence = (
        F.when(F.col("spec_endpoints") > 0, "high")
        .when(F.col("best_rank") == 0, "medium")
        .when((F.col("best_rank") == 1) | (F.coalesce("api_probes", F.lit(0)) > 0), "low")
        .otherwise("none")
    )
    return joined.select(
        "origin", "pages", confidence.alias("confidence"), "frameworks",
        F.coalesce("api_probes", F.lit(0)).alias("api_probes"), "auth_required",
    )


def predicted_endpoints(df: DataFrame) -> DataFrame:
    """Distinct GET endpoints the detected frameworks usually serve, tier unknown. An origin's high
    frameworks are used; its medium ones only when it has no high one."""
    rows = df.select(
        urls.url_origin("url").alias("origin"),
        F.explode(pages.page_frameworks("html", "headers")).alias("f"),
    ).filter("f.rank < 2 and origin is not null")
    options = (
        rows.select("origin", "f.rank", "f.name", F.explode("f.api_paths").alias("path"))
        .groupBy("origin", "rank", "path")
        .agg(F.min("name").alias("name"))
    )
    best = options.groupBy("origin").agg(F.min("rank").alias("rank"))
    return (
        options.join(best, ["origin", "rank"])
        .select(
            "origin",
            F.lit("GET").alias("method"),
            "path",
            paths.path_id(F.lit("GET"), "path").alias("id"),
            F.lit("unknown").alias("tier"),
            F.concat(F.lit("discovered-from-"), F.lower("name")).alias("signal"),
        )
    )


def with_passive_index(sites: DataFrame, index: DataFrame) -> DataFrame:
    """Discovery rows with what the passive index knows of the same host."""
    host = F.regexp_extract("origin", "://([^:/]+)", 1)
    return sites.withColumn("domain", host).join(
        index.select("domain", "total_hits", F.col("endpoints").alias("indexed_endpoints")),
        "domain", "left",
    )
