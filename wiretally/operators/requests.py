"""Planning requests from the catalog: rendering, lookup, endpoint choice, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions import paths, urls
from wiretally.functions.grams import containing
from wiretally.session import landed, spread

REPLAYABLE = ["green", "yellow", "unknown"]


def should_omit(p: Column) -> Column:
    """A spec parameter without an example is not sent."""
    return F.coalesce(p["from_spec"], F.lit(False)) & (p["example"] == "")


def confidence_hint(confidence: Column, provenance: Column) -> Column:
    c = F.coalesce(confidence, F.lit(1.0))
    return (
        F.when(c >= 0.85, None)
        .when(provenance == "skeleton",
              "(observed in traffic, no response shape — first successful replay will upgrade)")
        .when(c >= 0.7, "(imported from spec — params may need adjustment)")
        .otherwise("(imported from spec — provide params explicitly, no captured examples available)")
    )


def render_requests(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rendered URL per call, one output row each; a missing domain or endpoint gives an error text.

    ``calls``: (call_id, domain, endpoint_id, params map<string,string>).
    ``catalog``: (domain, id, path, example_url, query_params as full parameters, tier).
    """
    known = catalog.select("domain").distinct().withColumn("known", F.lit(True))
    entries = catalog.select(
        "domain", F.col("id").alias("endpoint_id"), "path", "example_url", "query_params", "tier",
    ).withColumn("found", F.lit(True))
    j = calls.join(entries, ["domain", "endpoint_id"], "left").join(known, "domain", "left")
    params = F.coalesce("params", F.create_map().cast("map<string,string>"))
    defaults = paths.path_defaults("path", urls.url_path("example_url"))
    merged = F.map_zip_with(defaults, params, lambda _k, d, p: F.coalesce(p, d))
    sent = F.transform_values(
        F.map_filter("query_params", lambda _k, p: ~should_omit(p)), lambda _k, p: p["example"]
    )
    extra = F.map_filter(
        params, lambda k, _v: ~F.col("path").contains(F.concat(F.lit(":"), k)) & ~k.contains(".")
    )
    query = F.map_zip_with(sent, extra, lambda _k, d, p: F.coalesce(p, d))
    text = F.array_join(
        F.transform(
            F.array_sort(F.map_entries(query)),
            lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])),
        ),
        "&",
    )
    staged = j.withColumn("rendered", F.when(F.col("found"), paths.render_path("path", merged))).withColumn(
        "qs", F.when(F.col("found"), text)
    )
    return staged.select(
        "call_id", "domain", "endpoint_id",
        F.concat(F.lit("https://"), "domain", "rendered",
                 F.when(F.col("qs") != "", F.concat(F.lit("?"), "qs")).otherwise("")).alias("url"),
        F.when(F.col("known").isNull(),
               F.concat(F.lit('No skill file found for "'), "domain", F.lit('"')))
        .when(F.col("found").isNull(),
              F.concat(F.lit('Endpoint "'), "endpoint_id", F.lit('" not found in skill for '), "domain"))
        .alias("error"),
        F.when(F.col("known"), F.coalesce("tier", F.lit("unknown"))).alias("tier"),
    )


def pick_endpoints(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog endpoint that answers a page URL best: the first replayable GET endpoint whose
    path contains the page's path or is contained in it, else the first one.

    Distinct paths and distinct templates of a domain meet in both directions through an equality join on the strings
    of the longer one, see :func:`containing`: its output grows with what overlaps, not with pages times endpoints.

    ``pages``: (page_id, domain, path); ``catalog``: domain, id, method, path, tier, pos.
    """
    usable = catalog.filter(
        (F.col("method") == "GET") & F.coalesce("tier", F.lit("unknown")).isin(REPLAYABLE)
    ).select("domain", "id", "pos", F.col("path").alias("template"))
    order = F.struct("pos", "id")
    first = usable.groupBy("domain").agg(F.min_by("id", order).alias("first_id"))
    templates = spread(landed(usable.filter("template is not null").groupBy("domain", "template").agg(
        F.min(order).alias("best")), "templates"))
    asked = spread(landed(pages.filter("path <> '/'").select("domain", "path").distinct(), "asked-paths"))
    matched = overlapping(asked, templates.select("domain", "template")).join(
        templates, ["domain", "template"]).groupBy("domain", "path").agg(F.min("best").alias("best")).select(
        "domain", "path", F.col("best.id").alias("match_id"))
    return pages.join(matched, ["domain", "path"], "left").join(first, "domain", "left").select(
        "page_id", "domain", F.coalesce("match_id", "first_id").alias("endpoint_id"),
        F.col("match_id").isNotNull().alias("overlaps"))


def overlapping(paths: DataFrame, templates: DataFrame) -> DataFrame:
    """``domain, path, template`` where one contains the other; a pair of equal ones comes twice."""
    inside = containing(templates.select("domain", F.col("template").alias("needle")),
                        paths.select("domain", F.col("path").alias("haystack")), "domain")
    around = containing(paths.select("domain", F.col("path").alias("needle")),
                        templates.select("domain", F.col("template").alias("haystack")), "domain")
    return inside.select("domain", F.col("haystack").alias("path"), F.col("needle").alias("template")).unionByName(
        around.select("domain", F.col("needle").alias("path"), F.col("haystack").alias("template")))


def verified_tiers(endpoints: DataFrame, results: DataFrame) -> DataFrame:
    """Tier of an endpoint from a landed test call: 2xx green, 401/403 yellow, another status orange,
    no response red; without a test call the heuristic tier stays.

    ``results``: (domain, id, status, response_type), a null status for a failed connection.
    """
    r = results.select("domain", "id", "status", F.col("response_type").alias("got"), F.lit(True).alias("tried"))
    j = endpoints.select("domain", "id", "tier", "response_type").join(r, ["domain", "id"], "left")
    ok = F.col("status").between(200, 299)
    return j.select(
        "domain", "id",
        F.when(F.col("tried").isNull(), F.col("tier"))
        .when(F.col("status").isNull(), "red")
        .when(ok, "green")
        .when(F.col("status").isin(401, 403), "yellow")
        .otherwise("orange").alias("tier"),
        F.col("tried").isNotNull().alias("verified"),
        F.when(F.col("tried").isNull(), F.lit(""))
        .when(F.col("status").isNull(), "connection-failed")
        .when(ok, F.concat_ws(",", F.lit("status-match"),
                              F.when(F.col("got") == F.col("response_type"), F.lit("shape-match"))))
        .when(F.col("status").isin(401, 403), "auth-required")
        .otherwise(F.concat(F.lit("status-"), F.col("status").cast("string"))).alias("signals"),
    )
