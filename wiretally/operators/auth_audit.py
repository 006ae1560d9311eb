"""Authentication facts from traffic: kinds, header names, expiries, OAuth flows. No values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions import auth, headers, text, urls
from wiretally.functions.common import ordinal


def auth_headers_seen(ex: DataFrame) -> DataFrame:
    """(domain, header, auth_type) with counts. Counting happens before the shuffle, so a domain
    with most of the traffic sends no more rows than any other."""
    rows = ex.select(
        urls.url_host("url").alias("domain"),
        ordinal("ts_us", "seq").alias("ord"),
        F.explode(headers.auth_headers("request_headers")).alias("a"),
    )
    return rows.groupBy("domain", F.col("a.header").alias("header"),
                        F.col("a.auth_type").alias("auth_type")).agg(
        F.count("*").alias("uses"), F.min("ord").alias("first_ord")
    )


def dedup_auth(seen: DataFrame) -> DataFrame:
    """One row per domain: the primary authentication (best kind, then first seen) and all header
    names."""
    best = F.struct(headers.auth_priority("auth_type"), F.col("first_ord"))
    return seen.groupBy("domain").agg(
        F.min_by("auth_type", best).alias("auth_type"),
        F.min_by("header", best).alias("header"),
        F.array_sort(F.collect_set("header")).alias("headers"),
        F.sum("uses").alias("uses"),
    )


def token_expiries(ex: DataFrame, as_of_s: Column | int) -> DataFrame:
    """Expiry of every bearer JWT, and whether it has to be renewed at ``as_of_s``."""
    now = as_of_s if isinstance(as_of_s, Column) else F.lit(as_of_s)
    claims = text.jwt_claims(
        text.strip_bearer(headers.header(F.col("request_headers"), "authorization"))
    )
    return (
        ex.select("seq", urls.url_host("url").alias("domain"), claims.alias("claims"))
        .filter(F.col("claims").isNotNull())
        .select(
            "seq",
            "domain",
            F.col("claims.exp").cast("bigint").alias("exp_s"),
            F.col("claims.iss").alias("issuer"),
            F.col("claims.scope").alias("scope"),
            text.is_expired(F.col("claims.exp"), now).alias("expired"),
        )
    )


def oauth_flows(ex: DataFrame) -> DataFrame:
    """OAuth token requests and what their responses said about the token."""
    request = auth.oauth_request("url", "method", "request_headers", "request_body")
    response = auth.oauth_response("url", "status", "response_body")
    return (
        ex.select("seq", urls.url_host("url").alias("domain"), request.alias("q"),
                  response.alias("r"))
        .filter(F.col("q").isNotNull() | F.col("r").isNotNull())
        .select(
            "seq", "domain", "q.token_endpoint", "q.client_id", "q.grant_type", "q.scope",
            "q.has_secret", F.col("r.expires_in").alias("expires_in"),
            F.col("r.token_type").alias("token_type"),
            F.coalesce(F.col("r.has_refresh"), F.lit(False)).alias("returns_refresh"),
        )
    )


def lookup_with_parents(domains: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored authentication of each domain, or of its nearest parent that has not expired; when all
    are expired, the domain's own. ``stored``: (domain, auth_type, header, expired).

    A host is exploded to its suffixes, so this is an equi-join on the suffix."""
    wanted = domains.select("domain").distinct().select(
        "domain", F.posexplode(urls.host_suffixes("domain")).alias("distance", "suffix")
    )
    hits = wanted.join(
        stored.select(F.col("domain").alias("suffix"), "auth_type", "header", "expired"), "suffix"
    ).filter(~F.col("expired") | (F.col("distance") == 0))
    best = F.struct(F.col("expired").cast("int"), F.col("distance"))
    found = hits.groupBy("domain").agg(
        F.min_by("suffix", best).alias("found_at"),
        F.min_by("auth_type", best).alias("auth_type"),
        F.min_by("header", best).alias("header"),
        F.min_by("expired", best).alias("expired"),
    )
    return domains.select("domain").distinct().join(found, "domain", "left")


def audit(catalog: DataFrame, auth_domains: DataFrame) -> DataFrame:
    """Catalog domains with an endpoint count and a yes/no authentication flag."""
    known = auth_domains.select("domain").distinct().withColumn("has", F.lit(True))
    return catalog.join(known, "domain", "left").select(
        "domain", "endpoints", F.when(F.col("has"), "yes").otherwise("no").alias("auth"), "modified_us"
    )


def new_session_cookies(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Session-like cookies that are new or changed. Both: (session, name, value)."""
    old = baseline.select("session", "name", F.col("value").alias("old_value"))
    return (
        current.join(old, ["session", "name"], "left")
        .filter(~F.col("value").eqNullSafe(F.col("old_value")))
        .filter(headers.is_login_cookie("name"))
        .select("session", "name", F.col("old_value").isNull().alias("is_new"))
    )


def logins(ex: DataFrame) -> DataFrame:
    merged = F.map_concat(
        F.map_filter(F.col("request_headers"), lambda k, _v: k == "authorization"),
        F.map_filter(F.col("response_headers"), lambda k, _v: k == "set-cookie"),
    )
    return ex.select("seq", headers.login_success(merged, "status").alias("login"))
