"""Header maps: cleaning, authentication kinds, bot walls and frameworks. No credential value ever
leaves these functions; only kinds, names and flags do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.common import NOT_AFTER_WORD, NOT_BEFORE_WORD, c, str_array
from wiretally.functions.text import classify_token, is_likely_token


def lower_keys(headers: Column | str) -> Column:
    """Header names in lower case; the last of two equal names wins."""
    return F.aggregate(
        F.map_entries(c(headers)),
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, _v: k != F.lower(e["key"])),
            F.create_map(F.lower(e["key"]), e["value"]),
        ),
    )


def header(headers: Column | str, name: str) -> Column:
    """Value of a lower-case header name; null when missing or empty."""
    return F.nullif(F.try_element_at(c(headers), F.lit(name)), F.lit(""))


def filter_headers(headers: Column | str) -> Column:
    """Drop connection, proxy, browser and cookie headers."""
    return F.map_filter(
        c(headers),
        lambda k, _v: ~(F.lower(k).isin(K.STRIP_HEADERS) | F.lower(k).startswith("sec-")),
    )


def is_entropy_auth(name: Column, value: Column) -> Column:
    """A header no list knows whose value looks like a token."""
    low = F.lower(name)
    known = low.isin(sorted(set(K.AUTH_HEADERS + K.STRIP_HEADERS + K.NEVER_AUTH_HEADERS)))
    return ~known & ~low.startswith("sec-") & (value != "") & is_likely_token(value)


def strip_auth(headers: Column | str) -> Column:
    """Known and entropy-flagged authentication headers become ``[stored]``."""
    return F.transform_values(
        c(headers),
        lambda k, v: F.when(
            F.lower(k).isin(K.AUTH_HEADERS) | is_entropy_auth(k, v), F.lit("[stored]")
        ).otherwise(v),
    )


def auth_headers(headers: Column | str) -> Column:
    """Array of (auth_type, header) of the authentication headers, without their values."""

    def kind(k: Column, v: Column) -> Column:
        low = F.lower(k)
        return (
            F.when((low == "authorization") & (v != ""),
                   F.when(F.lower(v).startswith("bearer"), "bearer").otherwise("custom"))
            .when((low == "x-api-key") & (v != ""), "api-key")
            .when(is_entropy_auth(k, v), "custom")
        )

    found = F.transform(
        F.map_entries(c(headers)),
        lambda e: F.struct(
            kind(e["key"], e["value"]).alias("auth_type"), F.lower(e["key"]).alias("header")
        ),
    )
    return F.array_sort(F.filter(found, lambda x: x["auth_type"].isNotNull()))


def auth_priority(auth_type: Column | str) -> Column:
    return (
        F.when(c(auth_type) == "bearer", 0)
        .when(c(auth_type) == "api-key", 1)
        .when(c(auth_type) == "custom", 2)
        .otherwise(3)
    )


def auth_like_headers(headers: Column | str) -> Column:
    """Names of headers that look like credentials to the passive observer."""
    kept = F.map_filter(
        c(headers),
        lambda k, v: ~F.lower(k).isin(K.OBSERVER_SKIP_HEADERS)
        & (F.length(v) >= 8)
        & (F.lower(k).isin(K.OBSERVER_AUTH_HEADERS) | F.lower(k).rlike(K.OBSERVER_AUTH_RE)),
    )
    return F.array_sort(F.array_distinct(F.transform(F.map_keys(kept), F.lower)))


def auth_type(headers: Column | str) -> Column:
    """Bearer, Basic, Other, API Key, Cookie or null."""
    auth = F.coalesce(header(headers, "authorization"), header(headers, "Authorization"))
    return (
        F.when(auth.startswith("Bearer "), "Bearer")
        .when(auth.startswith("Basic "), "Basic")
        .when(auth.isNotNull(), "Other")
        .when(F.coalesce(header(headers, "x-api-key"), header(headers, "X-Api-Key")).isNotNull(),
              "API Key")
        .when(F.coalesce(header(headers, "cookie"), header(headers, "Cookie")).isNotNull(),
              "Cookie")
    )


def auth_label(safe_headers: Column | str) -> Column:
    """Label of an endpoint's authentication, read from the ``[stored]`` marks."""
    h = c(safe_headers)
    stored = F.array_sort(F.map_keys(F.map_filter(h, lambda _k, v: v == "[stored]")))
    return (
        F.when(F.try_element_at(h, F.lit("authorization")).contains("[stored]"), F.lit("Bearer"))
        .when(F.try_element_at(h, F.lit("x-api-key")).contains("[stored]"), F.lit("API Key"))
        .otherwise(F.coalesce(F.get(stored, F.lit(0)), F.lit("none")))
    )


def scrub_export_headers(headers: Column | str) -> Column:
    return F.transform_values(
        c(headers),
        lambda k, v: F.when(
            F.lower(k).isin(K.EXPORT_SENSITIVE_HEADERS), F.lit("[stored]")
        ).otherwise(v),
    )


def _first_name(names: Column, options: list[str], ignore_case: bool = True) -> Column:
    """The first name, in alphabetical order, that is one of the options."""
    hits = F.filter(names, lambda n: (F.lower(n) if ignore_case else n).isin(options))
    return F.get(hits, F.lit(0))


def pagination_of_params(names: Column) -> Column:
    """(kind, param, limit_param) from query parameter names; null when none fits."""
    names = F.array_sort(names)
    limit = _first_name(names, K.LIMIT_PARAMS)
    offset = _first_name(names, K.OFFSET_PARAMS)
    cursor = _first_name(names, K.CURSOR_PARAMS)
    page = _first_name(names, K.PAGE_PARAMS)

    def info(kind: str, param: Column, limit_param: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), param.alias("param"), limit_param.alias("limit_param")
        )

    none = F.lit(None).cast("string")
    return (
        F.when(offset.isNotNull(), info("offset", offset, limit))
        .when(cursor.isNotNull(), info("cursor", cursor, none))
        .when(page.isNotNull(), info("page", page, F.when(limit != page, limit)))
    )


def observed_pagination(response_headers: Column | str, names: Column) -> Column:
    """Pagination kind as the passive observer sees it: headers first, then names."""
    h = c(response_headers)
    link = F.coalesce(header(h, "link"), header(h, "Link"))

    def has(*keys: str) -> Column:
        return F.coalesce(*[header(h, k) for k in keys]).isNotNull()

    def named(*keys: str) -> Column:
        return F.arrays_overlap(names, str_array(keys))

    return (
        F.when(link.contains('rel="next"'),
               F.when(link.rlike("(?i)cursor"), "cursor")
               .when(link.rlike("(?i)page"), "page")
               .otherwise("cursor"))
        .when(has("x-next-cursor", "X-Next-Cursor"), "cursor")
        .when(has("x-has-more", "X-Has-More"), "cursor")
        .when(has("x-total-count", "X-Total-Count"), "offset")
        .when(named("cursor", "after", "before"), "cursor")
        .when(named("offset"), "offset")
        .when(named("page"), "page")
    )


def anti_bot_signals(
    headers: Column, cookies: Column, body: Column, status: Column, content_type: Column
) -> Column:
    """cloudflare, akamai, rate-limited, captcha and challenge marks, in this order."""
    h = lower_keys(headers)
    captcha = (
        rf"(?i){NOT_AFTER_WORD}(?:captcha|hcaptcha|recaptcha|cf-turnstile){NOT_BEFORE_WORD}"
    )
    limited = F.exists(F.map_keys(h), lambda k: k.startswith("x-ratelimit"))
    return F.array_compact(
        F.array(
            F.when(header(h, "cf-ray").isNotNull() | header(h, "cf-cache-status").isNotNull()
                   | F.coalesce(cookies.contains("__cf_bm"), F.lit(False)), "cloudflare"),
            F.when(cookies.contains("_abck"), "akamai"),
            F.when(header(h, "retry-after").isNotNull() | limited, "rate-limited"),
            F.when(body.rlike(captcha), "captcha"),
            F.when((status == 403) & content_type.contains("text/html")
                   & ~content_type.contains("json"), "challenge"),
        )
    )


def replay_tier(safe_headers: Column | str) -> Column:
    """orange when a CSRF header is needed, yellow when stored authentication is, else green."""
    h = c(safe_headers)
    csrf = F.exists(F.map_keys(h), lambda k: F.lower(k).rlike("csrf|xsrf"))
    stored = F.exists(F.map_values(h), lambda v: v == "[stored]")
    return F.when(csrf, "orange").when(stored, "yellow").otherwise("green")


def replay_signals(safe_headers: Column | str) -> Column:
    h = c(safe_headers)
    csrf = F.exists(F.map_keys(h), lambda k: F.lower(k).rlike("csrf|xsrf"))
    stored = F.exists(F.map_values(h), lambda v: v == "[stored]")
    return F.array_compact(F.array(F.when(stored, "auth-required"), F.when(csrf, "csrf-token")))


def bot_protection(headers: Column | str) -> Column:
    """cloudflare, perimeterx, datadome or null."""
    h = c(headers)
    keys = F.map_keys(h)
    return (
        F.when(header(h, "cf-ray").isNotNull() | header(h, "cf-cache-status").isNotNull(),
               "cloudflare")
        .when(F.exists(keys, lambda k: k.startswith("x-px-")), "perimeterx")
        .when(F.exists(keys, lambda k: k.startswith("x-datadome")), "datadome")
    )


def header_framework(headers: Column | str) -> Column:
    """Server framework told by the response headers."""
    h = c(headers)
    powered = header(h, "x-powered-by")
    return (
        F.when(powered.rlike(r"(?i)next\.js"), "next.js")
        .when(powered.rlike("(?i)express"), "express")
        .when(powered.rlike("(?i)php"), "php")
        .when(header(h, "link").contains("api.w.org"), "wordpress")
        .when(header(h, "x-shopify-stage").isNotNull(), "shopify")
        .when(F.exists(F.map_keys(h), lambda k: k.startswith("x-drupal-")), "drupal")
    )


def login_success(headers: Column | str, status: Column | str) -> Column:
    """A 2xx that carries a bearer/basic header, or sets a session-like cookie."""
    auth = header(headers, "authorization")
    cookie = F.trim(F.substring_index(header(headers, "set-cookie"), "=", 1))
    return F.coalesce(
        c(status).between(200, 299)
        & (
            F.coalesce(auth.startswith("Bearer ") | auth.startswith("Basic "), F.lit(False))
            | F.coalesce(is_session_cookie(cookie) & ~cookie.rlike(K.TRACKING_COOKIE_RE),
                         F.lit(False))
        ),
        F.lit(False),
    )


def is_session_cookie(name: Column | str) -> Column:
    return c(name).rlike(K.SESSION_COOKIE_RE)


def is_login_cookie(name: Column | str) -> Column:
    """Session-like, and neither a tracking nor an anonymous cookie."""
    return (
        is_session_cookie(name)
        & ~c(name).rlike(K.TRACKING_COOKIE_RE)
        & ~c(name).rlike(K.ANONYMOUS_COOKIE_RE)
    )


def token_confidence(value: Column | str) -> Column:
    return classify_token(value)["confidence"]
