"""OAuth flows and token expiry seen in traffic. Secrets are read as flags only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.bodies import as_object, parse
from wiretally.functions.common import any_of, c, let
from wiretally.functions.headers import header
from wiretally.functions.urls import parse_form, query_params, url_host

GRANTS = ["refresh_token", "client_credentials"]


def _json_texts(body: Column) -> Column:
    """Text fields of a JSON object body."""
    obj = as_object(parse(body))
    texts = F.map_filter(obj, lambda _k, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(texts, lambda _k, v: F.try_variant_get(v, "$", "string"))


def request_fields(body: Column, content_type: Column) -> Column:
    """Fields of a form or JSON body as a map."""
    is_json = F.coalesce(content_type.contains("application/json"), F.lit(False))
    return F.when(is_json, _json_texts(body)).otherwise(
        let(parse_form(body), lambda m: F.when(F.size(m) > 0, m))
    )


def basic_user(authorization: Column) -> Column:
    """User part of a Basic header; null when it has no colon."""
    plain = F.try_to_binary(F.regexp_replace(authorization, "^Basic ", ""), F.lit("base64")).cast(
        "string"
    )
    return F.when(
        authorization.startswith("Basic ") & plain.contains(":"), F.substring_index(plain, ":", 1)
    )


def oauth_request(url: Column | str, method: Column | str, headers: Column | str,
                  body: Column | str) -> Column:
    """token endpoint, client id, grant, scope and has_secret / has_refresh flags of an OAuth token
    request; null for anything else."""
    u = c(url)
    low = F.lower(u)
    candidate = (
        (F.upper(c(method)) == "POST")
        & (low.contains("/token") | low.contains("/oauth"))
        & url_host(u).isNotNull()
        & (F.coalesce(c(body), F.lit("")) != "")
    )

    def of(x: Column) -> Column:
        fields, query = x["fields"], x["query"]

        def field(name: str) -> Column:
            return F.nullif(F.try_element_at(fields, F.lit(name)), F.lit(""))

        grant = F.coalesce(
            field("grant_type"), F.nullif(F.try_element_at(query, F.lit("grant_type")), F.lit(""))
        )
        keyed = (
            (url_host(u) == K.KEYED_TOKEN_HOST)
            & F.map_contains_key(query, "key")
            & (grant == "refresh_token")
        )
        from_basic = basic_user(header(c(headers), "authorization"))
        client = F.coalesce(field("client_id"), F.nullif(from_basic, F.lit("")))
        has_secret = field("client_secret").isNotNull() | (
            field("client_id").isNull() & from_basic.isNotNull()
        )

        def info(endpoint: Column, client_id: Column, scope: Column, secret: Column) -> Column:
            return F.struct(
                endpoint.alias("token_endpoint"),
                client_id.alias("client_id"),
                grant.alias("grant_type"),
                scope.alias("scope"),
                secret.alias("has_secret"),
                field("refresh_token").isNotNull().alias("has_refresh"),
            )

        no_text = F.lit(None).cast("string")
        return (
            F.when(fields.isNull() | ~F.coalesce(grant.isin(GRANTS), F.lit(False)), None)
            .when(F.coalesce(keyed, F.lit(False)),
                  info(u, F.try_element_at(query, F.lit("key")), no_text, F.lit(False)))
            .when(client.isNotNull(),
                  info(F.substring_index(u, "?", 1), client, field("scope"), has_secret))
        )

    return F.when(
        candidate,
        let(
            F.struct(
                request_fields(c(body), header(c(headers), "content-type")).alias("fields"),
                query_params(u).alias("query"),
            ),
            of,
        ),
    )


def oauth_response(url: Column | str, status: Column | str, body: Column | str) -> Column:
    """expires_in, token_type, scope and has_refresh of a token response. The token is dropped."""
    token_url = c(url).rlike(any_of(K.TOKEN_URL_PARTS))

    def of(v: Column) -> Column:
        def kind(name: str) -> Column:
            return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

        def text(name: str) -> Column:
            return F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))

        return F.when(
            kind("access_token") == "STRING",
            F.struct(
                F.when(kind("expires_in").rlike("^(?:BIGINT|DOUBLE|DECIMAL)"),
                       F.try_variant_get(v, "$.expires_in", "bigint")).alias("expires_in"),
                text("token_type").alias("token_type"),
                text("scope").alias("scope"),
                text("refresh_token").isNotNull().alias("has_refresh"),
            ),
        )

    return F.when(c(status).between(200, 299) & token_url, let(parse(body), of))
