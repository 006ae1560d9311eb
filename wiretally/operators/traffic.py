"""Traffic to endpoint catalog: filter, key, first exchange per endpoint, counters, body diff.

Shuffles carry only aggregates. An endpoint's attributes (headers, scrubbed parameters, response
shape, variables) are computed for its one winning exchange, not for all of its traffic: the
winner's sequence number is found by a hash aggregate over a few narrow columns, and the wide row
is fetched by an equi-join on that number, which is unique and so cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions import bodies, headers, paths, text, urls
from wiretally.functions.common import c, let, ordinal, ordinal_seq, str_array
from wiretally.operators.joins import join_small
from wiretally.session import landed, reliable


def with_reject_reason(
    ex: DataFrame,
    target: str | None = None,
    patterns: list[str] | None = None,
    exclusions: DataFrame | None = None,
) -> DataFrame:
    """Add ``domain`` and ``reason``; the reason is null for accepted traffic.

    The host lists are literals, so nothing is joined. A user's ``exclusions(domain)`` table may be
    of any size and is joined by equality; Spark broadcasts it when its measured size allows.
    """
    out = ex.withColumn("domain", urls.url_host("url"))
    scope = F.lit(None).cast("string")
    if target is not None:
        scope = F.when(
            ~F.coalesce(urls.is_domain_match("domain", F.lit(target)), F.lit(False)), "domain"
        )
    if patterns:
        scope = F.coalesce(
            scope,
            F.when(
                ~F.coalesce(
                    urls.matches_domain_glob("domain", str_array(patterns)), F.lit(False)
                ),
                "domain",
            ),
        )
    reason = F.coalesce(scope, urls.capture_reject_reason("url", "status", "content_type"))
    if exclusions is not None:
        marks = exclusions.select("domain").distinct().withColumn("__excluded", F.lit(True))
        out = out.join(marks, "domain", "left")
        reason = F.coalesce(reason, F.when(F.col("__excluded"), "excluded"))
        return out.withColumn("reason", reason).drop("__excluded")
    return out.withColumn("reason", reason)


def accepted(ex: DataFrame, **scope) -> DataFrame:
    return with_reject_reason(ex, **scope).filter(F.col("reason").isNull()).drop("reason")


def with_keys(ex: DataFrame) -> DataFrame:
    """Add the template path, the GraphQL operation, the endpoint key and the row's ordinal."""
    content_type = headers.header(F.col("request_headers"), "content-type")
    return (
        ex.withColumn("raw_path", urls.url_path("url"))
        .withColumn("path", paths.parameterize_path("raw_path"))
        .withColumn(
            "operation", bodies.exchange_operation("raw_path", content_type, "request_body")
        )
        .withColumn("key", paths.dedup_key("method", "path", F.col("operation")))
        .withColumn("ord", ordinal("ts_us", "seq"))
    )


def _rank() -> Column:
    """Captured rows before skeleton rows, then by time: one decimal, so a hash aggregate can
    take its minimum."""
    behind = F.lit("10000000000000000000000000000000000000").cast("decimal(38,0)")
    return F.when(F.col("body_missing"), F.col("ord") + behind).otherwise(F.col("ord")).cast(
        "decimal(38,0)"
    )


def endpoint_winners(keyed: DataFrame) -> DataFrame:
    """Per (domain, key): the sequence number of the exchange that supplies the attributes, how many
    exchanges there are, and when they were seen. Partial aggregation makes hot domains cheap."""
    behind = F.lit("10000000000000000000000000000000000000").cast("decimal(38,0)")
    grouped = (
        keyed.select("domain", "key", "ts_us", _rank().alias("rank"))
        .groupBy("domain", "key")
        .agg(
            F.min("rank").alias("rank"),
            F.count("*").alias("hits"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
        )
    )
    return grouped.select(
        "domain",
        "key",
        ordinal_seq(F.col("rank") % behind).alias("seq"),
        (F.col("rank") >= behind).alias("is_skeleton"),
        "hits",
        "first_us",
        "last_us",
    )


def scrub_query_params(params: Column) -> Column:
    """Sensitive names and token-like values become ``[scrubbed]``, others lose personal data."""
    return F.transform_values(
        params,
        lambda k, v: F.when(
            k.rlike(K.SENSITIVE_QUERY_RE) | text.is_likely_token(v), F.lit("[scrubbed]")
        ).otherwise(text.scrub_pii(v)),
    )


def scrub_url(url: Column | str) -> Column:
    """Replace the values of sensitive parameters inside a URL. A URL with none is unchanged."""

    def mark(p: Column) -> Column:
        name = urls.form_decode(F.substring_index(p, "=", 1))
        value = urls.form_decode(F.regexp_replace(p, r"^[^=]*=?", ""))
        return F.struct(
            p.alias("text"),
            (name.rlike(K.SENSITIVE_QUERY_RE) | text.is_likely_token(value)).alias("hot"),
        )

    def of(u: Column) -> Column:
        def rebuild(parts: Column) -> Column:
            query = F.array_join(
                F.transform(
                    parts,
                    lambda p: F.when(
                        p["hot"],
                        F.concat(F.substring_index(p["text"], "=", 1), F.lit("=%5Bscrubbed%5D")),
                    ).otherwise(p["text"]),
                ),
                "&",
            )
            return F.when(
                F.exists(parts, lambda p: p["hot"]),
                F.concat(
                    F.substring_index(u, "?", 1), F.lit("?"), query,
                    F.regexp_extract(u, r"(#.*)?$", 0),
                ),
            ).otherwise(u)

        query = urls.url_query(u)
        return F.when(query.isNull(), u).otherwise(
            let(F.transform(F.split(query, "&"), mark), rebuild)
        )

    return let(c(url), of)


def describe_endpoints(rows: DataFrame) -> DataFrame:
    """Attributes of endpoints, from one keyed exchange each."""
    safe = headers.strip_auth(headers.filter_headers("request_headers"))
    skeleton = F.col("body_missing")
    writes = F.col("method").isin("POST", "PUT", "PATCH") & (
        F.coalesce(F.col("request_body"), F.lit("")) != ""
    )
    body_type = headers.header(F.col("request_headers"), "content-type")
    json_body = body_type.contains("json")
    form_body = F.coalesce(body_type.contains("x-www-form-urlencoded"), F.lit(False))
    staged = (
        rows.withColumn("query_params", scrub_query_params(urls.query_params("url")))
        .withColumn("headers", safe)
        .withColumn("example_url", scrub_url(text.scrub_pii("url")))
        .withColumn("shape", F.when(~skeleton, bodies.response_shape("response_body")))
        .withColumn(
            "nodes",
            F.when(writes & json_body & ~skeleton, bodies.json_nodes("request_body")),
        )
    )
    graphql_vars = F.when(F.col("operation").isNotNull(), bodies.graphql_variables(F.col("nodes")))
    return staged.select(
        "domain",
        "key",
        paths.endpoint_id("method", "path", F.col("operation")).alias("id"),
        "method",
        "path",
        paths.normalize_path("path").alias("normalized_path"),
        "operation",
        "query_params",
        "headers",
        "example_url",
        F.coalesce(F.col("shape.type"), F.lit("unknown")).alias("response_type"),
        F.col("shape.fields").alias("response_fields"),
        headers.pagination_of_params(F.map_keys("query_params")).alias("pagination"),
        F.when(writes & ~skeleton, F.when(json_body & F.col("nodes").isNotNull(),
                                          "application/json").otherwise(
            F.coalesce(body_type, F.lit("application/octet-stream")))).alias("body_type"),
        F.coalesce(
            F.when(F.size(graphql_vars) >= 0, graphql_vars), bodies.body_variables(F.col("nodes"))
        ).alias("body_variables"),
        bodies.refreshable_tokens(F.col("nodes")).alias("refreshable_tokens"),
        F.when(skeleton, 0).otherwise(F.length("response_body")).cast("bigint").alias(
            "response_bytes"
        ),
        F.when(skeleton, F.lit(K.SKELETON_CONFIDENCE)).alias("confidence"),
        F.when(skeleton, F.lit("skeleton")).alias("provenance"),
        headers.replay_tier("headers").alias("tier"),
        # no body leaves this job: a template without secrets, and the types of the response's fields
        F.when(writes & ~skeleton, F.when(form_body, bodies.scrub_form("request_body")).otherwise(
            bodies.scrub_body("request_body"))).alias("request_template"),
        F.when(~skeleton, bodies.schema_nodes("response_body")).alias("response_schema"),
        *[name for name in ("hits", "first_us", "last_us") if name in rows.columns],
    )


def build_endpoints(ex: DataFrame) -> DataFrame:
    """One row per endpoint out of accepted exchanges. The first captured exchange supplies all
    attributes; an endpoint whose bodies were all lost stays a skeleton."""
    winners = endpoint_winners(with_keys(ex)).select("seq", "hits", "first_us", "last_us")
    return describe_endpoints(with_keys(join_small(ex, winners, ["seq"])))


def _second(ts_us: str) -> Column:
    return F.floor(F.col(ts_us) / F.lit(1_000_000)).cast("bigint")


def domain_counters(classified: DataFrame) -> DataFrame:
    """Per domain: accepted and filtered exchanges, and network bytes. Bytes of filtered responses
    count only from the domain's first accepted exchange on.

    ``classified`` comes from :func:`with_reject_reason`. The first accepted time is per domain, so
    bytes are summed per second first: that join runs over domain-seconds, not over traffic. Only the
    raw rows of a domain's first second are looked at one by one, by a join on domain and second.
    """
    kept = F.col("reason").isNull()
    size = F.length(F.coalesce(F.when(~F.col("body_missing"), F.col("response_body")), F.lit("")))
    declared = F.coalesce(
        headers.header(F.col("response_headers"), "content-length").try_cast("bigint"),
        F.lit(0).cast("bigint"),
    )
    rows = classified.filter(F.col("domain").isNotNull()).select(
        "domain",
        kept.alias("kept"),
        "ts_us",
        F.when(kept, size).otherwise(declared).cast("bigint").alias("bytes"),
    )
    # landed, so that traffic is classified once for all that is summed
    per_second = landed(rows.groupBy("domain", _second("ts_us").alias("second")).agg(
        F.count_if("kept").alias("captured"),
        F.count_if(~F.col("kept")).alias("filtered"),
        F.sum(F.when(F.col("kept"), F.col("bytes"))).alias("kept_bytes"),
        F.sum(F.when(~F.col("kept"), F.col("bytes"))).alias("filtered_bytes"),
        F.min(F.when(F.col("kept"), F.col("ts_us"))).alias("first_us"),
    ), "domain-seconds")
    totals = per_second.groupBy("domain").agg(
        F.sum("captured").alias("capture_count"),
        F.sum("filtered").alias("filtered_count"),
        F.min("first_us").alias("first_accepted_us"),
        F.coalesce(F.sum("kept_bytes"), F.lit(0)).alias("kept_bytes"),
    )
    first = totals.filter(F.col("first_accepted_us").isNotNull()).select(
        "domain", "first_accepted_us", _second("first_accepted_us").alias("first_second")
    )
    later = (
        per_second.select("domain", "second", "filtered_bytes")
        .join(first, "domain")
        .filter(F.col("second") > F.col("first_second"))
        .select("domain", F.col("filtered_bytes").alias("bytes"))
    )
    same = (
        rows.filter(~F.col("kept"))
        .withColumn("first_second", _second("ts_us"))
        .join(first, ["domain", "first_second"])
        .filter(F.col("ts_us") >= F.col("first_accepted_us"))
        .select("domain", "bytes")
    )
    late = later.unionByName(same).groupBy("domain").agg(F.sum("bytes").alias("late_bytes"))
    return totals.join(late, "domain", "left").select(
        "domain",
        "capture_count",
        "filtered_count",
        "first_accepted_us",
        (F.col("kept_bytes") + F.coalesce(F.col("late_bytes"), F.lit(0))).alias("network_bytes"),
    )


def primary_domain(ex: DataFrame) -> DataFrame:
    """Per session: the most frequent host; the one seen first wins a tie."""
    counts = (
        ex.select("session", urls.url_host("url").alias("domain"), ordinal("ts_us", "seq").alias("ord"))
        .filter(F.col("domain").isNotNull())
        .groupBy("session", "domain")
        .agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    )
    best = F.struct(-F.col("n"), F.col("first_ord"))
    return counts.groupBy("session").agg(
        F.min_by("domain", best).alias("primary_domain"), F.count("*").alias("domains")
    )


def first_occurrence(keyed: DataFrame) -> DataFrame:
    """Sequence number of the first exchange of each endpoint: whether an exchange is new needs no
    window over a hot domain, only a minimum per key and a join on the unique number."""
    firsts = (
        keyed.groupBy("domain", "key")
        .agg(F.min("ord").alias("ord"))
        .select(ordinal_seq("ord").alias("seq"), F.lit(True).alias("is_new"))
    )
    return join_small(keyed, firsts, ["seq"], "left").withColumn(
        "is_new", F.coalesce(F.col("is_new"), F.lit(False))
    )


# ------------------------------------------------------------------------------------------
# body diff
# ------------------------------------------------------------------------------------------
def _has_field(body: str) -> Column:
    """A form has a field when its scrubbed text has an equals sign; only authorization texts can
    lose theirs to the scrubber."""
    b = F.col(body)
    return (
        F.when(~b.contains("="), False)
        .when(b.rlike("Bearer|Basic"), text.scrub_pii(b).contains("="))
        .otherwise(True)
    )


def _with_spread(df: DataFrame, value: str, *keys: str, order: str | None = None) -> DataFrame:
    """Rows per group, and whether the value varies. A minimum of texts would force a sort
    aggregate; 128 bits of hash keep it a hash aggregate."""
    one, two = F.xxhash64(value), F.xxhash64(F.lit("second"), F.col(value))
    first = [] if order is None else [F.min(order).alias(f"first_{order}")]
    hashed = df.select(*keys, *([order] if order else []), one.alias("__h1"), two.alias("__h2"))
    out = hashed.groupBy(*keys).agg(
        *first,
        F.count("*").alias("rows"),
        F.min("__h1").alias("l1"), F.max("__h1").alias("u1"),
        F.min("__h2").alias("l2"), F.max("__h2").alias("u2"),
    )
    varies = (F.col("l1") != F.col("u1")) | (F.col("l2") != F.col("u2"))
    return out.withColumn("varies", varies).drop("l1", "u1", "l2", "u2")


def body_diff(keyed: DataFrame) -> DataFrame:
    """(domain, key, path) of request body fields that change between exchanges of one endpoint.

    Every body is compared with the first one, and comparing stops below a node that differs. A
    node can be compared when the types above it equal the first body's (``chain``). It changed when
    some body lacks it or holds another value, which is the same as: fewer rows than bodies with its
    parent, or a minimum signature that is not the maximum. So the job is one partial aggregate over
    nodes, and no body ever meets another one.
    """
    bodies_in = keyed.filter(
        ~F.col("body_missing") & F.col("method").isin("POST", "PUT", "PATCH")
    ).select(
        "domain",
        "key",
        "ord",
        "request_body",
        (F.coalesce(F.col("request_body"), F.lit("")) != "").alias("has_body"),
    )
    with_json = bodies_in.withColumn("is_json", bodies.is_json("request_body"))
    groups = (
        with_json.groupBy("domain", "key")
        .agg(
            F.min("ord").alias("first_ord"),
            F.min(F.when(F.col("has_body"), F.col("ord"))).alias("first_body_ord"),
            F.count_if("has_body").alias("bodies"),
            F.count_if(F.col("has_body") & ~F.col("is_json")).alias("plain"),
            F.count_if(F.col("has_body") & ~_has_field("request_body")).alias("empty_forms"),
        )
        .filter((F.col("first_ord") == F.col("first_body_ord")) & (F.col("bodies") > 1))
        .select("domain", "key", "first_ord", "bodies", "empty_forms",
                (F.col("plain") == 0).alias("json_mode"))
    )
    groups = reliable(groups)

    nodes = (
        with_json.filter(F.col("has_body") & F.col("is_json"))
        .select("domain", "key", "ord", F.explode(bodies.json_nodes("request_body")).alias("n"))
        .select(
            "domain", "key", "ord",
            F.col("n.path").alias("path"), F.col("n.parent").alias("parent"),
            F.col("n.chain").alias("chain"),
            F.concat_ws(
                ":",
                F.when(F.col("n.type").isin("object", "null"), "object")
                .otherwise(F.col("n.type")),
                F.when(F.col("n.type") == "array", F.col("n.size").cast("string"))
                .when(F.col("n.type") == "object", F.lit("{}"))
                .when(F.col("n.type") == "null", F.lit("null"))
                .when(F.col("n.type") == "number",
                      F.col("n.value").try_cast("double").cast("string"))
                .otherwise(bodies.scrub_node_value(
                    F.col("n.key"), F.col("n.type"), F.col("n.value"))),
            ).alias("sig"),
            F.when(F.col("n.type") == "object", F.concat(F.col("n.chain"), F.lit("o")))
            .when(F.col("n.type") == "array",
                  F.concat(F.col("n.chain"), F.lit("a"), F.col("n.size").cast("string")))
            .alias("opens"),
        )
    )
    # one pass over the bodies gives both sides of the comparison; what is kept has one row per
    # node and container type, whatever the traffic is
    base = reliable(
        _with_spread(nodes, "sig", "domain", "key", "path", "parent", "chain", "opens", order="ord")
    )
    grouped = base.groupBy("domain", "key", "path", "parent", "chain").agg(
        F.sum("rows").alias("rows"),
        (F.bool_or("varies") | (F.count("*") > 1)).alias("varies"),
    )
    parents = base.filter(F.col("opens").isNotNull()).select(
        "domain", "key", F.col("path").alias("parent"), F.col("opens").alias("chain"),
        F.col("rows").alias("parent_rows"), F.col("first_ord").alias("parent_first"),
    )
    json_changes = (
        grouped.join(parents, ["domain", "key", "parent", "chain"])
        .join(groups.filter("json_mode"), ["domain", "key"])
        .filter(F.col("parent_first") == F.col("first_ord"))
        .filter((F.col("rows") < F.col("parent_rows")) | F.col("varies"))
        .select("domain", "key", "path")
    )

    # a form without a single field makes its whole endpoint incomparable
    forms = join_small(
        with_json.filter("has_body"),
        groups.filter(~F.col("json_mode") & (F.col("empty_forms") == 0)).select("domain", "key", "bodies"),
        ["domain", "key"],
    )
    pairs = forms.select(
        "domain", "key", "bodies",
        F.explode(urls.parse_form(text.scrub_pii("request_body"))).alias("path", "value"),
    )
    form_changes = (
        _with_spread(pairs, "value", "domain", "key", "bodies", "path")
        .filter((F.col("rows") < F.col("bodies")) | F.col("varies"))
        .select("domain", "key", "path")
    )
    return json_changes.unionByName(form_changes).distinct()


def build_catalog(ex: DataFrame, **scope) -> DataFrame:
    """The whole catalog job: filter, endpoints, and body variables joined with changing fields."""
    kept = accepted(ex, **scope)
    endpoints = build_endpoints(kept)
    changed = (
        body_diff(with_keys(kept))
        .groupBy("domain", "key")
        .agg(F.array_sort(F.collect_set("path")).alias("changed"))
    )
    merged = endpoints.join(changed, ["domain", "key"], "left")
    both = F.array_sort(
        F.array_union(
            F.coalesce(F.col("body_variables"), F.array().cast("array<string>")),
            F.coalesce(F.col("changed"), F.array().cast("array<string>")),
        )
    )
    return merged.withColumn(
        "body_variables", F.when(F.col("body_type").isNotNull(), both)
    ).drop("changed")


__all__ = [
    "accepted", "body_diff", "build_catalog", "build_endpoints", "describe_endpoints",
    "domain_counters", "endpoint_winners", "first_occurrence", "primary_domain",
    "scrub_query_params", "scrub_url", "with_keys", "with_reject_reason",
]
