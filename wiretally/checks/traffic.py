"""Checks of the traffic filter, paths, headers, bodies and the endpoint catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.checks.base import query
from wiretally.checks.sqlparts import (
    CLEAN, EXR, HEADER_ROWS, KEYED, WITH, b, entropy_of, in_list, lit, scrub_sql,
    templates,
)
from wiretally.functions import bodies, headers, paths, text, urls
from wiretally.operators import traffic
from wiretally.session import spread_groups, state_folder
from wiretally.sources import archives
from wiretally.sources import derived as D
from wiretally.sources.exchanges import read_exchanges, split_by_size


def ex(spark: SparkSession, sf: str) -> DataFrame:
    return D.exchanges(spark, sf)


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted exchanges with their keys: the table later jobs share."""
    return D.landed(spark, sf, "keyed", lambda: traffic.with_keys(traffic.accepted(ex(spark, sf))))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages")


@query("scan_exchanges", f"""{WITH}{EXR}
SELECT seq, ts_us, method, status, url, length(resp_body) AS body_chars, body_missing FROM exr""")
def _(spark, sf):
    return ex(spark, sf).select(
        "seq", "ts_us", "method", "status", "url",
        F.length("response_body").cast("bigint").alias("body_chars"), "body_missing",
    )


@query("archive_exchanges", f"""{WITH}{EXR}
SELECT ts_us, method, status, url, CASE WHEN NOT body_missing THEN length(resp_body) END AS body_chars, body_missing, length(req_body) AS sent_chars, h_request_id AS request_header, content_type FROM exr""")
def _(spark, sf):
    """All exchanges written as archives, and the archives read back in several tasks per file."""
    folder = state_folder(spark, "archives")
    archives.write_archives(spread_groups(ex(spark, sf)), folder)
    rows = archives.read_archives(spark, folder, split_bytes=1 << 18)
    return rows.select(
        "ts_us", "method", "status", "url", F.length("response_body").cast("bigint").alias("body_chars"), "body_missing",
        F.length("request_body").cast("bigint").alias("sent_chars"),
        F.col("request_headers")["x-request-id"].alias("request_header"), "content_type")


@query("read_exchanges", f"""{WITH}{EXR}
SELECT seq, ts_us, session, request_id, method, status, url, length(resp_body) AS body_chars FROM exr""")
def _(spark, sf):
    rows = read_exchanges(spark, D.landed_path(spark, sf, "exchanges", ex))
    return rows.select("seq", "ts_us", "session", "request_id", "method", "status", "url",
                       F.length("response_body").cast("bigint").alias("body_chars"))


@query("size_cap", f"""{WITH}{EXR}
SELECT seq, octet_length(encode(resp_body)) AS bytes, octet_length(encode(resp_body)) <= 200 AS kept FROM exr""")
def _(spark, sf):
    kept, cut = split_by_size(ex(spark, sf), "response_body", 200)
    both = kept.withColumn("kept", F.lit(True)).unionByName(cut.withColumn("kept", F.lit(False)))
    return both.select("seq", F.col("bytes").cast("bigint").alias("bytes"), "kept")


@query("url_parts", r"""
SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
  coalesce(nullif(regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
  nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query
FROM pages""")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.url_parts("url").alias("u")).select(
        "page_id", "u.host", "u.path", "u.origin", "u.query"
    )


@query("path_templates", f"""{WITH}{EXR},{templates('exr')}
SELECT seq, tmpl.path AS template, {CLEAN.format(p='tmpl.path')} AS cleaned,
  regexp_replace(tmpl.path, ':[a-zA-Z_]\\w*', ':_', 'g') AS normalized,
  lower(method) || '-' || coalesce(nullif(lower(regexp_replace(array_to_string(list_filter(
     string_split({CLEAN.format(p='tmpl.path')}, '/'), lambda s: s <> '' AND s[1] <> ':'), '-'),
     '[^A-Za-z0-9-]', '', 'g')), ''), 'root') AS endpoint_id
FROM exr JOIN tmpl USING (raw_path)""")
def _(spark, sf):
    return ex(spark, sf).withColumn("template", paths.parameterize_path(urls.url_path("url"))).select(
        "seq", "template",
        paths.clean_framework_path("template").alias("cleaned"),
        paths.normalize_path("template").alias("normalized"),
        paths.endpoint_id("method", "template").alias("endpoint_id"),
    )


_PAGE_PATHS = r"""pg AS (SELECT page_id, html, regexp_extract(url, '://([^/?#]+)', 1) AS host,
  coalesce(nullif(regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1), ''), '/') AS raw_path FROM pages)"""


@query("page_path_templates", f"""{WITH}{_PAGE_PATHS},{templates('pg')}
SELECT host, tmpl.path AS template, count(*) AS pages, CAST(sum(ceil(length(html) / 4.0)) AS BIGINT) AS tokens
FROM pg JOIN tmpl USING (raw_path) GROUP BY host, tmpl.path""")
def _(spark, sf):
    return (
        pages(spark, sf)
        .select(urls.url_host("url").alias("host"),
                paths.parameterize_path(urls.url_path("url")).alias("template"),
                text.token_cost("html").alias("t"))
        .groupBy("host", "template")
        .agg(F.count("*").alias("pages"), F.sum("t").alias("tokens"))
    )


@query("filter_traffic", f"{WITH}{EXR} SELECT seq, domain, reason FROM exr")
def _(spark, sf):
    return traffic.with_reject_reason(ex(spark, sf)).select("seq", "domain", "reason")


@query("filter_scoped", f"""{WITH}{EXR}
SELECT domain, coalesce(CASE WHEN NOT (domain = 'example.com' OR domain LIKE '%.example.com'
   OR domain = 'api.pay.example.net') THEN 'domain' END, reason,
   CASE WHEN domain = 'www.shop.example.com' THEN 'excluded' END, 'accepted') AS outcome,
  count(*) AS n FROM exr GROUP BY ALL""")
def _(spark, sf):
    excluded = D.table(spark, sf, "region").select(
        F.lit("www.shop.example.com").alias("domain")
    )
    out = traffic.with_reject_reason(
        ex(spark, sf), patterns=["*.example.com", "api.pay.example.net"], exclusions=excluded
    )
    return out.groupBy(
        "domain", F.coalesce("reason", F.lit("accepted")).alias("outcome")
    ).agg(F.count("*").alias("n"))


@query("domain_match", r"""
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, host = 'example.org' OR host LIKE '%.example.org' AS in_org,
  host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' AS in_farm,
  regexp_matches(host, '^blog\.') AND regexp_matches(host, '\.example\.com$') OR host = 'm.x' AS glob FROM h""")
def _(spark, sf):
    h = pages(spark, sf).select("page_id", urls.url_host("url").alias("host"))
    blogs = F.when(F.col("host").startswith("blog."), "*.example.com, m.x").otherwise("m.x ,")
    return h.select(
        "page_id",
        urls.is_domain_match("host", F.lit("https://www.example.org/x")).alias("in_org"),
        urls.is_domain_match("host", F.lit("www.spam-farm.example.org")).alias("in_farm"),
        urls.matches_domain_glob("host", urls.parse_domain_patterns(blogs)).alias("glob"),
    )


@query("host_suffixes", r"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages),
 l AS (SELECT host, string_split(host, '.') AS p FROM h)
SELECT host, array_to_string(p[i:], '.') AS parent FROM l, unnest(range(2, len(p))) AS t(i)""")
def _(spark, sf):
    return (
        pages(spark, sf).select(urls.url_host("url").alias("host")).distinct()
        .select("host", F.explode(urls.parent_domains("host")).alias("parent"))
    )


_SENSITIVE = "(?i)" + "|".join(b(p) for p in K.SENSITIVE_PATHS)


@query("observe_filter", f"""{WITH}{EXR}
SELECT seq, regexp_matches(path, {lit(_SENSITIVE)}) AS sensitive,
  contains(lower(content_type), 'application/json') OR contains(lower(content_type), 'application/vnd.api+json') AS api_type,
  contains(lower(content_type), 'json') AND NOT regexp_matches(path, {lit(_SENSITIVE)}) AND status >= 200 AS admitted
FROM exr""")
def _(spark, sf):
    from wiretally.operators.passive_index import is_observable

    e = ex(spark, sf)
    return e.select(
        "seq",
        urls.is_sensitive_path(urls.url_path("url")).alias("sensitive"),
        urls.is_index_content_type("content_type").alias("api_type"),
        is_observable().alias("admitted"),
    )


@query("url_safety", r"""
WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, page_id % 12 AS k FROM pages),
 v AS (SELECT page_id, k, host, CASE k WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '192.168.0.9'
   WHEN 3 THEN 'db.internal' WHEN 4 THEN '100.64.0.1' WHEN 5 THEN '169.254.1.1' WHEN 6 THEN 'localhost'
   ELSE host END AS target FROM u)
SELECT page_id, CASE k WHEN 0 THEN 'URL targets private IP: 10.1.2.3' WHEN 1 THEN 'URL targets loopback address: 127.0.0.1'
  WHEN 2 THEN 'URL targets private IP: 192.168.0.9' WHEN 3 THEN 'URL targets internal domain: db.internal'
  WHEN 4 THEN 'URL targets CGNAT address: 100.64.0.1' WHEN 5 THEN 'URL targets link-local address: 169.254.1.1'
  WHEN 6 THEN 'URL targets internal hostname: localhost' WHEN 7 THEN 'Non-HTTP scheme: ftp:' END AS reason FROM v""")
def _(spark, sf):
    host = urls.url_host("url")
    k = F.col("page_id") % 12
    bad = ["10.66051", "2130706433", "0xc0.168.0.011", "db.internal", "100.64.0.1",
           "[::ffff:a9fe:101]", "LOCALHOST"]
    target = F.lit(None).cast("string")
    for i, h in enumerate(bad):
        target = F.coalesce(target, F.when(k == i, h))
    scheme = F.when(k == 7, "ftp").otherwise("http")
    url = F.concat(scheme, F.lit("://"), F.coalesce(target, host), F.lit(":8080/x"))
    return pages(spark, sf).select("page_id", urls.url_safety_reason(url).alias("reason"))


@query("query_params", f"""{WITH}{EXR},
 p AS (SELECT seq, unnest(string_split(query[2:], '&')) AS kv FROM exr WHERE query <> '')
SELECT seq, string_split(kv, '=')[1] AS name, url_decode(string_split(kv, '=')[2]) AS value FROM p""")
def _(spark, sf):
    return ex(spark, sf).select("seq", F.explode(urls.query_params("url")).alias("name", "value"))


@query("parse_form", f"""{WITH}{EXR},
 p AS (SELECT seq, unnest(string_split(req_body, '&')) AS kv FROM exr WHERE kind IN ('profile', 'oauth'))
SELECT seq, string_split(kv, '=')[1] AS name, replace(url_decode(string_split(kv, '=')[2]), '+', ' ') AS value FROM p""")
def _(spark, sf):
    forms = ex(spark, sf).filter(F.col("request_headers")["content-type"].contains("urlencoded"))
    return forms.select("seq", F.explode(urls.parse_form("request_body")).alias("name", "value"))


_TOKEN = f"""{WITH}{EXR},{HEADER_ROWS},{entropy_of("(SELECT value FROM hdr WHERE name = 'x-blob')", 'value')},
 tok AS (SELECT hdr.*, name = 'x-blob' AND bits >= 3.5 AS entropy_auth FROM hdr LEFT JOIN ent ON value = val)"""


@query("safe_headers", f"""{_TOKEN}
SELECT seq, name, CASE WHEN name IN {in_list(K.AUTH_HEADERS)} OR entropy_auth THEN '[stored]' ELSE value END AS value
FROM tok WHERE name NOT IN {in_list(K.STRIP_HEADERS)} AND name NOT LIKE 'sec-%'""")
def _(spark, sf):
    safe = headers.strip_auth(headers.filter_headers("request_headers"))
    return ex(spark, sf).select("seq", F.explode(safe).alias("name", "value"))


@query("auth_headers", f"""{_TOKEN}
SELECT seq, CASE WHEN name = 'authorization' THEN CASE WHEN lower(value) LIKE 'bearer%' THEN 'bearer' ELSE 'custom' END
   WHEN name = 'x-api-key' THEN 'api-key' ELSE 'custom' END AS auth_type, name AS header
FROM tok WHERE name IN ('authorization', 'x-api-key') OR entropy_auth""")
def _(spark, sf):
    return ex(spark, sf).select(
        "seq", F.explode(headers.auth_headers("request_headers")).alias("a")
    ).select("seq", "a.auth_type", "a.header")


@query("auth_kinds", f"""{_TOKEN},
 lab AS (SELECT seq, min(name) FILTER (WHERE entropy_auth OR name = 'x-csrf-token') AS other FROM tok GROUP BY seq)
SELECT exr.seq, CASE WHEN h_authorization LIKE 'Bearer %' THEN 'Bearer' WHEN h_authorization LIKE 'Basic %' THEN 'Basic'
   WHEN h_api_key IS NOT NULL THEN 'API Key' WHEN h_cookie IS NOT NULL THEN 'Cookie' END AS auth_type,
  CASE WHEN h_authorization IS NOT NULL THEN 'Bearer' WHEN h_api_key IS NOT NULL THEN 'API Key'
   ELSE coalesce(other, 'none') END AS label,
  array_to_string(list_sort(list_filter([CASE WHEN h_authorization IS NOT NULL THEN 'authorization' END,
    CASE WHEN h_api_key IS NOT NULL THEN 'x-api-key' END, CASE WHEN h_csrf IS NOT NULL THEN 'x-csrf-token' END],
    lambda x: x IS NOT NULL)), ',') AS auth_like,
  CASE WHEN h_csrf IS NOT NULL THEN 'orange' WHEN h_authorization IS NOT NULL OR h_api_key IS NOT NULL OR other IS NOT NULL
   THEN 'yellow' ELSE 'green' END AS tier
FROM exr JOIN lab USING (seq)""")
def _(spark, sf):
    e = ex(spark, sf).withColumn("safe", headers.strip_auth(headers.filter_headers("request_headers")))
    return e.select(
        "seq",
        headers.auth_type("request_headers").alias("auth_type"),
        headers.auth_label("safe").alias("label"),
        F.array_join(headers.auth_like_headers("request_headers"), ",").alias("auth_like"),
        headers.replay_tier("safe").alias("tier"),
    )


_QP = f"""{WITH}{EXR},
 p AS (SELECT seq, unnest(string_split(query[2:], '&')) AS kv FROM exr WHERE query <> ''),
 q AS (SELECT seq, string_split(kv, '=')[1] AS name, string_split(kv, '=')[2] AS value FROM p),
 {entropy_of('q', 'value')},
 s AS (SELECT seq, name, value, regexp_matches(name, {lit(K.SENSITIVE_QUERY_RE)})
    OR (length(value) >= 16 AND bits >= 3.5) AS hot FROM q LEFT JOIN ent ON value = val)"""


@query("scrub_query_params", f"""{_QP}
SELECT seq, name, CASE WHEN hot THEN '[scrubbed]' ELSE {scrub_sql('value')} END AS value FROM s""")
def _(spark, sf):
    safe = traffic.scrub_query_params(urls.query_params("url"))
    return ex(spark, sf).select("seq", F.explode(safe).alias("name", "value"))


@query("scrub_url", f"""{_QP},
 j AS (SELECT seq, string_agg(name || '=' || CASE WHEN hot THEN '%5Bscrubbed%5D' ELSE value END, '&'
    ORDER BY strpos(query, name || '=')) AS q FROM s JOIN exr USING (seq) GROUP BY seq)
SELECT seq, 'https://' || host || path || coalesce('?' || q, '') AS url FROM exr LEFT JOIN j USING (seq)""")
def _(spark, sf):
    return ex(spark, sf).select("seq", traffic.scrub_url("url").alias("url"))


_JSON_KINDS = "('order', 'login', 'graphql')"


@query("scrub_body", f"""{WITH}{EXR},
 n AS (SELECT seq, t.key, t.type, t.atom ->> '$' AS val, t.fullkey FROM exr, json_tree(CAST(req_body AS JSON)) AS t
   WHERE exr.kind IN {_JSON_KINDS} AND t.type NOT IN ('OBJECT', 'ARRAY'))
SELECT seq, replace(fullkey[3:], '"', '') AS path, CASE
  WHEN type = 'VARCHAR' AND regexp_matches(key, {lit(K.SENSITIVE_BODY_RE)}) THEN '[scrubbed]'
  WHEN type = 'VARCHAR' THEN {scrub_sql('val')} ELSE val END AS value FROM n
UNION ALL SELECT seq, NULL, {scrub_sql('req_body')} FROM exr WHERE req_body IS NOT NULL AND kind NOT IN {_JSON_KINDS}""")
def _(spark, sf):
    e = ex(spark, sf).filter(F.col("request_body").isNotNull()).select("seq", bodies.scrub_body("request_body").alias("b"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("type"),
                            F.col("b").alias("value")))
    nodes = F.transform(bodies.json_nodes("b"), lambda n: F.struct(n["path"].alias("path"), n["type"].alias("type"),
                                                                   n["value"].alias("value")))
    return (
        e.select("seq", F.explode(F.coalesce(nodes, none)).alias("n"))
        .filter(F.col("n.type").isNull() | ~F.col("n.type").isin("object", "array"))
        .select("seq", F.col("n.path").alias("path"), F.col("n.value").alias("value"))
    )


@query("deep_json", "SELECT doc_id, 61 + doc_id % 50 AS nodes, repeat('[0]', CAST(60 + doc_id % 50 AS INT)) AS path FROM documents")
def _(spark, sf):
    # arrays in arrays, 60 to 109 levels deep
    deep = (60 + F.col("doc_id") % 50).cast("int")
    d = D.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.repeat(F.lit("["), deep), F.col("doc_id").cast("string"), F.repeat(F.lit("]"), deep)).alias("b"))
    nodes = d.select("doc_id", bodies.json_nodes("b").alias("n"))
    return nodes.select("doc_id", F.size("n").cast("bigint").alias("nodes"), F.element_at("n", -1)["path"].alias("path"))


@query("response_shape", f"""{WITH}{EXR},
 j AS (SELECT seq, kind, TRY_CAST(CASE WHEN kind NOT IN ('down', 'noise') THEN resp_body END AS JSON) AS v, resp_body FROM exr)
SELECT seq, coalesce(lower(json_type(v)), 'unknown') AS shape,
  array_to_string(list_sort(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN json_keys(v, '$[0]') END), ',') AS fields,
  json_array_length(v) > 2 AS cut
FROM j""")
def _(spark, sf):
    e = ex(spark, sf).withColumn("s", bodies.response_shape("response_body"))
    v = bodies.parse("response_body")
    return e.select(
        "seq", F.col("s.type").alias("shape"), F.array_join("s.fields", ",").alias("fields"),
        F.when(v.isNotNull(),
               F.coalesce(F.size(bodies.as_array(v)) > 2, F.lit(False))).alias("cut"),
    )


@query("response_preview", f"""{WITH}{EXR},
 j AS (SELECT seq, kind, resp_body, TRY_CAST(CASE WHEN kind NOT IN ('items', 'down', 'noise') THEN resp_body END AS JSON) AS v FROM exr),
 o AS (SELECT *, CASE WHEN kind = 'profile' THEN json_extract(v, '$.user') ELSE v END AS flat FROM j),
 p AS (SELECT *, '{{' || array_to_string(list_transform(list_sort(json_keys(flat)), lambda k: '"' || k || '":' || CAST(json_extract(flat, '$.' || k) AS VARCHAR)), ',') || '}}' AS sorted FROM o)
SELECT seq, CASE WHEN kind = 'items' THEN '[' || array_to_string(list_slice(string_split(replace(
   resp_body[2:-2], '}},{{', '}}|{{'), '|'), 1, 2), ',') || ']' WHEN kind IN ('down', 'noise') THEN resp_body
   WHEN kind = 'profile' THEN '{{"ok":' || CAST(json_extract(v, '$.ok') AS VARCHAR) || ',"user":' || sorted || '}}' ELSE sorted END AS preview FROM p""")
def _(spark, sf):
    return ex(spark, sf).select("seq", bodies.response_preview("response_body").alias("preview"))


@query("graphql_operations", f"""{WITH}{EXR}
SELECT seq, kind = 'graphql' AS is_graphql, CASE WHEN kind = 'graphql' THEN
  CASE WHEN seq % 3 = 0 THEN 'Item' || (seq % 5) ELSE 'GetItem' || (seq % 4) END END AS operation,
  CASE WHEN kind = 'graphql' THEN 'variables.after,variables.id,variables.opts.first' END AS variables
FROM exr""")
def _(spark, sf):
    ct = headers.header(F.col("request_headers"), "content-type")
    e = ex(spark, sf).withColumn("p", urls.url_path("url"))
    op = bodies.exchange_operation("p", ct, "request_body")
    nodes = F.when(op.isNotNull(), bodies.json_nodes("request_body"))
    return e.select(
        "seq", bodies.is_graphql("p", ct, "request_body").alias("is_graphql"), op.alias("operation"),
        F.array_join(bodies.graphql_variables(nodes), ",").alias("variables"),
    )


_DYN = "(?i)" + "|".join(b(p) for p in K.DYNAMIC_KEY_PARTS)


_VARIABLE = f"""NOT contains(path, '[') AND (
   (regexp_matches(key, {lit(_DYN)}) AND type <> 'NULL') OR type IN ('UBIGINT', 'BIGINT', 'DOUBLE')
   OR (type = 'VARCHAR' AND (regexp_matches(val, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}}|$)')
     OR (length(val) > 15 AND regexp_full_match(val, '[a-zA-Z0-9+/=_-]+')) OR regexp_full_match(val, '\\d{{4,}}'))))"""


@query("body_variables", f"""{WITH}{EXR},
 n AS (SELECT seq, t.key, t.type, t.atom ->> '$' AS val, replace(t.fullkey[3:], '"', '') AS path
   FROM exr, json_tree(CAST(req_body AS JSON)) AS t WHERE exr.kind IN {_JSON_KINDS} AND t.key IS NOT NULL),
 hit AS (SELECT seq, path FROM n WHERE {_VARIABLE})
SELECT seq, string_agg(path, ',' ORDER BY path) AS variables FROM hit GROUP BY seq""")
def _(spark, sf):
    e = ex(spark, sf)
    v = bodies.body_variables(bodies.json_nodes("request_body"))
    return e.select("seq", F.array_join(v, ",").alias("variables")).filter("variables <> ''")


@query("refreshable_tokens", f"""{WITH}{EXR}
SELECT seq, CASE WHEN kind = 'order' THEN 'csrf_token' WHEN kind IN ('graphql', 'login') THEN '' END AS tokens,
 CASE WHEN kind = 'order' THEN json_extract_string(req_body, '$.csrf_token') = h_request_id END AS same,
 CASE WHEN kind = 'order' THEN json_extract_string(req_body, '$.order.sku') END AS sku FROM exr""")
def _(spark, sf):
    nodes = bodies.json_nodes("request_body")
    return ex(spark, sf).select(
        "seq", F.array_join(bodies.refreshable_tokens(nodes), ",").alias("tokens"),
        (bodies.extract_path("request_body", "csrf_token")
         == F.col("request_headers")["x-request-id"]).alias("same"),
        bodies.extract_path("request_body", "order.sku").alias("sku"),
    )


@query("pagination", f"""{WITH}{EXR}
SELECT seq, CASE WHEN kind = 'product' THEN 'offset:offset:limit' WHEN kind = 'items' AND seq % 3 = 0 THEN 'page:page'
   WHEN kind = 'items' THEN 'cursor:cursor' END AS by_params,
  CASE WHEN kind = 'items' AND seq % 4 = 0 THEN 'cursor' WHEN kind = 'items' AND seq % 4 = 1 THEN 'page'
   WHEN kind = 'product' THEN 'offset' WHEN kind = 'items' AND seq % 3 = 0 THEN 'page' WHEN kind = 'items' THEN 'cursor' END AS observed
FROM exr""")
def _(spark, sf):
    names = F.map_keys(urls.query_params("url"))
    p = headers.pagination_of_params(names)
    return ex(spark, sf).select(
        "seq",
        F.when(p.isNotNull(), F.concat_ws(":", p["kind"], p["param"], p["limit_param"])).alias("by_params"),
        headers.observed_pagination("response_headers", names).alias("observed"),
    )


@query("anti_bot_signals", f"""{WITH}{EXR}
SELECT seq, array_to_string(list_filter([CASE WHEN r_cf_ray IS NOT NULL OR contains(h_cookie, '__cf_bm') THEN 'cloudflare' END,
  CASE WHEN contains(h_cookie, '_abck') THEN 'akamai' END, CASE WHEN r_retry IS NOT NULL THEN 'rate-limited' END],
  lambda x: x IS NOT NULL), ',') AS signals FROM exr""")
def _(spark, sf):
    s = headers.anti_bot_signals(
        F.col("response_headers"), F.col("request_headers")["cookie"], F.col("response_body"),
        F.col("status"), F.col("content_type"),
    )
    return ex(spark, sf).select("seq", F.array_join(s, ",").alias("signals"))


@query("endpoint_catalog", f"""{WITH}{KEYED},
 w AS (SELECT *, count(*) OVER (PARTITION BY domain, key) AS hits, min(ts_us) OVER (PARTITION BY domain, key) AS first_us,
    max(ts_us) OVER (PARTITION BY domain, key) AS last_us,
    row_number() OVER (PARTITION BY domain, key ORDER BY body_missing, ts_us, seq) AS rn FROM keyed)
SELECT domain, key, method, path, CASE WHEN operation IS NOT NULL THEN 'post-graphql-' || operation ELSE
  lower(method) || '-' || coalesce(nullif(lower(regexp_replace(array_to_string(list_filter(
     string_split(cleaned, '/'), lambda s: s <> '' AND s[1] <> ':'), '-'), '[^A-Za-z0-9-]', '', 'g')), ''), 'root') END AS id,
  hits, first_us, last_us, CASE WHEN body_missing THEN 'skeleton' END AS provenance,
  CASE WHEN body_missing THEN 0 ELSE length(resp_body) END AS response_bytes,
  CASE WHEN body_missing THEN 'unknown' WHEN kind = 'items' THEN 'array' ELSE 'object' END AS response_type,
  CASE WHEN kind = 'product' THEN 'offset' WHEN kind = 'items' AND seq % 3 = 0 THEN 'page' WHEN kind = 'items' THEN 'cursor' END AS pagination
FROM w WHERE rn = 1""")
def _(spark, sf):
    e = traffic.build_endpoints(traffic.accepted(ex(spark, sf)))
    return e.select(
        "domain", "key", "method", "path", "id", "hits", "first_us", "last_us", "provenance",
        "response_bytes", "response_type", F.col("pagination.kind").alias("pagination"),
    )


@query("domain_counters", f"""{WITH}{EXR},
 f AS (SELECT domain, min(ts_us) FILTER (WHERE reason IS NULL) AS first_us FROM exr GROUP BY domain)
SELECT domain, count(*) FILTER (WHERE reason IS NULL) AS capture_count,
  count(*) FILTER (WHERE reason IS NOT NULL) AS filtered_count,
  CAST(coalesce(sum(CASE WHEN reason IS NULL THEN CASE WHEN body_missing THEN 0 ELSE length(resp_body) END
     WHEN ts_us >= first_us THEN coalesce(r_length, 0) END), 0) AS BIGINT) AS network_bytes
FROM exr JOIN f USING (domain) GROUP BY domain""")
def _(spark, sf):
    out = traffic.domain_counters(traffic.with_reject_reason(ex(spark, sf)))
    return out.select("domain", "capture_count", "filtered_count", "network_bytes")


@query("primary_domain", f"""{WITH}{EXR},
 n AS (SELECT session, domain, count(*) AS n, min(ts_us) AS t FROM exr GROUP BY ALL)
SELECT session, first(domain ORDER BY n DESC, t) AS primary_domain, count(*) AS domains FROM n GROUP BY session""")
def _(spark, sf):
    return traffic.primary_domain(ex(spark, sf))


@query("first_occurrence", f"""{WITH}{KEYED}
SELECT seq, row_number() OVER (PARTITION BY domain, key ORDER BY ts_us, seq) = 1 AS is_new FROM keyed""")
def _(spark, sf):
    return traffic.first_occurrence(keyed(spark, sf)).select("seq", "is_new")


_DIFF = f""" ord AS (SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY ts_us, seq) AS rn,
    count(*) OVER (PARTITION BY domain, key) AS n FROM keyed WHERE method = 'POST' AND NOT body_missing),
 multi AS (SELECT * FROM ord WHERE n > 1),
 node AS (SELECT domain, multi.key, rn, t.fullkey, regexp_replace(regexp_replace(t.fullkey[3:], '"', '', 'g'), '^\\.', '') AS path,
     CASE WHEN t.type = 'ARRAY' THEN 'A' || json_array_length(t.value) WHEN t.type = 'OBJECT' THEN 'O'
       WHEN t.type = 'NULL' THEN 'null' WHEN t.type = 'VARCHAR' AND regexp_matches(t.key, {lit(K.SENSITIVE_BODY_RE)}) THEN 's'
       WHEN t.type = 'VARCHAR' THEN 's' || {scrub_sql("(t.atom ->> '$')")} ELSE t.type || (t.atom ->> '$') END AS sig
   FROM multi, json_tree(CAST(req_body AS JSON)) AS t WHERE multi.kind IN {_JSON_KINDS} AND t.key IS NOT NULL),
 one AS (SELECT domain, key, path, sig FROM node WHERE rn = 1),
 arr AS (SELECT f.domain, f.key, o.rn, f.path FROM one f JOIN node o USING (domain, key, path)
    WHERE f.sig <> o.sig AND f.sig[1] = 'A'),
 diff AS (
   SELECT f.domain, f.key, f.path FROM one f JOIN node o USING (domain, key, path) WHERE f.sig <> o.sig
   AND NOT EXISTS (SELECT 1 FROM arr WHERE arr.domain = f.domain AND arr.key = f.key AND arr.rn = o.rn
     AND f.path LIKE arr.path || '[%')
   UNION SELECT o.domain, o.key, o.path FROM node o WHERE rn > 1
     AND NOT EXISTS (SELECT 1 FROM one f WHERE f.domain = o.domain AND f.key = o.key AND f.path = o.path)
     AND NOT EXISTS (SELECT 1 FROM arr WHERE arr.domain = o.domain AND arr.key = o.key AND arr.rn = o.rn AND o.path LIKE arr.path || '[%')
   UNION SELECT f.domain, f.key, f.path FROM one f JOIN (SELECT DISTINCT domain, key, rn FROM node WHERE rn > 1) b USING (domain, key)
     WHERE NOT EXISTS (SELECT 1 FROM node o WHERE o.domain = f.domain AND o.key = f.key AND o.rn = b.rn AND o.path = f.path)
     AND NOT EXISTS (SELECT 1 FROM arr WHERE arr.domain = f.domain AND arr.key = f.key AND arr.rn = b.rn AND f.path LIKE arr.path || '[%')),
 frm AS (SELECT domain, key, n, unnest(string_split(req_body, '&')) AS kv FROM multi WHERE kind IN ('profile', 'oauth')),
 fk AS (SELECT domain, key, n, string_split(kv, '=')[1] AS path, string_split(kv, '=')[2] AS val FROM frm),
 changed AS (SELECT DISTINCT domain, key, path FROM diff
   UNION ALL SELECT domain, key, path FROM fk GROUP BY domain, key, n, path HAVING count(*) < n OR min(val) <> max(val))"""


@query("body_diff", f"""{WITH}{KEYED},
{_DIFF}
SELECT domain, key, path FROM changed""")
def _(spark, sf):
    return traffic.body_diff(keyed(spark, sf))


# the catalog's first exchanges, and the template of their bodies
TEMPLATE = f"""CASE WHEN body_missing OR req_body IS NULL THEN NULL
  WHEN kind = 'oauth' THEN regexp_replace(req_body, '(client_secret|refresh_token)=[^&]*', '\\1=[scrubbed]', 'g')
  WHEN kind = 'profile' THEN {scrub_sql('req_body')}
  ELSE {scrub_sql("regexp_replace(req_body, '\"(csrf_token|password)\":\"[^\"]*\"', '\"\\1\":\"[scrubbed]\"', 'g')")} END"""


@query("catalog_with_variables", f"""{WITH}{KEYED},
{_DIFF},
 w AS (SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY body_missing, ts_us, seq) AS rn FROM keyed),
 first AS (SELECT * FROM w WHERE rn = 1),
 leaf AS (SELECT domain, first.key AS endpoint, t.key, t.type, t.atom ->> '$' AS val, replace(t.fullkey[3:], '"', '') AS path
   FROM first, json_tree(CAST(req_body AS JSON)) AS t WHERE first.kind IN ('order', 'login') AND NOT body_missing AND t.key IS NOT NULL),
 own AS (SELECT domain, endpoint AS key, path FROM leaf WHERE {_VARIABLE}
   UNION ALL SELECT domain, key, unnest(['variables.after', 'variables.id', 'variables.opts.first']) FROM first WHERE kind = 'graphql' AND NOT body_missing),
 vars AS (SELECT domain, key, string_agg(path, ',' ORDER BY path) AS variables FROM (
   SELECT domain, key, path FROM own UNION SELECT domain, key, path FROM changed) GROUP BY domain, key)
SELECT domain, key, CASE WHEN method = 'POST' AND NOT body_missing THEN h_content_type END AS body_type,
  CASE WHEN kind = 'order' AND NOT body_missing THEN 'csrf_token' END AS refreshable,
  {TEMPLATE} AS template, CASE WHEN method = 'POST' AND NOT body_missing THEN coalesce(variables, '') END AS variables
FROM first LEFT JOIN vars USING (domain, key)""")
def _(spark, sf):
    e = traffic.build_catalog(ex(spark, sf))
    assert not {"request_body", "response_body"} & set(e.columns)
    return e.select(
        "domain", "key", "body_type",
        F.nullif(F.array_join("refreshable_tokens", ","), F.lit("")).alias("refreshable"),
        F.col("request_template").alias("template"), F.array_join("body_variables", ",").alias("variables"),
    )
