"""Checks of the passive index, text scans and the authentication audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.checks.base import query
from wiretally.checks.sqlparts import (
    EXR, HEADER_ROWS, KEYED, WITH, _SCRUB, entropy_of, lit, scrub_sql, templates,
)
from wiretally.checks.traffic import ex
from wiretally.functions import text, urls
from wiretally.operators import auth_audit, passive_index, traffic
from wiretally.sources import derived as D

_OBS = f"""{WITH}{EXR},{templates('exr')},
 obs AS (SELECT exr.* EXCLUDE (path), tmpl.path, CASE WHEN h_authorization LIKE 'Bearer %' THEN 'Bearer'
     WHEN h_authorization IS NOT NULL THEN 'Basic' WHEN h_api_key IS NOT NULL THEN 'API Key'
     WHEN h_cookie IS NOT NULL THEN 'Cookie' END AS auth_type,
   CASE WHEN kind = 'items' AND seq % 4 = 0 THEN 'cursor' WHEN kind = 'items' AND seq % 4 = 1 THEN 'page'
     WHEN kind = 'product' THEN 'offset' WHEN kind = 'items' AND seq % 3 = 0 THEN 'page'
     WHEN kind = 'items' THEN 'cursor' END AS pagination,
   CASE kind WHEN 'product' THEN ['limit', 'offset'] WHEN 'items' THEN CASE WHEN seq % 3 = 0 THEN ['page'] ELSE ['cursor'] END
     WHEN 'profile' THEN ['email', 'ref', 'session_token'] ELSE [] END AS params
   FROM exr JOIN tmpl USING (raw_path)
   WHERE contains(lower(content_type), 'json') AND kind NOT IN ('login', 'oauth')),
 idx AS (SELECT domain, path, count(*) AS hits, min(ts_us) AS first_us, max(ts_us) AS last_us,
   array_to_string(list_sort(list(DISTINCT method)), ',') AS methods,
   arg_min(auth_type, (ts_us, seq)) FILTER (WHERE auth_type IS NOT NULL) AS auth_type,
   arg_min(pagination, (ts_us, seq)) FILTER (WHERE pagination IS NOT NULL) AS pagination,
   max(CASE WHEN kind = 'graphql' THEN 'graphql' END) AS type,
   array_to_string(list_sort(list_distinct(flatten(list(params)))), ',') AS params
   FROM obs GROUP BY domain, path)"""


def index_columns(df):
    return df.select(
        "domain", "path", "hits", "first_us", "last_us",
        F.array_join("methods", ",").alias("methods"), "auth_type", "pagination", "type",
        F.array_join("params", ",").alias("params"),
    )


@query("passive_index", f"{_OBS} SELECT * FROM idx")
def _(spark, sf):
    return index_columns(passive_index.passive_index(ex(spark, sf)))


@query("passive_index_domains", f"""{_OBS}
SELECT domain, CAST(sum(hits) AS BIGINT) AS total_hits, min(first_us) AS first_us, max(last_us) AS last_us, count(*) AS endpoints
FROM idx GROUP BY domain""")
def _(spark, sf):
    return passive_index.domain_index(passive_index.passive_index(ex(spark, sf)))


@query("passive_index_merge", f"{_OBS} SELECT * FROM idx")
def _(spark, sf):
    e = ex(spark, sf)
    cut = 1705363200000000
    old = passive_index.passive_index(e.filter(F.col("ts_us") < cut))
    new = passive_index.passive_index(e.filter(F.col("ts_us") >= cut))
    return index_columns(passive_index.merge_index(old, new))


_NOW = 1720000000000000  # a fixed evaluation time, so that age classes do not depend on the clock


@query("index_lifecycle", f"""{_OBS},
 dom AS (SELECT domain, path, ({_NOW} - last_us) / 86400000000.0 AS days FROM idx)
SELECT domain, path, CAST(floor(days) AS BIGINT) AS days, CASE WHEN days >= 180 THEN 'deleted' WHEN days >= 90 THEN 'stale' ELSE 'fresh' END AS freshness FROM dom""")
def _(spark, sf):
    aged = passive_index.lifecycle(passive_index.passive_index(ex(spark, sf)), _NOW)
    return aged.select("domain", "path", F.floor("inactive_days").alias("days"), "freshness")


@query("index_over_cap", f"""{_OBS}
SELECT count(*) AS domains, count(*) > 500 AS over_cap FROM (SELECT domain FROM idx GROUP BY domain)""")
def _(spark, sf):
    domains = passive_index.domain_index(passive_index.passive_index(ex(spark, sf)))
    return passive_index.over_cap(passive_index.lifecycle(domains, 1706745600000000))


@query("index_skeleton", f"""{_OBS} SELECT DISTINCT domain, method, path FROM obs""")
def _(spark, sf):
    return passive_index.skeleton_endpoints(passive_index.passive_index(ex(spark, sf)))


# ------------------------------------------------------------------------------------------
# text scans
# ------------------------------------------------------------------------------------------
def documents(spark, sf):
    return D.spread(D.table(spark, sf, "documents"))


@query("scrub_documents", f"""
SELECT doc_id, md5(s) AS digest, length(s) AS chars FROM (SELECT doc_id, {scrub_sql('text')} AS s FROM documents)""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", text.scrub_pii("text").alias("s")).select(
        "doc_id", F.md5("s").alias("digest"), F.length("s").cast("bigint").alias("chars")
    )


def _stages(column: str) -> str:
    """The scrubber as one CTE per step, so each class is counted where it is replaced."""
    names = ["email", "ssn", "card", "mark", "ip", "unmark", "phone_intl", "phone_us", "bearer",
             "jwt", "private_key", "aws_key", "gcp_key", "basic"]
    sql, prev, counts = [], "s0", []
    for i, (name, (pattern, mark)) in enumerate(zip(names, _SCRUB), 1):
        keep = ", ".join(counts)
        n = f"len(regexp_extract_all(s, {lit(pattern)})) AS n_{name}"
        if name not in ("mark", "unmark"):
            counts.append(f"n_{name}")
        else:
            n = ""
        sql.append(
            f"s{i} AS (SELECT id, grp{', ' + keep if keep else ''}{', ' + n if n else ''}, "
            f"regexp_replace(s, {lit(pattern)}, {lit(mark)}, 'g') AS s FROM {prev})"
        )
        prev = f"s{i}"
    return ", ".join(sql), prev


def _pii_sql(source: str) -> str:
    stages, last = _stages("s")
    sums = ", ".join(f"CAST(sum(n_{c}) AS BIGINT) AS n_{c}" for c in text.PII_CLASSES)
    return f"""WITH s0 AS ({source}), {stages}
SELECT grp, count(*) AS rows_seen, {sums} FROM {last} GROUP BY grp"""


def _pii_report(df, column: str):
    counted = text.with_pii(df, column)
    return counted.groupBy("grp").agg(
        F.count("*").alias("rows_seen"),
        *[F.sum(f"n_{c}").cast("bigint").alias(f"n_{c}") for c in text.PII_CLASSES],
    )


@query("pii_by_source", _pii_sql("SELECT doc_id AS id, source AS grp, text AS s FROM documents"))
def _(spark, sf):
    return _pii_report(documents(spark, sf).withColumn("grp", F.col("source")), "text")


@query("pii_by_role", _pii_sql("SELECT conv_id AS id, role AS grp, text AS s FROM conversations"))
def _(spark, sf):
    return _pii_report(D.table(spark, sf, "conversations").withColumn("grp", F.col("role")), "text")


@query("pii_by_label", _pii_sql(
    "SELECT d.doc_id AS id, l.toxic AS grp, d.text AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id"))
def _(spark, sf):
    labels = D.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("grp"))
    return _pii_report(documents(spark, sf).join(labels, "doc_id"), "text")


@query("pii_in_exchanges", f"""{_pii_sql(f"SELECT seq AS id, kind AS grp, resp_body AS s FROM ({D.exchanges_sql(D.ANSI)})")}""")
def _(spark, sf):
    return _pii_report(ex(spark, sf).withColumn("grp", F.col("kind")), "response_body")


@query("text_entropy", f"""WITH {entropy_of('(SELECT text FROM benchmark)', 'text')}
SELECT item_id, round(bits, 6) AS bits FROM benchmark JOIN ent ON text = val""")
def _(spark, sf):
    return D.table(spark, sf, "benchmark").select(
        "item_id", F.round(text.shannon_entropy("text"), 6).alias("bits")
    )


@query("classify_tokens", f"""{WITH}{EXR},{HEADER_ROWS},{entropy_of("(SELECT replace(value, 'Bearer ', '') AS value FROM hdr)", 'value')},
 t AS (SELECT seq, name, replace(value, 'Bearer ', '') AS raw FROM hdr)
SELECT seq, name, raw LIKE 'eyJ%' OR (length(raw) >= 16 AND bits >= 3.5) AS is_token,
  CASE WHEN raw LIKE 'eyJ%' OR (length(raw) >= 16 AND bits >= 4.5) THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN raw LIKE 'eyJ%' THEN 'jwt' ELSE 'opaque' END AS format
FROM t JOIN ent ON raw = val""")
def _(spark, sf):
    e = ex(spark, sf).select("seq", F.explode("request_headers").alias("name", "value"))
    return e.withColumn("t", text.classify_token("value")).select("seq", "name", "t.*")


@query("token_cost", """
SELECT source, count(*) AS docs, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY source""")
def _(spark, sf):
    return documents(spark, sf).groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(text.token_cost("text")).alias("tokens")
    )


# ------------------------------------------------------------------------------------------
# authentication audit
# ------------------------------------------------------------------------------------------
_EXPIRE = 1704367200


@query("jwt_expiries", f"""{WITH}{EXR}
SELECT seq, domain, 1704067200 + seq * 60 AS exp_s, 'auth' || (session % 3) AS issuer, 'read' AS scope,
  1704067200 + seq * 60 < {_EXPIRE} + 30 AS expired FROM exr WHERE h_authorization LIKE 'Bearer %'""")
def _(spark, sf):
    return auth_audit.token_expiries(ex(spark, sf), _EXPIRE)


_AUTH_SEEN = f"""{WITH}{EXR},{HEADER_ROWS},{entropy_of("(SELECT value FROM hdr WHERE name = 'x-blob')", 'value')},
 seen AS (SELECT domain, name AS header, CASE WHEN name = 'authorization' THEN CASE WHEN value LIKE 'Bearer%' THEN 'bearer' ELSE 'custom' END
    WHEN name = 'x-api-key' THEN 'api-key' ELSE 'custom' END AS auth_type, ts_us
  FROM hdr JOIN exr USING (seq) LEFT JOIN ent ON value = val WHERE name IN ('authorization', 'x-api-key') OR (name = 'x-blob' AND bits >= 3.5))"""


@query("dedup_auth", f"""{_AUTH_SEEN},
 r AS (SELECT *, CASE auth_type WHEN 'bearer' THEN 0 WHEN 'api-key' THEN 1 ELSE 2 END AS p FROM seen)
SELECT domain, first(auth_type ORDER BY p, ts_us) AS auth_type, first(header ORDER BY p, ts_us) AS header,
  array_to_string(list_sort(list(DISTINCT header)), ',') AS headers, count(*) AS uses FROM r GROUP BY domain""")
def _(spark, sf):
    out = auth_audit.dedup_auth(auth_audit.auth_headers_seen(ex(spark, sf)))
    return out.withColumn("headers", F.array_join("headers", ","))


@query("oauth_flows", f"""{WITH}{EXR}
SELECT seq, domain, CASE WHEN seq % 3 <> 2 THEN 'https://' || host || '/oauth/token' END AS token_endpoint,
  CASE WHEN seq % 3 <> 2 THEN 'app' || (session % 4) END AS client_id,
  CASE seq % 3 WHEN 0 THEN 'refresh_token' WHEN 1 THEN 'client_credentials' END AS grant_type,
  CASE WHEN seq % 3 <> 2 THEN 'read write' END AS scope, CASE WHEN seq % 3 <> 2 THEN seq % 2 = 0 END AS has_secret,
  3600 AS expires_in, 'bearer' AS token_type, session % 2 = 0 AS returns_refresh FROM exr WHERE kind = 'oauth'""")
def _(spark, sf):
    return auth_audit.oauth_flows(ex(spark, sf))


@query("login_success", f"""{WITH}{EXR}
SELECT seq, status BETWEEN 200 AND 299 AND (h_authorization IS NOT NULL OR (kind = 'login' AND seq % 3 = 0)) AS login FROM exr""")
def _(spark, sf):
    return auth_audit.logins(ex(spark, sf))


_STORED = """ hosts AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS domain FROM pages),
 tails AS (SELECT DISTINCT array_to_string(string_split(domain, '.')[-3:], '.') AS domain FROM hosts),
 stored AS (SELECT domain, 'bearer' AS auth_type, 'authorization' AS header, length(domain) % 3 = 0 AS expired FROM tails
   UNION ALL SELECT 'example.com', 'api-key', 'x-api-key', false)"""


def stored_auth(spark, sf):
    hosts = D.table(spark, sf, "pages").select(urls.url_host("url").alias("domain")).distinct()
    labels = F.split("domain", r"\.")
    tails = hosts.select(
        F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(3)), F.lit(3)), ".").alias("domain")
    ).distinct()
    rows = tails.select(
        "domain", F.lit("bearer").alias("auth_type"), F.lit("authorization").alias("header"),
        (F.length("domain") % 3 == 0).alias("expired"),
    )
    root = D.table(spark, sf, "region").limit(1).select(
        F.lit("example.com").alias("domain"), F.lit("api-key").alias("auth_type"),
        F.lit("x-api-key").alias("header"), F.lit(False).alias("expired"),
    )
    return hosts, rows.unionByName(root)


@query("auth_parent_lookup", f"""WITH {_STORED},
 sfx AS (SELECT domain, t.i - 1 AS distance, array_to_string(string_split(domain, '.')[t.i:], '.') AS suffix
   FROM hosts, unnest(range(1, greatest(len(string_split(domain, '.')), 2))) AS t(i)),
 hit AS (SELECT s.domain, s.distance, s.suffix, st.auth_type, st.header, st.expired,
   row_number() OVER (PARTITION BY s.domain ORDER BY st.expired, s.distance) AS rn
   FROM sfx s JOIN stored st ON st.domain = s.suffix WHERE NOT st.expired OR s.distance = 0)
SELECT h.domain, suffix AS found_at, auth_type, header, expired FROM hosts h LEFT JOIN hit ON hit.domain = h.domain AND rn = 1""")
def _(spark, sf):
    hosts, stored = stored_auth(spark, sf)
    return auth_audit.lookup_with_parents(hosts, stored)


@query("auth_audit", f"""{WITH}{KEYED}
SELECT k.domain, count(DISTINCT key) AS endpoints, CASE WHEN bool_or(h_authorization IS NOT NULL) THEN 'yes' ELSE 'no' END AS auth,
  max(ts_us) AS modified_us FROM keyed k GROUP BY k.domain""")
def _(spark, sf):
    kept = traffic.accepted(ex(spark, sf))
    w = traffic.endpoint_winners(traffic.with_keys(kept))
    catalog = w.groupBy("domain").agg(
        F.count("*").alias("endpoints"), F.max("last_us").alias("modified_us")
    )
    known = kept.filter(F.col("request_headers")["authorization"].isNotNull())
    return auth_audit.audit(catalog, known)


@query("new_session_cookies", f"""WITH c AS (SELECT user_id AS session, event_id, CASE event_id % 6 WHEN 0 THEN 'sid' WHEN 1 THEN '_ga_sess'
    WHEN 2 THEN 'guest_token' WHEN 3 THEN 'auth_jwt' WHEN 4 THEN 'theme' ELSE 'PHPSESSID' END AS name,
   CASE WHEN event_id % 4 = 0 THEN 'same' ELSE CAST(event_id AS VARCHAR) END AS value, ts FROM events),
 o AS (SELECT session, name, first(value ORDER BY event_id) AS value FROM c WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY ALL),
 n AS (SELECT session, name, first(value ORDER BY event_id DESC) AS value FROM c GROUP BY ALL)
SELECT n.session, n.name, o.value IS NULL AS is_new FROM n LEFT JOIN o USING (session, name)
WHERE n.value IS DISTINCT FROM o.value AND regexp_matches(n.name, {lit(K.SESSION_COOKIE_RE)})
  AND NOT regexp_matches(n.name, {lit(K.TRACKING_COOKIE_RE)}) AND NOT regexp_matches(n.name, {lit(K.ANONYMOUS_COOKIE_RE)})""")
def _(spark, sf):
    k = F.col("event_id") % 6
    name = F.lit("PHPSESSID")
    for i, n in enumerate(["sid", "_ga_sess", "guest_token", "auth_jwt", "theme"]):
        name = F.when(k == i, n).otherwise(name)
    c = D.table(spark, sf, "events").select(
        F.col("user_id").alias("session"), "event_id", name.alias("name"),
        F.when(F.col("event_id") % 4 == 0, "same").otherwise(F.col("event_id").cast("string")).alias("value"),
    )
    old = c.filter((F.col("event_id") % 2 == 0) | (F.col("event_id") % 3 == 0)).groupBy(
        "session", "name").agg(F.min_by("value", "event_id").alias("value"))
    new = c.groupBy("session", "name").agg(F.max_by("value", "event_id").alias("value"))
    return auth_audit.new_session_cookies(old, new)


