"""Checks of drift, merge, catalog tables, reports and request planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.checks.base import query
from wiretally.checks.sqlparts import EXR, KEYED, WITH, entropy_of, in_list
from wiretally.checks.traffic import TEMPLATE, ex, keyed
from wiretally.functions import bodies, urls
from wiretally.operators import catalog, drift, merge, reports, requests, search_index, traffic
from wiretally.operators.joins import join_small
from wiretally.session import reliable, spread_groups, state_folder
from wiretally.sources import derived as D

_ID = """CASE WHEN operation IS NOT NULL THEN 'post-graphql-' || operation ELSE lower(method) || '-' ||
  coalesce(nullif(lower(regexp_replace(array_to_string(list_filter(string_split(cleaned, '/'), lambda s: s <> '' AND s[1] <> ':'), '-'),
  '[^A-Za-z0-9-]', '', 'g')), ''), 'root') END"""

CAT = f"""{WITH}{KEYED},{entropy_of('keyed', 'h_blob')},
 w AS (SELECT keyed.*, bits, count(*) OVER (PARTITION BY domain, key) AS hits, min(ts_us) OVER (PARTITION BY domain, key) AS first_us,
    max(ts_us) OVER (PARTITION BY domain, key) AS last_us,
    row_number() OVER (PARTITION BY domain, key ORDER BY body_missing, ts_us, seq) AS rn FROM keyed LEFT JOIN ent ON h_blob = val),
 cat AS (SELECT *, {_ID} AS id, CASE WHEN body_missing THEN 0 ELSE length(resp_body) END AS response_bytes,
    CASE WHEN h_csrf IS NOT NULL THEN 'orange' WHEN h_authorization IS NOT NULL OR h_api_key IS NOT NULL OR (h_blob IS NOT NULL AND bits >= 3.5)
      THEN 'yellow' ELSE 'green' END AS tier,
    CASE WHEN body_missing THEN 'unknown' WHEN kind = 'items' THEN 'array' ELSE 'object' END AS response_type,
    CASE WHEN body_missing THEN 'skeleton' END AS provenance, CASE WHEN body_missing THEN 0.8 END AS confidence
   FROM w WHERE rn = 1)"""


def endpoints(spark, sf):
    """Catalog of the derived exchanges; ``pos`` is the first time an endpoint was seen."""
    return D.landed(
        spark, sf, "endpoints", lambda: traffic.build_endpoints(traffic.accepted(ex(spark, sf)))
    ).withColumn("pos", F.col("first_us")).withColumn("verified", F.lit(None).cast("boolean"))


def searched(spark, sf):
    """The search index of the catalog, built once and landed."""
    def built():
        return search_index.build_search_index(endpoints(spark, sf))

    return search_index.SearchIndex(
        D.landed(spark, sf, "search-entries", lambda: built().entries),
        D.landed(spark, sf, "search-postings", lambda: built().postings.sortWithinPartitions("gram", "domain")))


# ------------------------------------------------------------------------------------------
# drift
# ------------------------------------------------------------------------------------------
_TYPE = """CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"""


@query("schema_snapshot", f"""{WITH}{EXR},
 n AS (SELECT seq, t.fullkey, {_TYPE} AS type FROM exr, json_tree(CAST(resp_body AS JSON)) AS t WHERE kind NOT IN ('down', 'noise'))
SELECT seq, regexp_replace(regexp_replace(replace(fullkey[2:], '[0]', '[]'), '^\\.', ''), '"', '', 'g') AS path, type
FROM n WHERE NOT regexp_matches(fullkey, '\\[[1-9]')""")
def _(spark, sf):
    rows = drift.schema_rows(ex(spark, sf).select("seq", "response_body"), "response_body", "seq")
    return rows.select("seq", "path", "type")


_DRIFT = f"""{CAT},
 base AS (SELECT domain, key, kind, seq, ts_us FROM cat WHERE kind = 'product' AND NOT body_missing),
 b AS (SELECT base.*, ts_us >= 1705363200000000 AS late, CASE WHEN ts_us < 1705363200000000 AND seq % 9 = 0 THEN 'null' ELSE 'number' END AS price FROM base),
 r AS (SELECT domain, key, ts_us >= 1705363200000000 AS late, CASE WHEN ts_us < 1705363200000000 AND seq % 9 = 0 THEN 'null' ELSE 'number' END AS price,
    count(*) AS responses FROM keyed WHERE kind = 'product' AND NOT body_missing GROUP BY ALL),
 j AS (SELECT r.domain, r.key, responses, b.late AS bl, r.late AS rl, b.price AS bp, r.price AS rp FROM r JOIN b USING (domain, key))
SELECT domain, key, 'name' AS path, 'error' AS severity, 'field disappeared: name was string' AS message, responses FROM j WHERE NOT bl AND rl
UNION ALL SELECT domain, key, 'stock', 'info', 'new field: stock (object)', responses FROM j WHERE NOT bl AND rl
UNION ALL SELECT domain, key, 'name', 'info', 'new field: name (string)', responses FROM j WHERE bl AND NOT rl
UNION ALL SELECT domain, key, 'stock', 'error', 'field disappeared: stock was object', responses FROM j WHERE bl AND NOT rl
UNION ALL SELECT domain, key, 'tags[]', 'warn', 'type changed: ' || CASE WHEN bl THEN 'number' ELSE 'string' END || ' → ' || CASE WHEN rl THEN 'number' ELSE 'string' END, responses FROM j WHERE bl <> rl
UNION ALL SELECT domain, key, 'price', 'warn', 'type changed: ' || bp || ' → ' || rp || CASE WHEN rp = 'null' THEN ' (became nullable)' ELSE '' END, responses FROM j WHERE bp <> rp
UNION ALL SELECT c.domain, c.key, 'refresh_token', CASE WHEN c.session % 2 = 0 THEN 'error' ELSE 'info' END,
  CASE WHEN c.session % 2 = 0 THEN 'field disappeared: refresh_token was string' ELSE 'new field: refresh_token (string)' END, count(*)
 FROM cat c JOIN keyed o USING (domain, key) WHERE c.kind = 'oauth' AND NOT c.body_missing AND NOT o.body_missing AND c.session % 2 <> o.session % 2 GROUP BY ALL"""


@query("schema_drift", _DRIFT)
def _(spark, sf):
    rows = keyed(spark, sf).filter(~F.col("body_missing"))
    out = drift.schema_drift(
        endpoints(spark, sf).filter(F.col("provenance").isNull()),
        rows.select("domain", "key", "ts_us", "response_body"),
    )
    return out.select("domain", "key", "path", "severity", "message", "responses")


def _drift_totals(path: str) -> str:
    """The drift rows above, added up over the versions of an endpoint."""
    head, first, rest = _DRIFT.partition("\nSELECT domain, key, 'name' AS path")
    return (f"{head},\n vs AS ({first}{rest})\nSELECT domain, key, {path} AS path, severity, message, "
            "CAST(sum(responses) AS BIGINT) AS responses FROM vs GROUP BY ALL")


@query("drift_totals", _drift_totals("path"))
def _(spark, sf):
    """Drift counted over responses, from one row per path and type."""
    rows = keyed(spark, sf).filter(~F.col("body_missing"))
    out = drift.drift_totals(
        endpoints(spark, sf).filter(F.col("provenance").isNull()),
        rows.select("domain", "key", "ts_us", "response_body"),
    )
    return out.select("domain", "key", "path", "severity", "message", "responses")


@query("drift_of_keyed_bodies", _drift_totals("'by_id.{id}.' || path"))
def _(spark, sf):
    """The same responses as members of an object whose keys are ids, two in each body."""
    body, n = F.col("response_body"), F.col("seq").cast("string")
    boxed = F.when(F.try_parse_json(body).isNotNull(), F.concat(
        F.lit('{"by_id":{"'), n, F.lit('":'), body, F.lit(',"'), F.lpad(n, 20, "f"), F.lit('":'), body, F.lit("}}")))
    rows = keyed(spark, sf).filter(~F.col("body_missing")).withColumn("response_body", boxed)
    # the schema of the endpoint's first exchange, boxed in the same way
    firsts = rows.groupBy("domain", "key").agg(F.min("ord").alias("ord")).select(traffic.ordinal_seq("ord").alias("seq"))
    # a row per endpoint, kept: a filter on its schema would otherwise be asked of all rows before the join
    first_rows = reliable(join_small(rows.select("seq", "domain", "key", "response_body"), firsts, "seq"))
    base = first_rows.select("domain", "key", bodies.schema_nodes("response_body").alias("response_schema"))
    out = drift.drift_totals(base, rows.select("domain", "key", "ts_us", "response_body"))
    return out.select("domain", "key", "path", "severity", "message", "responses")


@query("confidence_upgrade", f"""{CAT},
 res AS (SELECT domain, key, bool_or(k % 3 = 0) AS ok FROM keyed GROUP BY ALL)
SELECT domain, key, CASE WHEN ok AND body_missing THEN 1.0 WHEN body_missing THEN 0.8 END::DOUBLE AS confidence,
  CASE WHEN ok AND body_missing THEN 'captured' WHEN body_missing THEN 'skeleton' END AS provenance, ok AND body_missing AS upgraded
FROM cat JOIN res USING (domain, key)""")
def _(spark, sf):
    ev = D.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.regexp_extract("props", r"\d+", 0).cast("int").alias("k"))
    results = keyed(spark, sf).select("seq", "domain", "key").join(ev, "seq").select(
        "domain", "key", F.when(F.col("k") % 3 == 0, 204).otherwise(500).alias("status"))
    out = drift.confidence_upgrade(endpoints(spark, sf), results)
    return out.select("domain", "key", "confidence", "provenance", "upgraded")


@query("truncate_responses", f"""{WITH}{EXR},
 it AS (SELECT seq, t.i AS i, sum(octet_length(encode(json_extract(resp_body, '$[' || (t.i - 1) || ']')::VARCHAR)) + 1) OVER (PARTITION BY seq ORDER BY t.i) + 1 AS run
   FROM exr, unnest(range(1, CAST(json_array_length(resp_body) AS BIGINT) + 1)) AS t(i) WHERE kind = 'items'),
 kp AS (SELECT seq, max(run) AS full_bytes, greatest(count(*) FILTER (WHERE run <= 200), 1) AS kept, coalesce(max(run) FILTER (WHERE run <= 200), min(run)) AS bytes FROM it GROUP BY seq)
SELECT seq, full_bytes > 200 AS truncated, kept, CAST(bytes AS BIGINT) AS bytes FROM kp
UNION ALL SELECT seq, kind NOT IN ('down', 'noise') AND octet_length(encode(resp_body)) > 200, NULL,
  CAST(octet_length(encode(resp_body)) AS BIGINT) FROM exr WHERE kind <> 'items'""")
def _(spark, sf):
    e = ex(spark, sf).select("seq", "response_body")
    out = bodies.truncate_responses(e, "response_body", 200)
    items = bodies.as_array(bodies.parse("data"))
    return out.select(
        "seq", F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.when(items.isNotNull(), F.size(items)).cast("bigint").alias("kept"),
        F.octet_length("data").cast("bigint").alias("bytes"),
    )


@query("truncate_documents", """
SELECT doc_id, length(text) > 500 AND octet_length(encode(to_json(text)::VARCHAR)) + 18 > 3000 AS cut FROM documents""")
def _(spark, sf):
    d = D.table(spark, sf, "documents")
    body = d.select("doc_id", F.to_json(F.struct(F.lit("123").alias("id"), F.col("text").alias("t"))).alias("b"))
    out = bodies.truncate_responses(body, "b", 3000)
    return out.select("doc_id", F.col("data").endswith('... [truncated]"}').alias("cut"))


# ------------------------------------------------------------------------------------------
# merge
# ------------------------------------------------------------------------------------------
def imported(spark, sf):
    e = endpoints(spark, sf).filter(F.length("key") % 4 != 0)
    n = F.length("path")
    renamed = F.replace("path", F.lit(":"), F.lit(":x"))
    extra = F.create_map(F.lit("fields"), merge.param(
        F.lit("integer"), F.lit(""), F.lit(True), F.array(F.lit("a")), F.lit(True))).cast(merge.PARAMS)
    none = F.create_map().cast(merge.PARAMS)
    cols = [
        "domain", "method", renamed.alias("path"), "pos",
        F.when(n % 5 == 0, extra).otherwise(none).alias("query_params"),
        F.lit("object").alias("response_type"), F.array(F.lit("id")).alias("response_fields"),
        F.lit(0.7).alias("confidence"), F.lit("openapi-import").alias("provenance"),
        F.when(n % 3 != 1, "https://spec").alias("spec_source"),
        F.when(n % 2 == 0, F.concat(F.lit("Doc of "), "id")).alias("description"),
    ]
    rows = e.select(*cols)
    more = rows.select("domain", F.lit("GET").alias("method"), F.concat("path", F.lit("/extra")).alias("path")).distinct()
    added = more.select(
        "*", F.lit(1).cast("bigint").alias("pos"), none.alias("query_params"), F.lit("object").alias("response_type"),
        F.lit(None).cast("array<string>").alias("response_fields"), F.lit(0.7).alias("confidence"),
        F.lit("openapi-import").alias("provenance"), F.lit("https://spec").alias("spec_source"),
        F.lit("extra").alias("description"),
    )
    return rows.unionByName(added)


def existing(spark, sf):
    none = F.lit(None).cast("string")
    return endpoints(spark, sf).select(
        "domain", "method", "path", "pos", merge.plain_params("query_params").alias("query_params"),
        "response_type", "response_fields", "confidence", "provenance",
        none.alias("spec_source"), none.alias("description"),
    )


# On either side several GraphQL endpoints share a method and path, and the last one wins.
_IMP = f"""{CAT},
 imp AS (SELECT domain, method, path AS path0, replace(path, ':', ':x') AS path, body_missing,
    CASE WHEN length(path) % 2 = 0 THEN 'Doc of ' || id END AS description, CASE WHEN length(path) % 3 <> 1 THEN 'https://spec' END AS spec_source,
    length(path) % 5 = 0 AS has_param, key FROM cat WHERE length(key) % 4 <> 0
    QUALIFY row_number() OVER (PARTITION BY domain, method, path ORDER BY first_us DESC) = 1),
 old AS (SELECT * FROM cat QUALIFY row_number() OVER (PARTITION BY domain, method, path ORDER BY first_us DESC) = 1),
 m AS (SELECT old.domain, old.method, old.path, old.body_missing, imp.key IS NOT NULL AS matched, imp.description, imp.spec_source, imp.has_param,
    CASE WHEN imp.key IS NULL THEN 'preserved'
      WHEN imp.description IS NOT NULL OR imp.spec_source IS NOT NULL OR imp.has_param OR old.body_missing THEN 'enriched' ELSE 'preserved' END AS action
   FROM old LEFT JOIN imp ON old.domain = imp.domain AND old.method = imp.method AND old.path = imp.path0),
 added AS (SELECT DISTINCT domain, 'GET' AS method, path || '/extra' AS path FROM imp),
 mg AS (SELECT domain, method, path, action, description, spec_source, CASE WHEN action = 'enriched' THEN greatest(0.7, CASE WHEN body_missing THEN 0.8 ELSE 0 END)
     WHEN body_missing THEN 0.8 END::DOUBLE AS confidence, CASE WHEN body_missing THEN 'skeleton' END AS provenance,
     coalesce(matched AND has_param, false) AS gained FROM m
   UNION ALL SELECT domain, method, path, 'added', 'extra', 'https://spec', 0.7, 'openapi-import', false FROM added)"""


@query("merge_catalog", f"{_IMP} SELECT * FROM mg")
def _(spark, sf):
    m = merge.merge_catalog(existing(spark, sf), imported(spark, sf))
    return m.select(
        "domain", "method", "path", "action", "description", "spec_source", "confidence", "provenance",
        F.coalesce(F.map_contains_key("query_params", "fields") & (F.col("action") != "added"),
                   F.lit(False)).alias("gained"),
    )


@query("merge_counts", f"""{_IMP}
SELECT domain, count(*) FILTER (WHERE action = 'preserved') AS preserved, count(*) FILTER (WHERE action = 'added') AS added,
  count(*) FILTER (WHERE action = 'enriched') AS enriched, count(*) FILTER (WHERE action = 'skipped') AS skipped FROM mg GROUP BY domain""")
def _(spark, sf):
    return merge.merge_counts(merge.merge_catalog(existing(spark, sf), imported(spark, sf)))


@query("merge_again", f"""{_IMP}
SELECT domain, CAST(sum(CASE WHEN action IN ('enriched', 'added') THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM mg GROUP BY domain""")
def _(spark, sf):
    first = merge.merge_catalog(existing(spark, sf), imported(spark, sf)).drop("action", "normalized_path")
    again = merge.merge_counts(merge.merge_catalog(first, imported(spark, sf)))
    return again.select("domain", "skipped")


@query("cap_endpoints", f"""{_IMP},
 r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN provenance IS NULL OR provenance = 'captured' THEN 0 ELSE 1 END,
   coalesce(confidence, 0) DESC, method, path) AS place FROM mg)
SELECT domain, count(*) AS kept, min(confidence) AS least, count(*) FILTER (WHERE provenance IS NULL) AS captured FROM r WHERE place <= 3 GROUP BY domain""")
def _(spark, sf):
    m = merge.merge_catalog(existing(spark, sf), imported(spark, sf))
    ordered = m.drop("pos").withColumn("pos", F.struct("method", "path"))
    return merge.cap_endpoints(ordered, 3).groupBy("domain").agg(
        F.count("*").alias("kept"), F.min("confidence").alias("least"),
        F.count_if(F.col("provenance").isNull()).alias("captured"),
    )


@query("import_history", f"""{_IMP},
 c AS (SELECT domain, count(*) FILTER (WHERE action = 'added') AS a, count(*) FILTER (WHERE action = 'enriched') AS e FROM mg GROUP BY domain),
 h AS (SELECT domain, 'https://spec' AS spec_url, 100 AS t, a, e FROM c UNION ALL SELECT domain, 'https://spec2', 200 + a, a, e FROM c)
SELECT domain, max_by(spec_url, t) AS spec_url, CAST(max(t) AS BIGINT) AS imported_us,
  CASE WHEN max(t) FILTER (WHERE spec_url = 'https://spec2') >= 203 THEN 'up to date' END AS skip FROM h GROUP BY domain""")
def _(spark, sf):
    counts = merge.merge_counts(merge.merge_catalog(existing(spark, sf), imported(spark, sf)))
    one = merge.import_history(counts, F.lit("https://spec"), F.lit("openapi3"), F.lit(100).cast("bigint"))
    two = merge.import_history(counts, F.lit("https://spec2"), F.lit("openapi3"), F.lit(200) + F.col("added"))
    history = one.unionByName(two)
    entries = counts.select("domain", F.lit("https://spec2").alias("spec_url"), F.lit(203).alias("updated_us"))
    skips = merge.up_to_date(entries, history).select("domain", "skip")
    return merge.last_import(history).join(skips, "domain").select("domain", "spec_url", "imported_us", "skip")


# ------------------------------------------------------------------------------------------
# catalog tables
# ------------------------------------------------------------------------------------------
@query("catalog_store", f"{CAT} SELECT domain, key, CASE WHEN domain LIKE 'api.pay%' THEN 'NEW' ELSE method END AS method, hits FROM cat WHERE domain <> 'www.shop.example.com'")
def _(spark, sf):
    e = endpoints(spark, sf).select("domain", "key", "method", "hits")
    path = state_folder(spark, "catalog")
    catalog.write_catalog(e, path, 8)
    pay = e.filter(F.col("domain").startswith("api.pay")).withColumn("method", F.lit("NEW"))
    catalog.replace_domains(spark, pay, path, 8)
    gone = spark.range(1).select(F.lit("www.shop.example.com").alias("domain"))
    return catalog.remove_from_index(catalog.read_catalog(spark, path, buckets=8), gone)


@query("catalog_one_domain", f"{CAT} SELECT key, hits FROM cat WHERE domain = 'api.shop.example.com'")
def _(spark, sf):
    path = state_folder(spark, "catalog")
    catalog.write_catalog(endpoints(spark, sf).select("domain", "key", "hits"), path, 8)
    return catalog.read_catalog(spark, path, "api.shop.example.com", 8).select("key", "hits")


_DOCS = """WITH d AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 7 = 0 THEN '{broken' WHEN s_suppkey % 7 = 1 THEN '{"domain":"x"}' ELSE
  '{"domain":"d' || CAST(s_suppkey AS STRING) || '.example.net",' || CASE WHEN s_suppkey % 2 = 0 THEN '"provenance":"self",' ELSE '' END ||
  '"endpoints":[{"id":"get-a"},{"id":"post-b","method":"POST","path":"/b","replayability":{"tier":"green","verified":true}}]}' END AS raw FROM supplier)"""


@query("safe_read_catalog", f"""{_DOCS}
SELECT 'd' || n || '.example.net' AS domain, CASE WHEN n % 2 = 0 THEN 'self' ELSE 'unsigned' END AS provenance, '' AS captured_at,
  p AS pos, id, method, path, tier, v AS verified FROM d, (VALUES (0, 'get-a', 'GET', '/', NULL, false), (1, 'post-b', 'POST', '/b', 'green', true)) AS e(p, id, method, path, tier, v)
WHERE n % 7 > 1""")
def _(spark, sf):
    D.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return catalog.documents_to_endpoints(spark.sql(f"{_DOCS} SELECT n, raw FROM d"))


@query("list_catalog", f"{CAT} SELECT domain, count(*) AS endpoints, max(last_us) AS captured_us FROM cat GROUP BY domain")
def _(spark, sf):
    return catalog.list_catalog(endpoints(spark, sf))


@query("search_catalog", f"""{CAT}
SELECT domain, id, method, path, tier, false AS verified FROM cat WHERE contains(lower(domain || ' ' || id || ' ' || path || ' ' || method), 'orders')
  AND contains(lower(domain || ' ' || id || ' ' || path || ' ' || method), 'post')""")
def _(spark, sf):
    return search_index.search(searched(spark, sf), "Orders  POST")


@query("search_short_terms", f"""{CAT}
SELECT domain, id, method, path, tier, false AS verified FROM cat WHERE contains(lower(domain || ' ' || id || ' ' || path || ' ' || method), 'v2')
  AND contains(lower(domain || ' ' || id || ' ' || path || ' ' || method), '/')""")
def _(spark, sf):
    return search_index.search(searched(spark, sf), "v2 /")


@query("search_postings", f"""{CAT},
 t AS (SELECT DISTINCT domain, lower(domain || ' ' || id || ' ' || path || ' ' || method) AS text FROM cat)
SELECT domain, gram, count(*) AS n FROM (SELECT DISTINCT domain, text, text[i:i + s - 1] AS gram FROM t, range(1, 4) AS z(s), unnest(range(1, length(text) - s + 2)) AS p(i))
GROUP BY domain, gram""")
def _(spark, sf):
    return searched(spark, sf).postings.groupBy("domain", "gram").agg(F.sum("n").alias("n"))


@query("search_summary", f"""{CAT}
SELECT count(*) > 0 AS found, count(*) || ' endpoints across ' || count(DISTINCT domain) || CASE WHEN count(DISTINCT domain) = 1 THEN ' domain' ELSE ' domains' END AS summary
FROM cat WHERE contains(domain, 'shop')""")
def _(spark, sf):
    return catalog.search_summary(search_index.search(searched(spark, sf), "shop"))


@query("search_index_update", f"""{CAT},
 u AS (SELECT domain, CASE WHEN domain LIKE 'api.pay%' THEN 'new-' || id ELSE id END AS id, method, path, CASE WHEN domain LIKE 'api.pay%' THEN 'red' ELSE tier END AS tier
   FROM cat WHERE domain <> 'api.shop.example.com')
SELECT domain, id, tier, contains(lower(domain || ' ' || id || ' ' || path || ' ' || method), 'new-') AS found FROM u""")
def _(spark, sf):
    """An index on disk: one domain replaced, another removed, then listed and searched."""
    folder, e = state_folder(spark, "search-index"), endpoints(spark, sf)
    search_index.save_search_index(search_index.build_search_index(e, 8), folder)
    new = e.filter(F.col("domain").startswith("api.pay")).withColumn("tier", F.lit("red")).withColumn(
        "id", F.concat(F.lit("new-"), "id"))
    search_index.replace_in_search_index(spark, folder, new, new, 8)
    gone = spark.range(1).select(F.lit("api.shop.example.com").alias("domain"))
    search_index.replace_in_search_index(spark, folder, gone, buckets=8)
    index = search_index.open_search_index(spark, folder)
    hits = search_index.search(index, "new-").select("domain", "id", "path", "method", F.lit(True).alias("found"))
    listed = search_index.search(index, "")
    return listed.join(hits, ["domain", "id", "path", "method"], "left").select(
        "domain", "id", "tier", F.coalesce("found", F.lit(False)).alias("found"))


@query("index_staleness", f"""{CAT}, n AS (SELECT count(DISTINCT domain) AS d, max(last_us) AS t FROM cat)
SELECT true AS stale, 'missing' AS reason, false AS age_warning FROM n UNION ALL
SELECT d <> 3, CASE WHEN d <> 3 THEN 'filecount-mismatch' END, d = 3 FROM n UNION ALL SELECT false, NULL, false FROM n""")
def _(spark, sf):
    e = endpoints(spark, sf)
    size = e.select("domain").distinct().agg(F.count("*").alias("file_count"))
    now = F.lit(200_000_000_000)
    none = size.filter("false").select(F.lit(1).alias("version"), "file_count", F.lit(0).alias("built_us"))
    three = size.select(F.lit(1).alias("version"), F.lit(3).alias("file_count"), F.lit(0).alias("built_us"))
    fresh = size.select(F.lit(1).alias("version"), "file_count", F.lit(190_000_000_000).alias("built_us"))
    out = [catalog.index_staleness(m, e, now) for m in (none, three, fresh)]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn(
        "age_warning", F.coalesce("age_warning", F.lit(False)))


def invalid_catalog(spark, sf):
    """Domains and endpoints with planted faults, from the page table."""
    p = D.table(spark, sf, "pages").select("page_id", urls.url_host("url").alias("host"))
    domains = p.groupBy(F.col("host").alias("domain")).agg(
        F.min("page_id").alias("n"), F.count("*").alias("endpoints")
    ).withColumn(
        "base_url",
        F.when(F.col("n") % 5 == 0, F.concat(F.lit("https://api."), "domain"))
        .when(F.col("n") % 5 == 1, F.lit("https://other.test/x"))
        .when(F.col("n") % 5 == 2, F.lit("nowhere"))
        .when(F.col("n") % 5 == 3, F.concat(F.lit("http://"), "domain", F.lit(":8080")))
    )
    k = F.col("page_id") % 6
    eps = p.select(
        F.col("host").alias("domain"), F.col("page_id").alias("pos"),
        F.when(k == 0, "").otherwise(F.concat(F.lit("e"), F.col("page_id").cast("string"))).alias("id"),
        F.when(k == 1, "FETCH").otherwise("GET").alias("method"),
        F.when(k == 2, "x").when(k == 3, F.concat(F.lit("/"), F.repeat(F.lit("a"), F.lit(2000)))).otherwise("/ok").alias("path"),
        F.when(k == 4, "http://10.0.0.1/a").otherwise("https://ok.example.com/a").alias("example_url"),
    )
    return domains, eps


_BADCAT = """WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS domain FROM pages),
 dm AS (SELECT domain, min(page_id) AS n, count(*) AS endpoints FROM p GROUP BY domain),
 v AS (SELECT domain, -1 AS pos, CASE n % 5 WHEN 1 THEN 'baseUrl hostname "other.test" does not match domain "' || domain || '"'
     WHEN 2 THEN 'Invalid baseUrl: must be a valid HTTP(S) URL' WHEN 4 THEN 'Missing baseUrl' END AS message FROM dm
   UNION ALL SELECT domain, page_id, 'Endpoint ' || page_id || ': ' || CASE page_id % 6 WHEN 0 THEN 'id must be a string of 1-200 characters'
     WHEN 1 THEN 'method must be one of GET, POST, PUT, PATCH, DELETE, HEAD, OPTIONS' WHEN 2 THEN 'path must start with /' WHEN 3 THEN 'path exceeds 2000 characters' END FROM p),
 vio AS (SELECT * FROM v WHERE message IS NOT NULL),
 un AS (SELECT domain, -1 AS pos, CASE n % 5 WHEN 1 THEN 'baseUrl: URL targets internal domain: other.test' WHEN 2 THEN 'baseUrl: Invalid URL' WHEN 4 THEN 'baseUrl: Invalid URL' END AS reason FROM dm
   UNION ALL SELECT domain, page_id, CASE WHEN page_id % 6 = 4 THEN 'endpoint e' || page_id || ': URL targets private IP: 10.0.0.1' END FROM p),
 uns AS (SELECT domain, min_by(reason, pos) AS reason FROM un WHERE reason IS NOT NULL GROUP BY domain)"""


@query("validate_catalog", f"{_BADCAT} SELECT domain, CAST(pos AS BIGINT) AS pos, message FROM vio")
def _(spark, sf):
    return catalog.validate_catalog(*invalid_catalog(spark, sf))


@query("catalog_url_safety", f"{_BADCAT} SELECT * FROM uns")
def _(spark, sf):
    return catalog.catalog_url_safety(*invalid_catalog(spark, sf))


@query("validate_import", f"""{_BADCAT}, fst AS (SELECT domain, min_by(message, pos) AS message FROM vio GROUP BY domain)
SELECT dm.domain, endpoints, message IS NULL AND n % 3 <> 1 AND reason IS NULL AS valid,
  coalesce(message, CASE WHEN n % 3 = 1 THEN 'Skill file signature is invalid — file was tampered with or signed by a different instance' END, 'SSRF risk: ' || reason) AS reason,
  CASE n % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'unsigned' END AS signature
FROM dm LEFT JOIN fst USING (domain) LEFT JOIN uns USING (domain)""")
def _(spark, sf):
    domains, eps = invalid_catalog(spark, sf)
    k = F.col("n") % 3
    actual = domains.select("domain", F.md5("domain").alias("fingerprint"))
    stored = domains.filter(k < 2).select(
        "domain", F.when(k == 0, F.md5("domain")).otherwise("zz").alias("fingerprint"), F.lit(0).alias("signed_us"))
    states = catalog.signature_state(stored, actual, F.lit(1))
    return catalog.validate_import(domains, eps, states)


FINGERPRINTED = ["domain", "provenance", "id", "method", "path", "response_bytes", "response_type", "tier"]


@query("catalog_fingerprint", f"""{CAT},
 dg AS (SELECT domain, sha256('{{"id":"' || id || '","method":"' || method || '","path":"' || path || '","response_bytes":' || response_bytes
   || ',"response_type":"' || response_type || '","tier":"' || tier || '"}}') AS g FROM cat)
SELECT domain, count(*) AS endpoints, sha256(sum(('0x' || substr(g, 1, 15))::BIGINT) || '|' || sum(('0x' || substr(g, 16, 15))::BIGINT) || '|'
  || sum(('0x' || substr(g, 31, 15))::BIGINT) || '|' || sum(('0x' || substr(g, 46, 15))::BIGINT)) AS fingerprint FROM dg GROUP BY domain""")
def _(spark, sf):
    return catalog.catalog_fingerprint(endpoints(spark, sf).select(*FINGERPRINTED))


@query("signature_state", f"""{CAT}, dm AS (SELECT DISTINCT domain, length(domain) AS n FROM cat)
SELECT domain, CASE n % 3 WHEN 0 THEN 'unsigned' WHEN 1 THEN 'valid' ELSE 'invalid' END AS state, n % 3 = 2 AS stale FROM dm""")
def _(spark, sf):
    actual = catalog.catalog_fingerprint(endpoints(spark, sf).select(*FINGERPRINTED))
    n = F.length("domain") % 3
    stored = actual.filter(n > 0).select(
        "domain", F.when(n == 1, F.col("fingerprint")).otherwise("other").alias("fingerprint"),
        F.when(n == 1, F.lit(16_000_000_000_000)).otherwise(0).alias("signed_us"),
    )
    return catalog.signature_state(stored, actual, F.lit(16_000_000_000_000))


@query("export_scrubbed", f"""{CAT}
SELECT c.domain, c.key, h.name, CASE WHEN h.name IN {in_list(K.EXPORT_SENSITIVE_HEADERS)} THEN '[stored]' ELSE h.value END AS value
FROM cat c, (VALUES ('accept'), ('authorization'), ('x-api-key'), ('x-csrf-token'), ('cookie'), ('x-request-id')) AS n(name),
 LATERAL (SELECT n.name AS name, CASE n.name WHEN 'accept' THEN 'application/json' WHEN 'authorization' THEN h_authorization WHEN 'x-api-key' THEN h_api_key
   WHEN 'x-csrf-token' THEN h_csrf WHEN 'cookie' THEN h_cookie ELSE h_request_id END AS value) AS h WHERE h.value IS NOT NULL
UNION ALL SELECT domain, key, ':template', {TEMPLATE} FROM cat""")
def _(spark, sf):
    e = endpoints(spark, sf).select("domain", "key", "request_template")
    raw = traffic.endpoint_winners(keyed(spark, sf)).select("domain", "key", "seq").join(ex(spark, sf).select("seq", F.col("request_headers").alias("headers")), "seq").join(e, ["domain", "key"])
    out = catalog.export_scrubbed(raw)
    names = ["accept", "authorization", "x-api-key", "x-csrf-token", "cookie", "x-request-id"]
    return out.select("domain", "key", F.explode("headers").alias("name", "value")).filter(F.col("name").isin(names)).unionByName(
        out.select("domain", "key", F.lit(":template").alias("name"), F.col("request_template").alias("value")))


# ------------------------------------------------------------------------------------------
# reports
# ------------------------------------------------------------------------------------------
@query("token_savings", f"""{CAT},
 dom AS (SELECT domain, count(*) AS endpoints, count(*) FILTER (WHERE tier IN ('green', 'yellow')) AS replayable, sum(response_bytes) AS rb,
    CASE WHEN length(domain) % 2 = 0 THEN 400000 ELSE 1000 END AS dom_bytes, 100 * count(*) AS cb FROM cat GROUP BY domain),
 t AS (SELECT domain, endpoints, replayable, dom_bytes, floor(dom_bytes / 4.0 + 0.5) AS bt, floor((cb + rb) / 4.0 + 0.5) AS rt FROM dom),
 g AS (SELECT domain, sum(endpoints)::BIGINT AS endpoints, sum(replayable)::BIGINT AS replayable, sum(dom_bytes)::BIGINT AS dom_bytes,
   sum(bt)::BIGINT AS browser_tokens, sum(rt)::BIGINT AS replay_tokens FROM t GROUP BY ROLLUP (domain))
SELECT *, floor((1.0 - replay_tokens::DOUBLE / browser_tokens) * 1000 + 0.5) / 10.0 AS savings_pct FROM g""")
def _(spark, sf):
    e = endpoints(spark, sf)
    domains = e.groupBy("domain").agg(F.count("*").alias("n")).select(
        "domain", F.when(F.length("domain") % 2 == 0, None).otherwise(1000).cast("bigint").alias("dom_bytes"),
        (F.col("n") * 100).alias("catalog_bytes"))
    return reports.token_savings(domains, e)


_LABEL = """CASE WHEN h_authorization IS NOT NULL THEN 'Bearer' WHEN h_api_key IS NOT NULL THEN 'API Key'
  WHEN h_blob IS NOT NULL AND bits >= 3.5 THEN 'x-blob' WHEN h_csrf IS NOT NULL THEN 'x-csrf-token' ELSE 'none' END"""


@query("inspect_endpoints", f"""{CAT}
SELECT domain, method, path, tier, {_LABEL} AS auth, response_bytes, response_type, operation AS graphql,
 CASE WHEN kind = 'product' THEN 'offset' WHEN kind = 'items' AND seq % 3 = 0 THEN 'page' WHEN kind = 'items' THEN 'cursor' END AS pagination FROM cat""")
def _(spark, sf):
    return reports.inspect_endpoints(endpoints(spark, sf)).drop("response_fields", "pagination_param")


@query("inspect_summary", f"""{CAT},
 s AS (SELECT domain, count(*) AS total, count(*) FILTER (WHERE tier IN ('green', 'yellow')) AS replayable, count(*) FILTER (WHERE {_LABEL} <> 'none') AS auth_required,
   CASE WHEN bool_or(contains(path, '_next/')) THEN 'Next.js' WHEN bool_or(operation IS NOT NULL) THEN 'GraphQL' END AS framework,
   CAST(floor(length(domain) * 50 / 4.0 + 0.5) AS BIGINT) AS browser_tokens, CAST(floor(sum(response_bytes) / 4.0 + 0.5) AS BIGINT) AS replay_tokens FROM cat GROUP BY domain)
SELECT *, floor((1.0 - replay_tokens::DOUBLE / browser_tokens) * 1000 + 0.5) / 10.0 AS savings_pct FROM s""")
def _(spark, sf):
    e = reports.inspect_endpoints(endpoints(spark, sf))
    dom = e.select("domain").distinct().withColumn("dom_bytes", F.length("domain") * 50)
    return reports.inspect_summary(e, dom)


@query("tier_histogram", f"""{CAT}
SELECT domain, count(*) FILTER (WHERE tier = 'green') AS green, count(*) FILTER (WHERE tier = 'yellow') AS yellow,
 count(*) FILTER (WHERE tier = 'orange') AS orange, CAST(0 AS BIGINT) AS red, CAST(0 AS BIGINT) AS unknown FROM cat GROUP BY domain""")
def _(spark, sf):
    return reports.tier_histogram(endpoints(spark, sf))


# ------------------------------------------------------------------------------------------
# request planning
# ------------------------------------------------------------------------------------------
@query("render_requests", f"""{CAT},
 pr AS (SELECT id, path, raw_path, domain, unnest(string_split(ltrim(query, '?'), '&')) AS kv FROM cat WHERE id = 'post-api-users-profile' AND domain = 'api.shop.example.com'),
 pv AS (SELECT string_split(kv, '=')[1] AS name, string_split(kv, '=')[2] AS val FROM pr),
 pc AS (SELECT val, unnest(string_split(val, '')) AS ch FROM (SELECT DISTINCT val FROM pv)),
 pb AS (SELECT val, -sum(n / length(val) * log2(n / length(val))) AS bits FROM (SELECT val, ch, count(*) AS n FROM pc WHERE ch <> '' GROUP BY val, ch) GROUP BY val),
 ps AS (SELECT name, val, length(val) >= 16 AND round(bits, 12) >= 3.5 AS hot FROM pv LEFT JOIN pb USING (val)),
 pq AS (SELECT max(CASE WHEN name = 'ref' THEN CASE WHEN hot THEN '%5Bscrubbed%5D' ELSE val END END) AS ref,
   max(CASE WHEN name = 'email' THEN CASE WHEN hot THEN '%5Bscrubbed%5D' ELSE '%5Bemail%5D' END END) AS email FROM ps),
 calls AS (SELECT seq AS call_id, CASE WHEN seq % 7 = 0 THEN 'none.example.com' ELSE 'api.shop.example.com' END AS domain,
   CASE seq % 4 WHEN 0 THEN 'get-api-v1-products' WHEN 1 THEN 'post-api-v2-orders' WHEN 2 THEN 'post-api-users-profile' ELSE 'get-nothing' END AS endpoint_id, k FROM ex),
 j AS (SELECT c.*, cat.path, cat.raw_path, cat.query, cat.tier FROM calls c LEFT JOIN cat ON cat.domain = c.domain AND cat.id = c.endpoint_id)
SELECT call_id, endpoint_id, CASE WHEN path IS NULL THEN NULL
  WHEN endpoint_id = 'get-api-v1-products' THEN 'https://' || domain || raw_path || '?limit=' || k || '&' || string_split(query, '&')[2] || '&order_id=' || k || '&q=a+b'
  WHEN endpoint_id = 'post-api-users-profile' THEN 'https://' || domain || raw_path || '?email=' || (SELECT email FROM pq) || '&limit=' || k || '&order_id=' || k || '&q=a+b&ref=' || (SELECT ref FROM pq) || '&session_token=%5Bscrubbed%5D'
  WHEN endpoint_id = 'post-api-v2-orders' THEN 'https://' || domain || '/api/v2/orders/' || k || '?limit=' || k || '&q=a+b' END AS url,
 CASE WHEN domain LIKE 'none%' THEN 'No skill file found for "' || domain || '"' WHEN path IS NULL THEN 'Endpoint "' || endpoint_id || '" not found in skill for ' || domain END AS error,
 CASE WHEN domain NOT LIKE 'none%' THEN coalesce(tier, 'unknown') END AS tier
FROM j""")
def _(spark, sf):
    """All calls with their whole URLs."""
    ev = spread_groups(D.table(spark, sf, "events"))
    k = F.regexp_extract("props", r"\d+", 0)
    s = F.col("event_id")
    calls = ev.select(
        s.alias("call_id"),
        F.when(s % 7 == 0, "none.example.com").otherwise("api.shop.example.com").alias("domain"),
        F.when(s % 4 == 0, "get-api-v1-products").when(s % 4 == 1, "post-api-v2-orders")
        .when(s % 4 == 2, "post-api-users-profile").otherwise("get-nothing").alias("endpoint_id"),
        F.create_map(F.lit("limit"), k, F.lit("q"), F.lit("a b"), F.lit("order_id"), k,
                     F.lit("body.x"), k).alias("params"),
    )
    cat = endpoints(spark, sf).withColumn("query_params", merge.plain_params("query_params"))
    return requests.render_requests(calls, cat).drop("domain")


@query("pick_endpoints", f"""{CAT},
 pg AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'api.shop.example.com' WHEN 1 THEN 'www.shop.example.com' WHEN 2 THEN 'nope.example.com'
     WHEN 3 THEN 'api.shop.example.com' WHEN 4 THEN 'www.shop.example.com' ELSE 'many.example.com' END AS domain,
   CASE WHEN page_id % 6 = 5 THEN '/orders/k' || page_id || '/z' WHEN page_id % 4 = 0 THEN '/' WHEN page_id % 4 = 1 THEN '/api/v1/products/:product_id/x'
     WHEN page_id % 4 = 2 THEN '/items' ELSE '/zzz' END AS path FROM pages),
 cd AS (SELECT domain, id, path AS t, first_us FROM cat WHERE method = 'GET' AND tier IN ('green', 'yellow', 'unknown')
   UNION ALL SELECT 'many.example.com', 'o' || o_orderkey, '/orders/k' || o_orderkey || '/z/:id', o_orderkey FROM orders),
 r AS (SELECT pg.page_id, pg.domain, cd.id, pg.path <> '/' AND (contains(pg.path, cd.t) OR contains(cd.t, pg.path)) AS hit,
   row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN pg.path <> '/' AND (contains(pg.path, cd.t) OR contains(cd.t, pg.path)) THEN 0 ELSE 1 END, first_us) AS rn
   FROM pg LEFT JOIN cd USING (domain))
SELECT page_id, domain, id AS endpoint_id, coalesce(hit, false) AS overlaps FROM r WHERE rn = 1""")
def _(spark, sf):
    n = F.col("page_id")
    order_path = F.concat(F.lit("/orders/k"), n, F.lit("/z"))
    p = D.table(spark, sf, "pages").select(
        "page_id",
        F.when(n % 6 == 5, "many.example.com").when(n % 6 == 2, "nope.example.com")
        .when(n % 3 == 0, "api.shop.example.com").otherwise("www.shop.example.com").alias("domain"),
        F.when(n % 6 == 5, order_path).when(n % 4 == 0, "/").when(n % 4 == 1, "/api/v1/products/:product_id/x")
        .when(n % 4 == 2, "/items").otherwise("/zzz").alias("path"),
    )
    k = F.col("o_orderkey")
    many = D.table(spark, sf, "orders").select(
        F.lit("many.example.com").alias("domain"), F.concat(F.lit("o"), k).alias("id"), F.lit("GET").alias("method"),
        F.concat(F.lit("/orders/k"), k, F.lit("/z/:id")).alias("path"), F.lit("green").alias("tier"), k.alias("pos"))
    known = endpoints(spark, sf).select("domain", "id", "method", "path", "tier", "pos")
    return requests.pick_endpoints(p, known.unionByName(many))


@query("verified_tiers", f"""{CAT}, r AS (SELECT *, length(key) % 6 AS kk FROM cat)
SELECT domain, id, CASE kk WHEN 0 THEN tier WHEN 1 THEN 'green' WHEN 2 THEN 'yellow' WHEN 3 THEN 'orange' WHEN 4 THEN 'red' ELSE 'green' END AS tier, kk <> 0 AS verified,
 CASE kk WHEN 0 THEN '' WHEN 1 THEN CASE WHEN response_type = 'object' THEN 'status-match,shape-match' ELSE 'status-match' END WHEN 2 THEN 'auth-required' WHEN 3 THEN 'status-503'
  WHEN 4 THEN 'connection-failed' ELSE CASE WHEN response_type = 'array' THEN 'status-match,shape-match' ELSE 'status-match' END END AS signals FROM r""")
def _(spark, sf):
    e = endpoints(spark, sf)
    k = F.length("key") % 6
    results = e.filter(k != 0).select(
        "domain", "id",
        F.when(k == 1, 200).when(k == 2, 403).when(k == 3, 503).when(k == 5, 204).alias("status"),
        F.when(k == 5, "array").otherwise("object").alias("response_type"))
    return requests.verified_tiers(e, results)


@query("confidence_hints", f"""{_IMP}
SELECT domain, method, path, CASE WHEN coalesce(confidence, 1.0) >= 0.85 THEN NULL
 WHEN provenance = 'skeleton' THEN '(observed in traffic, no response shape — first successful replay will upgrade)'
 ELSE '(imported from spec — params may need adjustment)' END AS hint, action = 'added' OR gained AS from_spec FROM mg""")
def _(spark, sf):
    m = merge.merge_catalog(existing(spark, sf), imported(spark, sf))
    omitted = F.exists(F.map_values("query_params"), lambda p: requests.should_omit(p))
    return m.select(
        "domain", "method", "path",
        requests.confidence_hint(F.col("confidence"), F.col("provenance")).alias("hint"),
        ((F.col("action") == "added") | omitted).alias("from_spec"),
    )


