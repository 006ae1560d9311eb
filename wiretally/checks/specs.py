"""Checks of spec documents and directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.checks.base import query
from wiretally.checks.sqlparts import DIRECTORY, SPECS, in_list, lit
from wiretally.operators import merge, specs
from wiretally.session import spread_groups
from wiretally.sources import derived as D


def profiled(spark, sf):
    return specs.profile_specs(specs.read_specs(D.specs(spark, sf)))


_SP = f"""WITH sp AS (SELECT *, CASE WHEN spec_id % 11 = 0 THEN 'not a spec' WHEN spec_id % 13 = 0 THEN 'not json' END AS problem,
   CASE WHEN spec_id % 11 = 0 OR spec_id % 13 = 0 THEN 'bad' WHEN spec_id % 3 = 0 THEN 'v2' ELSE 'v3' END AS form FROM ({SPECS}) AS s),
 pr AS (SELECT spec_id, spec_url, raw, form, problem, s_nationkey AS nk,
   CASE WHEN form = 'bad' THEN 'raw.example.org' WHEN form = 'v2' THEN 's' || spec_id || '.legacy.example.net'
     ELSE CASE spec_id % 4 WHEN 0 THEN 'p' || s_nationkey || '.example.org' WHEN 1 THEN 'api.n' || s_nationkey || '.example.org' WHEN 2 THEN 'petstore.swagger.io' ELSE 'raw.example.org' END END AS domain,
   CASE WHEN form = 'v2' THEN '/v1' WHEN form = 'v3' THEN CASE spec_id % 4 WHEN 0 THEN '/rel' WHEN 1 THEN '/v' || (spec_id % 3) WHEN 2 THEN '/v2' ELSE '' END ELSE '' END AS base_path,
   form = 'v3' AND (spec_id % 5 = 0 OR spec_id % 7 IN (1, 2)) AS requires_auth,
   CASE WHEN form = 'v3' THEN CASE spec_id % 7 WHEN 1 THEN 'bearer' WHEN 2 THEN 'apiKey' END END AS auth_type
  FROM sp JOIN supplier ON s_suppkey = spec_id)"""


@query("spec_profile", f"""{_SP}
SELECT spec_id, problem, domain, base_path, CASE WHEN form = 'v2' THEN 'swagger2' ELSE 'openapi3' END AS spec_version,
  requires_auth, auth_type, form = 'v2' OR (form = 'v3' AND spec_id % 4 <> 3) AS has_server,
  form = 'v3' AND spec_id % 4 = 2 AS is_placeholder,
  CASE form WHEN 'v2' THEN 2 WHEN 'v3' THEN 4 ELSE 0 END::BIGINT AS operations FROM pr""")
def _(spark, sf):
    out = specs.operation_counts(profiled(spark, sf))
    return out.select("spec_id", "problem", "domain", "base_path", "spec_version", "requires_auth",
                      "auth_type", "has_server", "is_placeholder", "operations")


_OPS = f"""{_SP},
 t(form, ord, method, path, id, rtype, fields, descr, q) AS (VALUES
  ('v2', 0, 'GET', '/parts', 'get-v1-parts', 'array', 'id,name', 'List', 'q=string:'), ('v2', 1, 'POST', '/parts', 'post-createpart', 'object', 'id,name', NULL, ''),
  ('v3', 0, 'GET', '/parts', 'get-get-part', 'unknown', NULL, NULL, ''), ('v3', 1, 'POST', '/parts', 'post-get-part', 'array', 'id,name', NULL, ''),
  ('v3', 2, 'GET', '/parts/:partId', 'get-getpart', 'object', 'id,name', 'Read part', 'lang=string:en,view=string:*sl'),
  ('v3', 3, 'DELETE', '/parts/:partId', NULL, 'unknown', NULL, NULL, '')),
 op AS (SELECT pr.*, t.*, spec_id % 2 = 0 AND ord IN (2, 3) AND pr.form = 'v3' AS path_ex FROM pr JOIN t ON t.form = pr.form)"""


@query("spec_operations", f"""{_OPS}
SELECT spec_id, domain, method, base_path || path AS path, coalesce(id, 'delete-' || CASE WHEN base_path = '' THEN '' ELSE base_path[2:] || '-' END || 'parts') AS id0,
  rtype AS response_type, fields AS response_fields, descr AS description, q AS params,
  round(least(0.85, 0.6 + CASE WHEN path_ex OR q LIKE 'lang%' THEN 0.1 ELSE 0 END + CASE WHEN requires_auth THEN 0 ELSE 0.1 END + CASE WHEN method = 'GET' THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence,
  'https://' || domain || base_path || CASE WHEN path_ex THEN '/parts/' || spec_id ELSE path END || CASE WHEN q LIKE 'lang%' THEN '?lang=en' ELSE '' END AS example_url,
  CASE WHEN op.form_1 = 'v2' AND method = 'POST' THEN 'id=' || spec_id || ',name={{{{name}}}}' WHEN method = 'POST' THEN 'id=7,name={{{{name}}}}' END AS body
FROM (SELECT * FROM op) AS op""".replace("op.form_1", "op.form").replace("{{{{", "{{").replace("}}}}", "}}"))
def _(spark, sf):
    o = specs.spec_operations(profiled(spark, sf).filter("problem is null"))
    params = F.array_join(F.array_sort(F.transform(
        F.map_entries("query_params"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]["type"], F.lit(":"), e["value"]["example"],
                           F.when(e["value"]["required"], "*").otherwise(""),
                           F.coalesce(F.array_join(e["value"]["enum"], ""), F.lit(""))))), ",")
    body = F.array_join(F.array_sort(F.transform(
        F.map_entries("request_body.template"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    base = F.regexp_replace("id", "-[0-9]+$", "")
    return o.select(
        "spec_id", "domain", "method", "path",
        F.when(F.col("method") == "DELETE", F.col("id")).otherwise(base).alias("id0"),
        "response_type", F.array_join("response_fields", ",").alias("response_fields"), "description",
        params.alias("params"), "confidence", "example_url", body.alias("body"),
    )


_LONG = "x" * 90


@query("spec_ids_unique", f"""
SELECT s_suppkey AS spec_id, path, id FROM supplier, (VALUES ('/a', 'get-same'), ('/b', 'get-same-2'), ('/c', 'get-same-2-2'), ('/d', 'get-same-3'),
  ('/e', 'get-{_LONG[:76]}'), ('/f', 'get-{_LONG[:74]}-2'), ('/g', 'get-{_LONG[:74]}-3')) AS t(path, id)
UNION ALL SELECT spec_id, 'all', count(*) || ' of ' || count(*) FROM ({_OPS} SELECT spec_id FROM op) GROUP BY spec_id""")
def _(spark, sf):
    # a natural name that looks numbered, and names longer than an id
    names = {"/a": "same", "/b": "same", "/c": "same-2", "/d": "same", "/e": _LONG, "/f": _LONG, "/g": _LONG}
    doc = '{"openapi":"3.0.0","info":{"title":"t"},"servers":[{"url":"https://ids.example.org"}],"paths":{' + ",".join(
        f'"{p}":{{"get":{{"operationId":"{n}","responses":{{}}}}}}' for p, n in names.items()) + "}}"
    hard = spread_groups(D.table(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("spec_id"), F.concat(F.lit("https://s/"), "s_suppkey").alias("spec_url"), F.lit(doc).alias("raw"))
    ids = specs.spec_operations(specs.profile_specs(specs.read_specs(hard))).select("spec_id", "path", "id")
    o = specs.spec_operations(profiled(spark, sf).filter("problem is null"))
    per = o.groupBy("spec_id").agg(F.concat(F.count_distinct("id"), F.lit(" of "), F.count("*")).alias("id"))
    return ids.unionByName(per.select("spec_id", F.lit("all").alias("path"), "id"))


@query("deep_references", "SELECT s_suppkey AS spec_id, 'object' AS type, 'deep' AS fields FROM supplier")
def _(spark, sf):
    # a response behind a chain of 12 to 31 references
    last = (12 + F.col("s_suppkey") % 20).cast("int")
    chain = F.array_join(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat(
        F.lit('"S'), i, F.lit('":{"$ref":"#/components/schemas/S'), i + 1, F.lit('"},'))), "")
    raw = F.concat(
        F.lit('{"openapi":"3.0.0","info":{"title":"t"},"servers":[{"url":"https://deep.example.org"}],"paths":{"/x":{"get":{"responses":'
              '{"200":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/S0"}}}}}}}},"components":{"schemas":{'),
        chain, F.lit('"S'), last, F.lit('":{"type":"object","properties":{"deep":{"type":"string"}}}}}}'))
    docs = spread_groups(D.table(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("spec_id"), F.concat(F.lit("https://s/"), "s_suppkey").alias("spec_url"), raw.alias("raw"))
    o = specs.spec_operations(specs.profile_specs(specs.read_specs(docs)))
    return o.select("spec_id", F.col("response_type").alias("type"), F.array_join("response_fields", ",").alias("fields"))


@query("import_gates", f"""{_SP}
SELECT spec_id, CASE WHEN problem IS NOT NULL THEN 'fail: ' || problem WHEN requires_auth THEN 'skip: requires auth'
 WHEN form = 'v3' AND spec_id % 4 = 2 THEN 'skip: placeholder host' WHEN form = 'v3' AND spec_id % 4 IN (0, 1, 3) OR form = 'v2' THEN 'import' END AS outcome FROM pr""")
def _(spark, sf):
    gated = specs.import_gates(profiled(spark, sf), no_auth_only=True)
    return gated.select("spec_id", "outcome")


@query("import_summary", f"""{_SP},
 o AS (SELECT form, problem IS NULL AND NOT (form = 'v3' AND spec_id % 4 = 2) AS ok, problem FROM pr)
SELECT count(*) FILTER (WHERE ok) AS imported, count(*) FILTER (WHERE problem IS NOT NULL) AS failed,
 count(*) FILTER (WHERE NOT ok AND problem IS NULL) AS skipped, CAST(sum(CASE WHEN ok THEN CASE form WHEN 'v2' THEN 2 ELSE 4 END ELSE 0 END) AS BIGINT) AS endpoints_added FROM o""")
def _(spark, sf):
    gated = specs.import_gates(profiled(spark, sf))
    added = specs.spec_operations(gated.filter("outcome = 'import'"))
    return specs.import_summary(gated, added)


@query("import_specs", f"""{_OPS},
 n AS (SELECT *, row_number() OVER (PARTITION BY op.domain, op.method, base_path || regexp_replace(path, ':[A-Za-z]+', ':_') ORDER BY spec_id DESC, ord DESC) AS rn
   FROM op WHERE NOT (op.form = 'v3' AND spec_id % 4 = 2))
SELECT domain, method, base_path || path AS path, spec_url AS spec_source, rtype AS response_type, 'added' AS action FROM n WHERE rn = 1""".replace("SELECT *, row_number", "SELECT op.*, row_number"))
def _(spark, sf):
    good = specs.import_gates(profiled(spark, sf)).filter("outcome = 'import'")
    new = specs.spec_operations(good).withColumn("pos", F.col("pos").cast("bigint"))
    merged = merge.merge_catalog(new.filter("false"), new)
    return merged.select("domain", "method", "path", "spec_source", "response_type", "action")


# ------------------------------------------------------------------------------------------
# directories
# ------------------------------------------------------------------------------------------
_DIR = f"WITH d AS ({DIRECTORY}), s AS (SELECT s_suppkey AS k, s_nationkey AS nk FROM supplier)"
_GURU = """ guru AS (SELECT 'guru' AS source, CASE k % 3 WHEN 0 THEN 'api' || k || '.example.org' ELSE 'prov' || nk END AS provider,
   CASE k % 3 WHEN 0 THEN 'Zero ' ELSE 'One ' END || k AS title, 'https://g.example.org/' || k || '/' || (k % 3) || '.json' AS spec_url,
   CASE k % 3 WHEN 0 THEN '2.0' ELSE '3.0.1' END AS openapi_ver,
   CASE k % 3 WHEN 0 THEN '2023-0' || (1 + k % 9) || '-01T00:00:00Z' ELSE '2024-0' || (1 + k % 9) || '-02T00:00:00Z' END AS updated FROM s WHERE k % 3 <> 2)"""
_HUB = """ hub AS (SELECT 'hub' AS source, 'own' || nk AS provider, CASE WHEN k % 3 = 0 THEN 'About ' || k ELSE 'hub' || k END AS title,
   'https://api.swaggerhub.com/apis/own' || nk || '/hub/' || k AS spec_url, '3.0.0' AS openapi_ver, '2024-01-0' || (1 + k % 9) AS updated FROM s WHERE k % 6 <> 0)"""


def dirs(spark, sf):
    return D.directories(spark, sf)


@query("directory_guru", f"{_DIR},{_GURU} SELECT * FROM guru")
def _(spark, sf):
    return specs.guru_entries(dirs(spark, sf))


@query("directory_hub", f"{_DIR},{_HUB} SELECT * FROM hub")
def _(spark, sf):
    return specs.hub_entries(dirs(spark, sf))


_LIST = f"""{_DIR},
 ls AS (SELECT k, 'o' || nk AS owner, CASE k % 3 WHEN 0 THEN 'Rest-API' WHEN 1 THEN 'openapi-x' ELSE 'site' END AS repo, 'o' || nk || '/r' || (k % 40) AS full_name,
   CASE WHEN k % 2 = 0 THEN 'spec/' ELSE '' END || 'openapi.json' AS file_path, 'https://git.example.org/o' || nk || '/r' || (k % 40) AS html_url,
   k % 17 AS stars, k % 9 = 0 AS is_fork, k % 8 = 0 AS is_archived, '20' || (18 + k % 7) || '-05-01T00:00:00Z' AS pushed_at, CASE WHEN k % 4 = 1 THEN 'dev' ELSE 'main' END AS br FROM s)"""


@query("directory_listing", f"""{_LIST}
SELECT owner, repo, full_name, file_path, html_url, 'https://raw.githubusercontent.com/' || full_name || '/' || br || '/' || file_path AS spec_url,
 stars, is_fork, is_archived, pushed_at FROM ls""")
def _(spark, sf):
    return specs.listing_entries(dirs(spark, sf))


@query("filter_repos", f"""{_LIST}
SELECT html_url, file_path, stars, CASE WHEN is_fork THEN 'fork' WHEN is_archived THEN 'archived'
  WHEN date_diff('day', CAST(pushed_at[1:10] AS DATE), DATE '2024-06-01') > 1095 THEN 'stale, last push ' || pushed_at[1:10]
  WHEN stars < 5 THEN stars || ' stars, below --min-stars 5' END AS skip,
  regexp_matches(repo, {lit(K.SPEC_REPO_RE)}) AS named, string_split(file_path, '/')[-1] IN {in_list(K.SPEC_FILENAMES)} AS is_spec FROM ls""")
def _(spark, sf):
    out = specs.filter_repos(specs.listing_entries(dirs(spark, sf)), F.lit("2024-06-01").cast("date"), 5)
    return out.select("html_url", "file_path", "stars", "skip", F.col("repo").rlike(K.SPEC_REPO_RE).alias("named"),
                      specs.is_spec_filename().alias("is_spec"))


@query("distinct_listings", f"""{_LIST}
SELECT html_url, min(CASE WHEN stars >= 8 THEN 0 ELSE 1 END) AS best FROM ls GROUP BY html_url""")
def _(spark, sf):
    rows = specs.listing_entries(dirs(spark, sf))
    out = specs.distinct_listings(rows.filter("stars >= 8"), rows.filter("stars < 8"))
    return out.select("html_url", F.when(F.col("stars") >= 8, 0).otherwise(1).alias("best"))


@query("unseen_repos", f"""{_LIST}
SELECT full_name, repo, file_path FROM ls WHERE regexp_matches(repo, {lit(K.SPEC_REPO_RE)}) AND full_name NOT IN (SELECT full_name FROM ls WHERE stars > 9)""")
def _(spark, sf):
    rows = specs.listing_entries(dirs(spark, sf))
    return specs.unseen_repos(rows, rows.filter("stars > 9")).select("full_name", "repo", "file_path")


@query("top_repos", f"""{_LIST}
SELECT html_url, stars, len(string_split(file_path, '/'))::INTEGER AS depth FROM ls ORDER BY stars DESC, depth, html_url LIMIT 12""")
def _(spark, sf):
    return specs.top_repos(specs.listing_entries(dirs(spark, sf)), 12).select(
        "html_url", "stars", F.size(F.split("file_path", "/")).alias("depth"))


@query("search_directory", f"""{_DIR},{_GURU},{_HUB}, u AS (SELECT * FROM guru UNION ALL SELECT * FROM hub)
SELECT * FROM u WHERE contains(lower(provider), 'own1') OR contains(lower(title), 'own1') OR contains(lower(provider), 'zzz')
ORDER BY CASE WHEN openapi_ver LIKE '3%' THEN 0 ELSE 1 END, updated DESC, spec_url LIMIT 20""")
def _(spark, sf):
    both = specs.guru_entries(dirs(spark, sf)).unionByName(specs.hub_entries(dirs(spark, sf)))
    return specs.search_directory(both, "Own1", prefer_3=True, limit=20)


@query("curated_specs", """
SELECT s_name AS provider, 'r' || s_suppkey AS repo, 'openapi.json' AS spec_path, 'https://x/' || s_suppkey AS spec_url, 'n' AS notes
FROM supplier WHERE contains(lower(s_name), '7')""")
def _(spark, sf):
    s = spread_groups(D.table(spark, sf, "supplier")).select(
        F.col("s_name").alias("provider"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("repo"),
        F.lit("openapi.json").alias("specPath"),
        F.concat(F.lit("https://x/"), F.col("s_suppkey").cast("string")).alias("specUrl"), F.lit("n").alias("notes"))
    return specs.curated_specs(s, "7")
