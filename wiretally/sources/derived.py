"""Input tables derived from the shared test tables.

The shared tables hold no HTTP log, so exchanges, page responses, probe results, specs, directories
and payloads are derived from them by plain arithmetic. Every derivation is one SELECT in SQL that
both Spark and a reference SQL engine read the same way, with no randomness; the few dialect
differences are filled in by ``{...}`` marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wiretally.session import spread, spread_groups, state_folder

SPARK = {
    "ts_us": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))",
}
ANSI = {"ts_us": "epoch_us(ts)"}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _fill(sql: str, dialect: dict[str, str]) -> str:
    for mark, text in dialect.items():
        sql = sql.replace("{" + mark + "}", text)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LANDED: dict[tuple[str, str, str], str] = {}
_SCHEMAS: dict[tuple[str, str, str], StructType] = {}


def landed(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Write a derived table once per application to the shared folder and read it back, so that
    jobs start from a parquet scan, as they do on landed logs."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _LANDED:
        df = spread(build())
        folder = state_folder(spark, f"derived-{name}")
        df.write.parquet(folder)
        _LANDED[slot], _SCHEMAS[slot] = folder, df.schema
    return spark.read.schema(_SCHEMAS[slot]).parquet(_LANDED[slot])


def landed_path(
    spark: SparkSession, sf_dir: str, name: str, ensure: Callable[[SparkSession, str], DataFrame]
) -> str:
    """Folder of a landed table, for streaming reads; ``ensure`` lands it."""
    ensure(spark, sf_dir)
    return _LANDED[(spark.sparkContext.applicationId, sf_dir, name)]


# ------------------------------------------------------------------------------------------
# exchanges
# ------------------------------------------------------------------------------------------
_EVENTS = """
SELECT event_id AS seq, ts, {ts_us} AS ts_us, user_id AS u,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
  CAST(round(value * 100) AS BIGINT) AS cents,
  md5(CAST(event_id AS STRING)) AS hex,
  CASE event_type
    WHEN 'view' THEN 'product' WHEN 'click' THEN 'items' WHEN 'purchase' THEN 'order'
    WHEN 'signup' THEN CASE WHEN event_id % 5 = 4 THEN 'login' ELSE 'profile' END
    ELSE CASE event_id % 4 WHEN 0 THEN 'down' WHEN 1 THEN 'graphql' WHEN 2 THEN 'noise'
         ELSE 'oauth' END END AS kind
FROM events
"""
_S = "CAST({} AS STRING)".format

_EXCHANGES = f"""
SELECT seq, ts, ts_us, u AS session, seq AS request_id, kind, k, cents, host, path, query,
  'https://' || host || path || query AS url, method, status, content_type,
  h_authorization, h_api_key, h_csrf, h_cookie, h_blob, h_request_id, h_content_type, h_fetch_mode,
  req_body, resp_body, r_length, r_link, r_total, r_set_cookie, r_cf_ray, r_retry, body_missing
FROM (
 SELECT seq, ts, ts_us, u, k, cents, kind,
  CASE u % 5 WHEN 0 THEN 'api.shop.example.com' WHEN 1 THEN 'www.shop.example.com'
    WHEN 2 THEN 'cdn.segment.com' WHEN 3 THEN 'o1.ingest.sentry.io'
    ELSE 'api.pay.example.net' END AS host,
  CASE kind WHEN 'product' THEN '/api/v1/products/' || {_S('u')}
    WHEN 'items' THEN '/_next/data/b' || {_S('seq % 7')} || 'x9k2m4q8/en/items.json'
    WHEN 'order' THEN '/api/v2/orders/' || {_S('seq')}
    WHEN 'profile' THEN '/api/users/u' || {_S('u')} || '/profile'
    WHEN 'login' THEN '/api/login' WHEN 'graphql' THEN '/graphql'
    WHEN 'oauth' THEN '/oauth/token' ELSE '/monitoring' END AS path,
  CASE kind WHEN 'product' THEN '?limit=10&offset=' || {_S('seq % 50')}
    WHEN 'items' THEN CASE WHEN seq % 3 = 0 THEN '?page=' || {_S('k')}
       ELSE '?cursor=' || substr(hex, 1, 20) END
    WHEN 'profile' THEN '?email=user' || {_S('u')} || '@mail.example.com&session_token=' || hex
       || '&ref=' || hex
    ELSE '' END AS query,
  CASE WHEN kind IN ('order', 'profile', 'login', 'graphql', 'oauth') THEN 'POST' ELSE 'GET' END
    AS method,
  CASE WHEN kind = 'down' THEN 500 WHEN kind = 'product' AND seq % 37 = 0 THEN 404 ELSE 200 END
    AS status,
  CASE WHEN seq % 11 = 0 THEN 'text/html' WHEN seq % 5 = 0 THEN 'application/vnd.api+json'
    ELSE 'Application/JSON ; charset=utf-8' END AS content_type,
  CASE WHEN seq % 6 = 0 THEN 'Bearer eyJhbGciOiJIUzI1NiJ9.' || replace(translate(base64(CAST(
        '{{"exp":' || {_S('1704067200 + seq * 60')} || ',"iss":"auth' || {_S('u % 3')}
        || '","aud":7,"scope":"read"}}' AS BINARY)), '+/', '-_'), '=', '') || '.c2ln'
    WHEN seq % 6 = 3 THEN 'Basic dXNlcjpwYXNz' END AS h_authorization,
  CASE WHEN seq % 3 = 1 THEN 'key-' || substr(hex, 1, 12) END AS h_api_key,
  CASE WHEN seq % 5 = 0 THEN substr(hex, 1, 24) END AS h_csrf,
  CASE WHEN seq % 8 = 0 THEN 'sid=' || substr(hex, 1, 6) || '; _abck=1'
    WHEN seq % 4 = 0 THEN 'sid=' || substr(hex, 1, 6) || '; __cf_bm=1' END AS h_cookie,
  CASE WHEN seq % 7 = 0 THEN hex WHEN seq % 7 = 1 THEN 'aaaabbbbccccdddd' END AS h_blob,
  hex AS h_request_id,
  CASE WHEN kind IN ('profile', 'oauth') THEN 'application/x-www-form-urlencoded'
    WHEN kind IN ('order', 'login', 'graphql') THEN 'application/json' END AS h_content_type,
  CASE WHEN seq % 2 = 0 THEN 'cors' END AS h_fetch_mode,
  CASE kind
    WHEN 'order' THEN '{{"order":{{"id":' || {_S('seq')} || ',"sku":"sku-' || {_S('k % 9')}
       || '","placed_at":"2024-01-0' || {_S('1 + seq % 9')} || '"}},"items":[{{"n":' || {_S('k % 2')}
       || '}},{{"n":2}}' || CASE WHEN seq % 17 = 0 THEN ',{{"n":3}}' ELSE '' END
       || '],"cursor":"' || substr(hex, 1, 20) || '","note":'
       || CASE WHEN seq % 29 = 0 THEN 'null' ELSE '"mail user' || {_S('u')} || '@mail.example.com"'
          END || ',"csrf_token":"' || hex || '","password":"pw' || {_S('seq')} || '"'
       || CASE WHEN seq % 31 = 0 THEN ',"extra":true' ELSE '' END || ',"fixed":"same"}}'
    WHEN 'graphql' THEN '{{"operationName":'
       || CASE WHEN seq % 3 = 0 THEN 'null' ELSE '"GetItem' || {_S('seq % 4')} || '"' END
       || ',"query":"query Item' || {_S('seq % 5')} || ' {{ item }}","variables":{{"id":' || {_S('seq')}
       || ',"after":"' || substr(hex, 1, 16) || '","opts":{{"first":10,"kind":"x"}}}}}}'
    WHEN 'profile' THEN 'name=User+' || {_S('u')} || '&plan=basic&nonce=' || substr(hex, 1, 8)
    WHEN 'login' THEN '{{"username":"u' || {_S('u')} || '","password":"pw"}}'
    WHEN 'oauth' THEN 'grant_type=' || CASE seq % 3 WHEN 0 THEN 'refresh_token'
       WHEN 1 THEN 'client_credentials' ELSE 'password' END || '&client_id=app' || {_S('u % 4')}
       || CASE WHEN seq % 2 = 0 THEN '&client_secret=x' ELSE '' END
       || CASE WHEN seq % 3 = 0 THEN '&refresh_token=r' ELSE '' END || '&scope=read%20write'
  END AS req_body,
  CASE kind
    WHEN 'product' THEN CASE WHEN ts_us >= 1705363200000000
       THEN '{{"id":' || {_S('u')} || ',"price":' || {_S('cents')}
         || ',"stock":{{"n":1,"site":"a"}},"tags":[1]}}'
       ELSE '{{"id":' || {_S('u')} || ',"name":"p' || {_S('u')} || '","price":'
         || CASE WHEN seq % 9 = 0 THEN 'null' ELSE {_S('cents')} END || ',"tags":["a","b"]}}' END
    WHEN 'items' THEN '[{{"id":0,"title":"first"}}' || repeat(',{{"id":1,"title":"more"}}',
         CAST(seq % 40 AS INT)) || ']'
    WHEN 'order' THEN '{{"ok":true,"order_id":' || {_S('seq')} || '}}'
    WHEN 'profile' THEN '{{"user":{{"email":"user' || {_S('u')} || '@mail.example.com","phone":"+1415555'
         || {_S('1000 + u % 9000')} || '"}},"ok":true}}'
    WHEN 'login' THEN '{{"ok":true}}'
    WHEN 'graphql' THEN '{{"data":{{"item":{{"id":' || {_S('seq')} || '}}}}}}'
    WHEN 'oauth' THEN '{{"access_token":"' || hex || '","expires_in":3600,"token_type":"bearer"'
         || CASE WHEN u % 2 = 0 THEN ',"refresh_token":"r"' ELSE '' END || '}}'
    ELSE 'ok' END AS resp_body,
  CASE WHEN seq % 3 <> 0 THEN 100 + k END AS r_length,
  CASE WHEN kind = 'items' AND seq % 4 = 0 THEN '<https://a/x?cursor=1>; rel="next"'
    WHEN kind = 'items' AND seq % 4 = 1 THEN '<https://a/x?page=2>; rel="next", <https://a/d>; rel="describedby"'
    END AS r_link,
  CASE WHEN kind = 'product' AND seq % 6 = 0 THEN '57' END AS r_total,
  CASE WHEN kind = 'login' THEN CASE seq % 3 WHEN 0 THEN 'sessionid=' || hex || '; Path=/'
    WHEN 1 THEN '_ga_session=1' ELSE 'theme=dark' END END AS r_set_cookie,
  CASE WHEN seq % 10 = 0 THEN hex END AS r_cf_ray,
  CASE WHEN seq % 50 = 0 THEN '30' END AS r_retry,
  seq % 13 = 0 AS body_missing
 FROM ({_EVENTS}) AS e
) AS x
"""


def exchanges_sql(dialect: dict[str, str]) -> str:
    """Flat exchanges: one column per header, which suits both engines."""
    return _fill(_EXCHANGES, dialect)


def _map_of(**cols: str) -> Column:
    items = []
    for name, sql in cols.items():
        items += [F.lit(name.replace("_", "-")), F.expr(sql)]
    return F.map_filter(F.create_map(*items), lambda _k, v: v.isNotNull())


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread_groups(table(spark, sf_dir, "events")).createOrReplaceTempView("events")
    flat = spark.sql(exchanges_sql(SPARK))
    request_headers = _map_of(
        accept="'application/json'",
        user_agent="'probe/1.0'",
        authorization="h_authorization",
        x_api_key="h_api_key",
        x_csrf_token="h_csrf",
        cookie="h_cookie",
        x_blob="h_blob",
        x_request_id="h_request_id",
        content_type="h_content_type",
        sec_fetch_mode="h_fetch_mode",
    )
    response_headers = _map_of(
        content_type="content_type",
        content_length="cast(r_length as string)",
        link="r_link",
        x_total_count="r_total",
        set_cookie="r_set_cookie",
        cf_ray="r_cf_ray",
        retry_after="r_retry",
    )
    return flat.select(
        "seq", "ts", "ts_us", "session", "request_id", "kind", "url", "method",
        request_headers.alias("request_headers"),
        F.col("req_body").alias("request_body"),
        "status", "content_type",
        response_headers.alias("response_headers"),
        F.col("resp_body").alias("response_body"),
        "body_missing",
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges in the schema of :mod:`wiretally.sources.exchanges`."""
    return landed(spark, sf_dir, "exchanges", lambda: _exchanges(spark, sf_dir))


# ------------------------------------------------------------------------------------------
# page responses and probe results
# ------------------------------------------------------------------------------------------
_PAGE_RESPONSES = f"""
SELECT page_id, url,
  CASE WHEN page_id % 10 = 7 THEN
    '<html><head><title>App ' || {_S('page_id')} || '</title></head><body><div id="root"></div>'
    || '<script src="/static/main.js"></script>' || CASE WHEN page_id % 20 = 7 THEN
       '<script id="__NEXT_DATA__">{{"buildId":"b' || {_S('page_id')} || '"}}</script>' ELSE '' END
    || '</body></html>'
  WHEN page_id % 10 = 3 THEN replace(replace(html, '<article>', '<main class="wp">'), '</article>',
      '<p>Mail me at info' || {_S('page_id')} || '@site.example.org</p></main><link href="/wp-content/a.css"><link href="/wp-json/x">')
  WHEN page_id % 10 = 5 THEN replace(html, '</article>', '</article><form method="post" action="/account/login"><input name="p" type="password"></form><div class="g-recaptcha"></div>')
  ELSE replace(replace(html, '</head>', '<meta property="og:title" content="OG ' || {_S('page_id')}
      || ' &amp; more"><meta content="article" property="og:type"><meta name="author" content="A'
      || {_S('page_id % 7')} || '"><link rel="canonical" href="https://c.example.com/'
      || {_S('page_id')} || '"></head>'), '</article>', '<h2>Facts <em>' || {_S('page_id')}
      || '</em></h2><table><tr><th>k</th><th>v</th></tr><tr><td>id</td><td>' || {_S('page_id')}
      || '</td></tr><tr><td>one</td></tr></table><ul><li>a</li><li>b &lt; c</li></ul><p>See <a href="/d/'
      || {_S('page_id')} || '">doc <b>x</b></a> <img alt="pic" src="/i/' || {_S('page_id')}
      || '.png"></p></article>') END AS html,
  CASE page_id % 13 WHEN 0 THEN 403 WHEN 1 THEN 401 WHEN 2 THEN 429 WHEN 3 THEN 503 ELSE 200 END
    AS status,
  CASE WHEN page_id % 17 = 0 THEN 'application/json' ELSE 'text/html; charset=utf-8' END
    AS content_type,
  CASE page_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'cloudflare' END AS h_server,
  CASE WHEN page_id % 9 = 0 THEN 'ray' || {_S('page_id')} END AS h_cf_ray,
  CASE WHEN page_id % 9 = 1 THEN '1' END AS h_px,
  CASE WHEN page_id % 9 = 2 THEN '1' END AS h_dd,
  CASE page_id % 5 WHEN 0 THEN 'Next.js' WHEN 1 THEN 'Express' WHEN 2 THEN 'PHP/8.1' END
    AS h_powered,
  CASE WHEN page_id % 7 = 0 THEN '<https://h/wp-json/>; rel="https://api.w.org/", <https://h/openapi.json>; rel="describedby"' END AS h_link,
  CASE WHEN page_id % 19 = 0 THEN 'canary' END AS h_shopify,
  CASE WHEN page_id % 23 = 0 THEN 'HIT' END AS h_drupal,
  CASE WHEN page_id % 13 = 1 THEN 'Basic realm="x"' END AS h_www_auth,
  CASE WHEN page_id % 21 = 0 THEN '/users/login?next=1' END AS h_location
FROM pages
"""

_PROBES = """
SELECT origin, path, pos,
  CASE (n + pos) % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 401 WHEN 3 THEN 200 WHEN 4 THEN 403
    ELSE 500 END AS status,
  CASE (n + pos) % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html'
    WHEN 2 THEN 'text/plain' ELSE 'application/xml' END AS content_type,
  CASE (n + pos) % 5 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"data":{"__schema":1}}' WHEN 2 THEN ' [1'
    ELSE '<html>' END AS body
FROM probe_targets
"""


def page_responses_sql(dialect: dict[str, str]) -> str:
    return _fill(_PAGE_RESPONSES, dialect)


def probes_sql(dialect: dict[str, str]) -> str:
    """Probe answers over a table ``probe_targets(origin, path, pos, n)``."""
    return _fill(_PROBES, dialect)


def _page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread_groups(table(spark, sf_dir, "pages")).createOrReplaceTempView("pages")
    flat = spark.sql(page_responses_sql(SPARK))
    headers = _map_of(
        content_type="content_type",
        server="h_server",
        cf_ray="h_cf_ray",
        x_px_block="h_px",
        x_datadome_cid="h_dd",
        x_powered_by="h_powered",
        link="h_link",
        x_shopify_stage="h_shopify",
        x_drupal_cache="h_drupal",
        www_authenticate="h_www_auth",
        location="h_location",
    )
    return flat.select("page_id", "url", "html", "status", headers.alias("headers"))


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html, status and response headers."""
    return landed(spark, sf_dir, "page_responses", lambda: _page_responses(spark, sf_dir))


# ------------------------------------------------------------------------------------------
# specs and directories, from suppliers
# ------------------------------------------------------------------------------------------
_SPECS = f"""
SELECT s_suppkey AS spec_id, 'https://raw.example.org/spec/' || {_S('s_suppkey')} || '.json'
    AS spec_url,
  CASE
  WHEN s_suppkey % 11 = 0 THEN '{{"version":"1.2","domain":"d","baseUrl":"u","endpoints":[]}}'
  WHEN s_suppkey % 13 = 0 THEN 'openapi: 3.0.0'
  WHEN s_suppkey % 3 = 0 THEN
    '{{"swagger":"2.0","host":"s' || {_S('s_suppkey')} || '.legacy.example.net","basePath":"/v1/","info":{{"title":"Legacy '
    || {_S('s_suppkey')} || '"}},"paths":{{"/parts":{{"get":{{"summary":"List","parameters":[{{"name":"q","in":"query","type":"string"}}],"responses":{{"200":{{"schema":{{"type":"array","items":{{"$ref":"#/definitions/Part"}}}}}}}}}},"post":{{"operationId":"createPart","parameters":[{{"name":"body","in":"body","schema":{{"$ref":"#/definitions/Part"}}}}],"responses":{{"201":{{"schema":{{"$ref":"#/definitions/Part"}}}}}}}}}}}},"definitions":{{"Part":{{"type":"object","properties":{{"id":{{"type":"integer","example":'
    || {_S('s_suppkey')} || '}},"name":{{"type":"string"}}}}}}}}}}'
  ELSE
    '{{"openapi":"3.0.' || {_S('s_suppkey % 3')} || '","info":{{"title":"Supplier ' || {_S('s_suppkey')}
    || '","x-providerName":"p' || {_S('s_nationkey')} || '.example.org"}}'
    || CASE s_suppkey % 4 WHEN 0 THEN ',"servers":[{{"url":"/rel"}}]'
       WHEN 1 THEN ',"servers":[{{"url":"https://api.n' || {_S('s_nationkey')} || '.example.org/v' || {_S('s_suppkey % 3')} || '/"}}]'
       WHEN 2 THEN ',"servers":[{{"url":"https://petstore.swagger.io/v2"}}]' ELSE '' END
    || CASE WHEN s_suppkey % 5 = 0 THEN ',"security":[{{"k":[]}}]' ELSE '' END
    || ',"paths":{{"/parts/{{partId}}":{{"parameters":[{{"name":"partId","in":"path","required":true,"schema":{{"type":"integer"}}'
    || CASE WHEN s_suppkey % 2 = 0 THEN ',"example":"' || {_S('s_suppkey')} || '"' ELSE '' END
    || '}}],"get":{{"operationId":"getPart","summary":"Read part","parameters":[{{"$ref":"#/components/parameters/Lang"}},{{"name":"view","in":"query","required":true,"schema":{{"type":"string","enum":["s","l"]}}}}],"responses":{{"200":{{"content":{{"application/json":{{"schema":{{"$ref":"#/components/schemas/Part"}}}}}}}}}}}},"delete":{{"responses":{{"204":{{"description":"gone"}}}}}}}},"/parts":{{"post":{{"operationId":"get part","requestBody":{{"content":{{"application/json":{{"schema":{{"$ref":"#/components/schemas/New"}}}}}}}},"responses":{{"201":{{"content":{{"application/json":{{"schema":{{"type":"array","items":{{"$ref":"#/components/schemas/Part"}}}}}}}}}}}}}},"get":{{"operationId":"get-part","responses":{{"default":{{"description":"x"}}}}}}}}}},"components":{{"parameters":{{"Lang":{{"name":"lang","in":"query","schema":{{"type":"string","default":"en"}}}}}},"schemas":{{"Base":{{"type":"object","properties":{{"id":{{"type":"integer","example":7}}}}}},"Part":{{"allOf":[{{"$ref":"#/components/schemas/Base"}},{{"type":"object","properties":{{"name":{{"type":"string"}}}}}}]}},"New":{{"oneOf":[{{"$ref":"#/components/schemas/Part"}},{{"type":"object"}}]}},"Loop":{{"$ref":"#/components/schemas/Loop"}}}}'
    || CASE s_suppkey % 7 WHEN 1 THEN ',"securitySchemes":{{"k":{{"type":"http","scheme":"bearer"}}}}'
       WHEN 2 THEN ',"securitySchemes":{{"a":{{"type":"apiKey"}},"k":{{"type":"oauth2"}}}}' ELSE '' END
    || '}}}}' END AS raw
FROM supplier
"""

_DIRECTORY = f"""
SELECT s_suppkey AS entry_id,
  '{{"api' || {_S('s_suppkey')} || '.example.org:main":{{"preferred":"v' || {_S('s_suppkey % 3')}
  || '","versions":{{"v0":{{"info":{{"title":"Zero ' || {_S('s_suppkey')} || '"}},"openapiVer":"2.0","updated":"2023-0'
  || {_S('1 + s_suppkey % 9')} || '-01T00:00:00Z","swaggerUrl":"https://g.example.org/' || {_S('s_suppkey')}
  || '/0.json"}},"v1":{{"info":{{"title":"One ' || {_S('s_suppkey')} || '","x-providerName":"prov'
  || {_S('s_nationkey')} || '"}},"openapiVer":"3.0.1","updated":"2024-0' || {_S('1 + s_suppkey % 9')}
  || '-02T00:00:00Z","swaggerUrl":"https://g.example.org/' || {_S('s_suppkey')} || '/1.json"}}}}}}'
  || CASE WHEN s_suppkey % 4 = 0 THEN ',"bare":{{"versions":{{}}}}' ELSE '' END || '}}' AS guru,
  '{{"apis":[{{"name":"hub' || {_S('s_suppkey')} || '"'
  || CASE WHEN s_suppkey % 3 = 0 THEN ',"description":"About ' || {_S('s_suppkey')} || '"' ELSE '' END
  || ',"properties":[{{"type":"Swagger","url":"https://api.swaggerhub.com/apis/own' || {_S('s_nationkey')}
  || '/hub/' || {_S('s_suppkey')} || '"}},{{"type":"X-Modified","value":"2024-01-0' || {_S('1 + s_suppkey % 9')}
  || '"}},{{"type":"X-Private","value":"' || CASE WHEN s_suppkey % 6 = 0 THEN 'true' ELSE 'false' END
  || '"}},{{"type":"X-OASVersion","value":"3.0.0"}}]}},{{"name":"nourl","properties":[]}}]}}' AS hub,
  '{{"items":[{{"path":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'spec/' ELSE '' END
  || 'openapi.json","html_url":"https://git.example.org/o' || {_S('s_nationkey')} || '/r'
  || {_S('s_suppkey % 40')} || '","repository":{{"name":"' || CASE s_suppkey % 3 WHEN 0 THEN 'Rest-API' WHEN 1 THEN 'openapi-x' ELSE 'site' END
  || '","full_name":"o' || {_S('s_nationkey')} || '/r' || {_S('s_suppkey % 40')} || '","owner":{{"login":"o'
  || {_S('s_nationkey')} || '"}}' || CASE WHEN s_suppkey % 4 = 1 THEN ',"default_branch":"dev"' ELSE '' END
  || ',"stargazers_count":' || {_S('s_suppkey % 17')} || ',"fork":' || CASE WHEN s_suppkey % 9 = 0 THEN 'true' ELSE 'false' END
  || ',"archived":' || CASE WHEN s_suppkey % 8 = 0 THEN 'true' ELSE 'false' END || ',"pushed_at":"20'
  || {_S('18 + s_suppkey % 7')} || '-05-01T00:00:00Z"}}}}]}}' AS listing
FROM supplier
"""


def specs_sql(dialect: dict[str, str]) -> str:
    return _fill(_SPECS, dialect)


def directory_sql(dialect: dict[str, str]) -> str:
    return _fill(_DIRECTORY, dialect)


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread_groups(table(spark, sf_dir, "supplier")).createOrReplaceTempView("supplier")
    return spark.sql(specs_sql(SPARK))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_id, spec_url, raw: one API specification document per supplier."""
    return landed(spark, sf_dir, "specs", lambda: _specs(spark, sf_dir))


def _directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread_groups(table(spark, sf_dir, "supplier")).createOrReplaceTempView("supplier")
    return spark.sql(directory_sql(SPARK))


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id and three kinds of directory documents."""
    return landed(spark, sf_dir, "directories", lambda: _directories(spark, sf_dir))

