"""API specification documents to endpoints, and the directories that list them.

A document stays one row until its endpoints are ready: references are followed inside the row, by a
bounded fold over VARIANT values, so importing a directory of specs needs no shuffle. Only light
endpoint rows leave the fold. VARIANT sorts object keys, so "first" means first by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions import paths, urls
from wiretally.functions.common import let
from wiretally.operators.merge import PARAMS, param
from wiretally.session import landed

_ids = itertools.count()


# ------------------------------------------------------------------------------------------
# documents
# ------------------------------------------------------------------------------------------
def read_specs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``doc`` and ``problem``: null, ``not json`` (YAML is not parsed, it is set aside), or
    ``not a spec``."""
    doc = F.try_parse_json(raw)

    def is_text(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("doc", f"$.{name}", "variant")) == "STRING"

    has = [F.try_variant_get("doc", f"$.{n}", "variant").isNotNull() for n in ("version", "domain", "baseUrl")]
    catalog_doc = has[0] & has[1] & has[2] & F.try_variant_get("doc", "$.endpoints", "array<variant>").isNotNull()
    spec = (is_text("openapi") | is_text("swagger")) & ~catalog_doc
    out = df.withColumn("doc", doc)
    return out.withColumn(
        "problem",
        F.when(F.col("doc").isNull(), "not json").when(~F.coalesce(spec, F.lit(False)), "not a spec"),
    )


def _get(path: str, kind: str = "string", v: str = "doc") -> Column:
    return F.try_variant_get(v, path, kind)


def server_urls() -> Column:
    """Server URLs of a document with templated host labels dropped, and the Swagger host."""
    servers = F.transform(
        F.coalesce(_get("$.servers", "array<variant>"), F.array().cast("array<variant>")),
        lambda s: urls.normalize_server_url(F.try_variant_get(s, "$.url", "string")),
    )
    return F.array_compact(F.concat(F.array(_get("$.host")), servers))


def profile_specs(specs: DataFrame, url: str = "spec_url") -> DataFrame:
    """Add domain, base path, version, title, authentication, and the import gates of a document."""
    server = urls.normalize_server_url(_get("$.servers[0].url"))
    relative = server.startswith("/")
    provider = _get("$.info['x-providerName']")
    named = F.when(provider.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9._-]+$"), provider)
    swagger_host = urls.url_host(F.concat(F.lit("https://"), _get("$.host")))
    absolute = urls.url_host(server)

    def no_slash(p: Column) -> Column:
        return F.regexp_replace(F.coalesce(p, F.lit("")), "/$", "")

    schemes = F.map_values(
        F.map_zip_with(
            F.coalesce(_get("$.components.securitySchemes", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
            F.coalesce(_get("$.securityDefinitions", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
            lambda _k, a, b: F.coalesce(b, a),
        )
    )

    def scheme_kind(s: Column) -> Column:
        kind = F.try_variant_get(s, "$.type", "string")
        http = F.try_variant_get(s, "$.scheme", "string")
        return F.when((kind == "http") & http.isin("bearer", "basic"), http).when(
            kind.isin("apiKey", "oauth2", "openIdConnect"), kind
        )

    kinds = F.array_compact(F.transform(schemes, scheme_kind))
    security = F.size(F.coalesce(_get("$.security", "array<variant>"), F.array().cast("array<variant>")))
    staged = specs.withColumn("__urls", server_urls()).withColumn("__kinds", kinds)
    return staged.select(
        *specs.columns,
        F.when(absolute.isNotNull(), absolute)
        .when(relative, F.coalesce(named, urls.url_host(url)))
        .otherwise(F.coalesce(swagger_host, urls.url_host(url))).alias("domain"),
        F.when(absolute.isNotNull(), no_slash(urls.url_path(server)))
        .when(relative, no_slash(server))
        .when(swagger_host.isNotNull(), no_slash(_get("$.basePath")))
        .otherwise("").alias("base_path"),
        F.when(_get("$.swagger").isNotNull(), "swagger2").otherwise("openapi3").alias("spec_version"),
        F.coalesce(_get("$.info.title"), F.lit("")).alias("title"),
        ((F.size(schemes) > 0) | (security > 0)).alias("requires_auth"),
        F.get("__kinds", F.lit(0)).alias("auth_type"),
        (F.size("__urls") > 0).alias("has_server"),
        F.coalesce(urls.has_placeholder_host(F.col("__urls")), F.lit(False)).alias("is_placeholder"),
    )


def operation_counts(specs: DataFrame) -> DataFrame:
    """Operations per document in the counted methods."""
    items = F.map_values(F.coalesce(_get("$.paths", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    per_path = F.transform(
        items,
        lambda i: F.size(F.filter(
            F.map_keys(F.try_variant_get(i, "$", "map<string,variant>")),
            lambda m: m.isin(K.COUNTED_METHODS))),
    )
    return specs.withColumn(
        "operations",
        F.aggregate(per_path, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0))).cast("bigint"),
    )


# ------------------------------------------------------------------------------------------
# references
# ------------------------------------------------------------------------------------------
def reference_table() -> Column:
    """MAP ``#/a/b/c`` → VARIANT of everything a document lets others refer to."""
    empty = "cast(map() as map<string,variant>)"

    def group(prefix: str, path: str) -> str:
        return (
            f"transform(map_entries(coalesce(try_variant_get(doc, '{path}', 'map<string,variant>'), {empty})), "
            f"e -> struct(concat('{prefix}', e.key) as key, e.value as value))"
        )

    flat = [group(f"#/{n}/", f"$.{n}") for n in ("definitions", "parameters", "responses")]
    nested = (
        f"flatten(transform(map_entries(coalesce(try_variant_get(doc, '$.components', 'map<string,variant>'), {empty})), "
        "g -> transform(map_entries(coalesce(try_variant_get(g.value, '$', 'map<string,variant>'), "
        f"{empty})), e -> struct(concat('#/components/', g.key, '/', e.key) as key, e.value as value))))"
    )
    return F.expr(f"map_from_entries(concat({', '.join([*flat, nested])}))")


def resolve(v: str, refs: str = "refs") -> str:
    """SQL of (leaves, merged): the concrete schemas ``v`` stands for. ``allOf`` opens into all of
    its entries and counts as a merged object, ``oneOf`` and ``anyOf`` stand for their first option,
    a local reference is looked up once per chain, any other reference is dropped."""
    n = next(_ids)
    a, f, s, x = f"a{n}", f"f{n}", f"s{n}", f"x{n}"
    item = "struct<v:variant,seen:array<string>>"
    step = f"""flatten(transform({a}.front, {f} -> case
      when try_variant_get({f}.v, '$.allOf', 'array<variant>') is not null then
        transform(try_variant_get({f}.v, '$.allOf', 'array<variant>'), {x} -> named_struct('v', {x}, 'seen', {f}.seen))
      when try_variant_get({f}.v, '$.oneOf[0]', 'variant') is not null then
        array(named_struct('v', try_variant_get({f}.v, '$.oneOf[0]', 'variant'), 'seen', {f}.seen))
      when try_variant_get({f}.v, '$.anyOf[0]', 'variant') is not null then
        array(named_struct('v', try_variant_get({f}.v, '$.anyOf[0]', 'variant'), 'seen', {f}.seen))
      when try_variant_get({f}.v, "$['$ref']", 'string') is not null then
        case when map_contains_key({refs}, try_variant_get({f}.v, "$['$ref']", 'string'))
              and not array_contains({f}.seen, try_variant_get({f}.v, "$['$ref']", 'string'))
          then array(named_struct('v', {refs}[try_variant_get({f}.v, "$['$ref']", 'string')],
            'seen', array_append({f}.seen, try_variant_get({f}.v, "$['$ref']", 'string'))))
          else cast(array() as array<{item}>) end
      else array({f}) end))"""
    done = f"""not exists({a}.front, {f} -> coalesce(
        try_variant_get({f}.v, '$.allOf', 'variant'), try_variant_get({f}.v, '$.oneOf', 'variant'),
        try_variant_get({f}.v, '$.anyOf', 'variant'), try_variant_get({f}.v, "$['$ref']", 'variant')) is not null)"""
    return f"""aggregate(sequence(1, steps),
      named_struct('front', cast(filter(array(named_struct('v', {v}, 'seen', array(''))),
          {f} -> {f}.v is not null) as array<{item}>), 'merged', false, 'done', false),
      ({a}, {s}) -> case when {a}.done then {a} when {done} then named_struct(
        'front', {a}.front, 'merged', {a}.merged, 'done', true) else named_struct(
        'front', cast({step} as array<{item}>),
        'merged', {a}.merged or exists({a}.front, {f} -> try_variant_get({f}.v, '$.allOf', 'array<variant>') is not null),
        'done', false) end,
      {a} -> named_struct('leaves', transform(filter({a}.front, {f} -> try_variant_get({f}.v, "$['$ref']", 'string') is null),
        {f} -> {f}.v), 'merged', {a}.merged))"""


def _bind(value: str, body: str, name: str) -> str:
    """SQL let: ``body`` may use ``name`` many times, ``value`` is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _keys(leaves: str) -> str:
    return (
        f"array_distinct(flatten(transform({leaves}, lf -> coalesce(map_keys(try_variant_get(lf, "
        "'$.properties', 'map<string,variant>')), cast(array() as array<string>)))))"
    )


def _params(op: str) -> str:
    """Array of resolved parameters of an operation, path-level ones first."""
    schema = _bind(
        resolve("try_variant_get(r, '$.schema', 'variant')"),
        "case when try_variant_get(r, '$.schema', 'variant') is null then r "
        "when sc.merged then parse_json('{\"type\":\"object\"}') "
        "else coalesce(get(sc.leaves, 0), try_variant_get(r, '$.schema', 'variant')) end", "sc")
    fields = """named_struct('name', try_variant_get(r, '$.name', 'string'), 'place', try_variant_get(r, '$.in', 'string'),
      'required', try_variant_get(r, '$.required', 'boolean'),
      'type', coalesce(try_variant_get(ps, '$.type', 'string'), 'string'),
      'example', coalesce(try_variant_get(r, '$.example', 'string'), try_variant_get(ps, '$.example', 'string'),
         try_variant_get(ps, '$.default', 'string')),
      'enum', try_variant_get(ps, '$.enum', 'array<string>'),
      'schema', try_variant_get(r, '$.schema', 'variant'))"""
    one = _bind(_bind(resolve("p"), "coalesce(get(rs.leaves, 0), p)", "rs"), _bind(schema, fields, "ps"), "r")
    return f"""transform(concat(
      coalesce(try_variant_get({op}.item, '$.parameters', 'array<variant>'), cast(array() as array<variant>)),
      coalesce(try_variant_get({op}.op, '$.parameters', 'array<variant>'), cast(array() as array<variant>))),
      p -> {one})"""


def _response(op: str) -> str:
    """(type, fields) of the success response's JSON schema."""
    pick = (
        "coalesce(rm['200'], rm['201'], rm[get(filter(map_keys(rm), k -> k like '2%'), 0)])"
    )
    chosen = _bind(
        f"coalesce(try_variant_get({op}.op, '$.responses', 'map<string,variant>'), cast(map() as map<string,variant>))",
        pick, "rm")
    schema = _bind(
        resolve(chosen),
        "coalesce(try_variant_get(get(ro.leaves, 0), \"$.content['application/json'].schema\", 'variant'), "
        "try_variant_get(get(ro.leaves, 0), '$.schema', 'variant'))", "ro")
    items = _bind(
        resolve("try_variant_get(get(rs.leaves, 0), '$.items', 'variant')"), _keys("it.leaves"), "it")
    shape = f"""named_struct(
      'type', case when rs.merged then 'object' when size(rs.leaves) = 0 then 'unknown'
        else coalesce(try_variant_get(get(rs.leaves, 0), '$.type', 'string'), 'unknown') end,
      'fields', case when size({_keys('rs.leaves')}) > 0 then array_sort({_keys('rs.leaves')})
        when not rs.merged and try_variant_get(get(rs.leaves, 0), '$.type', 'string') = 'array' then array_sort({items}) end)"""
    return _bind(resolve(schema), shape, "rs")


def _body(op: str) -> str:
    """(content_type, template, variables) of a write operation's body: examples, defaults, or
    ``{{name}}`` for a variable."""
    content = "coalesce(try_variant_get(get(rb.leaves, 0), '$.content', 'map<string,variant>'), cast(map() as map<string,variant>))"
    from_body = _bind(
        resolve(f"try_variant_get({op}.op, '$.requestBody', 'variant')"),
        _bind(content, """case when try_variant_get(cm['application/json'], '$.schema', 'variant') is not null
            then named_struct('ct', 'application/json', 'schema', try_variant_get(cm['application/json'], '$.schema', 'variant'))
            else named_struct('ct', get(map_keys(cm), 0), 'schema', try_variant_get(get(map_values(cm), 0), '$.schema', 'variant')) end""", "cm"),
        "rb")
    from_param = f"""named_struct('ct', 'application/json', 'schema',
      get(filter({op}.params, q -> q.place = 'body'), 0).schema)"""
    value = _bind(
        resolve("pe.value"),
        "named_struct('key', pe.key, 'value', coalesce(try_variant_get(get(pv.leaves, 0), '$.example', 'string'), "
        "try_variant_get(get(pv.leaves, 0), '$.default', 'string')))", "pv")
    props = """flatten(transform(bs.leaves, lf -> map_entries(coalesce(
      try_variant_get(lf, '$.properties', 'map<string,variant>'), cast(map() as map<string,variant>)))))"""
    template = _bind(
        f"transform({props}, pe -> {value})",
        """named_struct('content_type', src.ct,
          'template', map_from_entries(transform(array_distinct(transform(vs, x -> x.key)), k ->
             named_struct('key', k, 'value', coalesce(element_at(filter(vs, x -> x.key = k), -1).value, concat('{{', k, '}}'))))),
          'variables', array_sort(array_distinct(transform(filter(vs, x -> x.value is null), x -> x.key))))""", "vs")
    return _bind(
        f"case when {from_body}.schema is not null then {from_body} else {from_param} end",
        f"case when src.schema is not null then {_bind(resolve('src.schema'), f'case when size(bs.leaves) > 0 or bs.merged then {template} end', 'bs')} end", "src")


def spec_operations(profiled: DataFrame) -> DataFrame:
    """Endpoints of profiled documents: one row per path and method. Columns are those the catalog merge takes; a cap
    per domain is the merge's business."""
    methods = ", ".join(f"'{m}'" for m in K.HTTP_METHODS)
    ops = f"""flatten(transform(map_entries(coalesce(try_variant_get(doc, '$.paths', 'map<string,variant>'),
        cast(map() as map<string,variant>))), e -> transform(
        filter(array({methods}), m -> try_variant_get(try_variant_get(e.value, '$', 'map<string,variant>')[m], '$', 'map<string,variant>') is not null),
        m -> named_struct('key', e.key, 'method', m, 'item', e.value,
          'op', try_variant_get(e.value, '$', 'map<string,variant>')[m]))))"""
    with_params = f"transform({ops}, o -> named_struct('key', o.key, 'method', o.method, 'op', o.op, 'params', {_params('o')}))"
    light = f"""transform(ops, o -> named_struct('key', o.key, 'method', upper(o.method),
        'operation_id', try_variant_get(o.op, '$.operationId', 'string'),
        'description', coalesce(nullif(try_variant_get(o.op, '$.summary', 'string'), ''), nullif(try_variant_get(o.op, '$.description', 'string'), '')),
        'params', transform(o.params, p -> named_struct('name', p.name, 'place', p.place, 'required', p.required,
           'type', p.type, 'example', p.example, 'enum', p.enum)),
        'response', {_response('o')},
        'body', case when o.method in ('post', 'put', 'patch') then {_body('o')} end))"""
    staged = (
        profiled.withColumn("refs", reference_table())
        # a chain follows each reference once and opens each composition of the document at most once
        .withColumn("steps", F.expr("size(refs) + regexp_count(to_json(doc), '(all|one|any)Of\"') + 2"))
        .withColumn("ops", F.expr(with_params))
        .withColumn("ops", F.expr(light))
        .select("spec_id", "spec_url", "domain", "base_path", "spec_version", "requires_auth",
                # outer: Spark tests an array that it explodes below, by working it out once more for each test
                F.posexplode_outer("ops").alias("pos", "o"))
        .filter("o is not null")
    )
    return _finish(staged)


def _finish(o: DataFrame) -> DataFrame:
    query = F.filter("o.params", lambda p: p["place"] == "query")
    path_params = F.filter("o.params", lambda p: (p["place"] == "path") & p["example"].isNotNull())
    has_examples = (F.size(path_params) > 0) | F.exists(
        query, lambda p: F.coalesce(p["example"], F.lit("")) != ""
    )
    example_path = F.aggregate(
        path_params,
        F.concat("base_path", "o.key"),
        lambda acc, p: F.replace(acc, F.concat(F.lit("{"), p["name"], F.lit("}")), p["example"]),
        lambda acc: F.regexp_replace(acc, r"\{([^}]+)\}", ":$1"),
    )

    def encode(x: Column) -> Column:
        return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))

    sent = F.filter(query, lambda p: F.coalesce(p["example"], F.lit("")) != "")
    qs = F.array_join(
        F.transform(sent, lambda p: F.concat(encode(p["name"]), F.lit("="), encode(p["example"]))), "&"
    )
    confidence = F.least(
        F.lit(0.6)
        + F.when(has_examples, 0.1).otherwise(0.0)
        + F.when(F.col("requires_auth"), 0.0).otherwise(0.1)
        + F.when(F.col("o.method") == "GET", 0.05).otherwise(0.0),
        F.lit(0.85),
    )
    params = F.map_from_entries(
        F.transform(
            let(query, lambda q: F.filter(q, lambda p, i: ~F.exists(
                F.slice(q, i + 2, F.greatest(F.size(q), F.lit(1))), lambda z: z["name"] == p["name"]))),
            lambda p: F.struct(
                p["name"].alias("key"),
                param(p["type"], F.coalesce(p["example"], F.lit("")), F.when(p["required"], True),
                      p["enum"], F.lit(True)).alias("value")),
        )
    ).cast(PARAMS)
    path = F.concat("base_path", F.regexp_replace("o.key", r"\{([^}]+)\}", ":$1"))
    rows = o.select(
        "spec_id", "spec_url", "domain", "spec_version", "pos",
        F.col("o.method").alias("method"),
        path.alias("path"),
        paths.spec_endpoint_base_id("o.method", path, "o.operation_id").alias("base_id"),
        params.alias("query_params"),
        F.concat(F.lit("https://"), "domain", example_path,
                 F.when(qs != "", F.concat(F.lit("?"), qs)).otherwise("")).alias("example_url"),
        F.col("o.response.type").alias("response_type"),
        F.col("o.response.fields").alias("response_fields"),
        F.col("o.body").alias("request_body"),
        F.round(confidence, 2).alias("confidence"),
        F.lit("openapi-import").alias("provenance"),
        F.col("spec_url").alias("spec_source"),
        F.col("o.description").alias("description"),
    )
    return number_ids(rows)


def free_ids(bases: list[str], size: int = K.SPEC_ID_CHARS) -> list[str]:
    """Ids of a document's operations in their order: a base that is taken gets the least number from 2 on that is
    free. The base is shortened before the number, so that a long one keeps it."""
    seen: set[str] = set()
    tried: dict[str, int] = {}
    out = []
    for base in bases:
        name, n = base, tried.get(base, 1)
        while name in seen:
            n += 1
            name = f"{base[:size - len(str(n)) - 1]}-{n}"
        tried[base] = n
        seen.add(name)
        out.append(name)
    return out


def number_ids(rows: DataFrame) -> DataFrame:
    """Rows with their ``id``. Whether an id is free depends on all ids before it, which no built-in function can say;
    only the documents' lists of base ids go through the helper, and a document was one row a moment ago."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("ids").to_pylist()
            ids = [free_ids([x["base_id"] for x in ids]) for ids in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, ids in zip(part.column("spec_id").to_pylist(), lists, strict=True) for _ in ids], pa.int64()),
                 pa.array([x["pos"] for ids in lists for x in ids], pa.int32()),
                 pa.array([x for y in ids for x in y], pa.string())], names=["id_spec", "id_pos", "id"])

    rows = landed(rows, "spec-operations")  # resolved once, read twice
    lists = rows.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "base_id"))).alias("ids"))
    ids = lists.select(F.col("spec_id").cast("bigint"), "ids").mapInArrow(run, "id_spec bigint, id_pos int, id string")
    return rows.join(ids, (F.col("spec_id") == F.col("id_spec")) & (F.col("pos") == F.col("id_pos"))).drop(
        "base_id", "id_spec", "id_pos")


def import_gates(profiled: DataFrame, no_auth_only: bool = False) -> DataFrame:
    """Documents with an ``outcome``: fail, skip with its reason, or import."""
    counted = operation_counts(profiled)
    outcome = (
        F.when(F.col("problem").isNotNull(), F.concat(F.lit("fail: "), "problem"))
        .when(F.col("operations") == 0, "skip: no endpoints")
        .when(F.lit(no_auth_only) & F.col("requires_auth"), "skip: requires auth")
        .when(F.col("is_placeholder"), "skip: placeholder host")
        .when(~urls.is_safe_url(F.concat(F.lit("https://"), "domain")), "skip: unsafe host")
        .otherwise("import")
    )
    return counted.withColumn("outcome", outcome)


def import_summary(gated: DataFrame, added: DataFrame) -> DataFrame:
    """One row: imported, failed, skipped, endpoints added."""
    names = ["imported", "failed", "skipped", "endpoints_added"]
    counts = gated.agg(
        F.count_if(F.col("outcome") == "import").alias("imported"),
        F.count_if(F.col("outcome").startswith("fail")).alias("failed"),
        F.count_if(F.col("outcome").startswith("skip")).alias("skipped"),
    ).withColumn("endpoints_added", F.lit(0).cast("bigint"))
    endpoints = added.agg(F.count("*").alias("endpoints_added")).select(
        *[F.lit(0).cast("bigint").alias(n) for n in names[:3]], "endpoints_added"
    )
    return counts.unionByName(endpoints).agg(*[F.sum(n).alias(n) for n in names])


# ------------------------------------------------------------------------------------------
# directories
# ------------------------------------------------------------------------------------------
DIRECTORY_COLUMNS = ["source", "provider", "title", "spec_url", "openapi_ver", "updated"]


def guru_entries(docs: DataFrame, raw: str = "guru") -> DataFrame:
    """Preferred version of each API of a directory document. Entries without one, or without a URL,
    are dropped."""
    schema = (
        "map<string,struct<preferred:string,versions:map<string,struct<swaggerUrl:string,"
        "openapiVer:string,updated:string,info:struct<title:string,`x-providerName`:string>>>>>"
    )
    apis = docs.select(F.explode(F.from_json(raw, schema)).alias("api_id", "api")).select(
        "api_id", F.try_element_at("api.versions", F.col("api.preferred")).alias("v")
    )
    return apis.filter(F.coalesce("v.swaggerUrl", F.lit("")) != "").select(
        F.lit("guru").alias("source"),
        F.coalesce(F.nullif("v.info.x-providerName", F.lit("")),
                   F.substring_index("api_id", ":", 1)).alias("provider"),
        F.coalesce("v.info.title", F.lit("")).alias("title"),
        F.col("v.swaggerUrl").alias("spec_url"),
        F.coalesce("v.openapiVer", F.lit("")).alias("openapi_ver"),
        F.coalesce("v.updated", F.lit("")).alias("updated"),
    )


def hub_entries(docs: DataFrame, raw: str = "hub") -> DataFrame:
    """APIs of a hub listing, whose properties are type/value pairs. Private ones and ones without a
    URL are dropped."""
    schema = (
        "struct<apis:array<struct<name:string,description:string,"
        "properties:array<struct<type:string,value:string,url:string>>>>>"
    )
    apis = docs.select(F.explode(F.from_json(raw, schema)["apis"]).alias("a"))

    def prop(name: str) -> Column:
        hits = F.filter("a.properties", lambda p: p["type"] == name)
        last = F.try_element_at(hits, F.lit(-1))
        return F.coalesce(last["value"], last["url"])

    url = prop("Swagger")
    return apis.filter((F.coalesce(url, F.lit("")) != "") & ~prop("X-Private").eqNullSafe("true")).select(
        F.lit("hub").alias("source"),
        F.substring_index(F.regexp_replace(url, r"^https://api\.swaggerhub\.com/apis/", ""), "/", 1).alias("provider"),
        F.coalesce("a.description", "a.name", F.lit("")).alias("title"),
        url.alias("spec_url"),
        F.coalesce(prop("X-OASVersion"), prop("X-Specification"), F.lit("")).alias("openapi_ver"),
        F.coalesce(prop("X-Modified"), prop("X-Created"), F.lit("")).alias("updated"),
    )


def listing_entries(docs: DataFrame, raw: str = "listing") -> DataFrame:
    """Code search items as repository spec rows."""
    schema = (
        "struct<items:array<struct<path:string,html_url:string,repository:struct<name:string,"
        "full_name:string,owner:struct<login:string>,default_branch:string,stargazers_count:bigint,"
        "fork:boolean,archived:boolean,pushed_at:string,description:string>>>>"
    )
    items = docs.select(F.explode(F.from_json(raw, schema)["items"]).alias("i"))
    r = "i.repository"
    return items.select(
        F.col(f"{r}.owner.login").alias("owner"), F.col(f"{r}.name").alias("repo"),
        F.col(f"{r}.full_name").alias("full_name"), F.col("i.path").alias("file_path"),
        F.col("i.html_url").alias("html_url"),
        F.concat(F.lit("https://raw.githubusercontent.com/"), f"{r}.full_name", F.lit("/"),
                 F.coalesce(f"{r}.default_branch", F.lit("main")), F.lit("/"), "i.path").alias("spec_url"),
        F.coalesce(f"{r}.stargazers_count", F.lit(0)).alias("stars"),
        F.coalesce(f"{r}.fork", F.lit(False)).alias("is_fork"),
        F.coalesce(f"{r}.archived", F.lit(False)).alias("is_archived"),
        F.coalesce(f"{r}.pushed_at", F.lit("")).alias("pushed_at"),
    )


def distinct_listings(*sources: DataFrame) -> DataFrame:
    """Union of discovery sources, one row per web URL; an earlier source wins."""
    all_rows = None
    for rank, df in enumerate(sources):
        part = df.withColumn("rank", F.lit(rank))
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    rest = [c for c in all_rows.columns if c != "html_url"]
    best = all_rows.groupBy("html_url").agg(
        F.min_by(F.struct(*rest), F.struct("rank", "spec_url")).alias("x"))
    return best.select("html_url", "x.*").drop("rank")


def unseen_repos(repos: DataFrame, seen: DataFrame) -> DataFrame:
    """Repositories with a spec-like name that no earlier source listed."""
    named = repos.filter(F.col("repo").rlike(K.SPEC_REPO_RE))
    return named.join(seen.select("full_name").distinct(), "full_name", "left_anti")


def is_spec_filename(path: str = "file_path") -> Column:
    return F.substring_index(path, "/", -1).isin(K.SPEC_FILENAMES)


def filter_repos(repos: DataFrame, as_of: Column, min_stars: int | None = None,
                 include_stale: bool = False) -> DataFrame:
    """Add ``skip``: fork, archived, stale or too few stars, in this order; null passes."""
    # the UTC date as written, whatever the session's time zone is
    pushed = F.substring("pushed_at", 1, 10).try_cast("date")
    stale = F.lit(not include_stale) & (F.datediff(as_of, pushed) > K.STALE_REPO_DAYS)
    few = F.lit(min_stars is not None) & (F.col("stars") < F.lit(min_stars or 0))
    return repos.withColumn(
        "skip",
        F.when(F.col("is_fork"), "fork")
        .when(F.col("is_archived"), "archived")
        .when(stale, F.concat(F.lit("stale, last push "), F.date_format(pushed, "yyyy-MM-dd")))
        .when(few, F.concat(F.col("stars").cast("string"), F.lit(f" stars, below --min-stars {min_stars}"))),
    )


def top_repos(repos: DataFrame, limit: int) -> DataFrame:
    """Most stars first, then the shallowest file: a distributed top-k."""
    return repos.orderBy(F.col("stars").desc(), F.size(F.split("file_path", "/")), "html_url").limit(limit)


def search_directory(entries: DataFrame, term: str | None = None, prefer_3: bool = False,
                     limit: int | None = None) -> DataFrame:
    """Entries whose provider or title contains a term, newest first, optionally 3.x before others."""
    out = entries
    if term:
        low = term.lower()
        out = out.filter(F.lower("provider").contains(low) | F.lower("title").contains(low))
    order = [F.col("updated").desc(), F.col("spec_url")]
    if prefer_3:
        order = [F.when(F.col("openapi_ver").startswith("3"), 0).otherwise(1), *order]
    return out.orderBy(*order).limit(limit) if limit else out


def curated_specs(df: DataFrame, query: str | None = None) -> DataFrame:
    """Curated (provider, repo, specPath, specUrl, notes) rows, filtered by provider."""
    rows = df.select("provider", "repo", F.col("specPath").alias("spec_path"),
                     F.col("specUrl").alias("spec_url"), "notes")
    return rows.filter(F.lower("provider").contains(query.lower())) if query else rows
