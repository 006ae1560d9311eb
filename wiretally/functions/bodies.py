"""JSON bodies: nodes, shapes, schemas, variables and scrubbing.

One JSON text becomes an array of nodes in a single projection: the frontier of VARIANT values is
unrolled level by level inside a fold, so there is no Python, no self-join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.common import any_of, c, let
from wiretally.functions.text import scrub_pii

_AS_MAP = "map<string,variant>"
_AS_ARRAY = "array<variant>"


def parse(text: Column | str) -> Column:
    """VARIANT of a JSON text, null when it is none."""
    return F.try_parse_json(c(text))


def is_json(text: Column | str) -> Column:
    return parse(text).isNotNull()


def safe_parse_json(text: Column | str) -> Column:
    """The parsed value, or the text itself as a JSON string."""
    quoted = F.regexp_extract(F.to_json(F.struct(c(text).alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)
    return F.coalesce(parse(text), F.try_parse_json(quoted))


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", _AS_MAP)


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", _AS_ARRAY)


def variant_type(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


# One node: path as a.b[0].c, its last key, the container types above it (``chain``), its own
# type, the text of a scalar, and the length of an array. Written as one SQL expression, because
# nested lambdas are far easier to read there.
_CHILDREN = """
coalesce(
  transform(map_entries(f.m), e -> named_struct(
    'path', concat(f.path, case when f.path = '' then '' else '.' end, e.key),
    'parent', f.path, 'key', e.key, 'chain', concat(f.chain, 'o'),
    'in_array', f.in_array, 'v', e.value)),
  transform(f.a, (x, j) -> named_struct(
    'path', concat(f.path, '[', cast(j as string), ']'),
    'parent', f.path, 'key', cast(j as string), 'chain', concat(f.chain, 'a', cast(size(f.a) as string)),
    'in_array', true, 'v', x)),
  cast(array() as array<struct<path:string,parent:string,key:string,chain:string,in_array:boolean,v:variant>>))
"""
_EXPAND = """
named_struct('path', p.path, 'parent', p.parent, 'key', p.key, 'chain', p.chain,
  'in_array', p.in_array, 'v', p.v,
  'm', try_variant_get(p.v, '$', 'map<string,variant>'),
  'a', try_variant_get(p.v, '$', 'array<variant>'))
"""
_NODE = """
named_struct('path', f.path, 'parent', f.parent, 'key', f.key, 'chain', f.chain,
  'in_array', f.in_array,
  'type', case when f.m is not null then 'object' when f.a is not null then 'array'
     when schema_of_variant(f.v) = 'STRING' then 'string'
     when schema_of_variant(f.v) = 'BOOLEAN' then 'boolean'
     when schema_of_variant(f.v) = 'VOID' then 'null' else 'number' end,
  'size', size(f.a),
  'value', case when f.m is null and f.a is null then try_variant_get(f.v, '$', 'string') end)
"""


def _levels(text_sql: str) -> str:
    """SQL of a bound of a text's nesting: its opening brackets. Rounds after the last level do nothing."""
    return f"length({text_sql}) - length(translate({text_sql}, '[{{', '')) + 1"


def json_nodes(text_sql: str) -> Column:
    """All nodes below the root of a JSON text column, and the root itself with path ''. Null when
    the text is not JSON. ``text_sql`` is a column name or SQL expression."""
    return F.expr(
        f"""
    transform(array(try_parse_json({text_sql})), root -> case when root is not null then aggregate(
      sequence(1, {_levels(text_sql)}),
      transform(array(array(named_struct('path', '', 'parent', cast(null as string), 'key',
          cast(null as string), 'chain', '', 'in_array', false, 'v', root))), ps ->
        transform(array(transform(ps, p -> {_EXPAND})), front -> named_struct(
          'front', front, 'nodes', transform(front, f -> {_NODE})))[0])[0],
      (acc, i) -> case when size(acc.front) = 0 then acc else
        transform(array(transform(flatten(transform(acc.front, f -> {_CHILDREN})), p -> {_EXPAND})),
          front -> named_struct('front', front,
            'nodes', concat(acc.nodes, transform(front, f -> {_NODE}))))[0] end,
      acc -> acc.nodes) end)[0]
    """
    )


def schema_nodes(text_sql: str, max_depth: int = K.SCHEMA_MAX_DEPTH) -> Column:
    """(path, parent, chain, type) rows of a JSON text's schema: an array is sampled by its first
    element, an object at ``max_depth`` is not opened. ``chain`` lists the types above the node. Of an array only that
    element is taken out; an empty one has none."""
    children = f"""
coalesce(
  case when f.depth < {max_depth} then transform(map_entries(f.m), e -> named_struct(
    'path', concat(f.path, case when f.path = '' then '' else '.' end, e.key),
    'parent', f.path, 'key', e.key, 'chain', concat(f.chain, 'o'), 'depth', f.depth + 1,
    'v', e.value)) end,
  case when f.head is not null then array(named_struct(
    'path', concat(f.path, '[]'), 'parent', f.path, 'key', '[]', 'chain', concat(f.chain, 'a'),
    'depth', f.depth + 1, 'v', f.head)) end,
  cast(array() as array<struct<path:string,parent:string,key:string,chain:string,depth:int,v:variant>>))
"""
    expand = """
named_struct('path', p.path, 'parent', p.parent, 'key', p.key, 'chain', p.chain, 'depth', p.depth,
  'v', p.v, 'm', try_variant_get(p.v, '$', 'map<string,variant>'),
  'head', try_variant_get(p.v, '$[0]', 'variant'))
"""
    node = f"""
named_struct('path', f.path, 'parent', f.parent, 'key', f.key, 'chain', f.chain,
  'type', case when f.m is not null then 'object' when f.head is not null then 'array'
     else coalesce(try_element_at(map('STRING', 'string', 'BOOLEAN', 'boolean', 'VOID', 'null', 'ARRAY<VOID>', 'array'),
       schema_of_variant(f.v)), 'number') end,
  'open', f.m is not null and f.depth < {max_depth})
"""
    return F.expr(
        f"""
    transform(array(try_parse_json({text_sql})), root -> case when root is not null then aggregate(
      sequence(1, {_levels(text_sql)}),
      transform(array(array(named_struct('path', '', 'parent', cast(null as string), 'key',
          cast(null as string), 'chain', '', 'depth', 0, 'v', root))), ps ->
        transform(array(transform(ps, p -> {expand})), front -> named_struct(
          'front', front, 'nodes', transform(front, f -> {node})))[0])[0],
      (acc, i) -> case when size(acc.front) = 0 then acc else
        transform(array(transform(flatten(transform(acc.front, f -> {children})), p -> {expand})),
          front -> named_struct('front', front,
            'nodes', concat(acc.nodes, transform(front, f -> {node}))))[0] end,
      acc -> acc.nodes) end)[0]
    """
    )


def response_shape(text: Column | str) -> Column:
    """(type, fields): top-level keys, or the keys of an array's first element, sorted."""

    def of(v: Column) -> Column:
        kind = variant_type(v)
        first = F.get(as_array(v), F.lit(0))
        keys = F.coalesce(F.map_keys(as_object(v)), F.map_keys(as_object(first)))
        return F.struct(
            F.coalesce(kind, F.lit("unknown")).alias("type"), F.array_sort(keys).alias("fields")
        )

    return let(parse(text), of)


def response_preview(text: Column | str) -> Column:
    """First two items of an array, a whole other JSON value, or the first 500 characters."""

    def of(v: Column) -> Column:
        items = as_array(v)
        return (
            F.when(items.isNotNull(), F.to_json(F.slice(items, 1, 2)))
            .when(v.isNotNull(), F.to_json(v))
            .otherwise(F.substring(c(text), 1, 500))
        )

    return let(parse(text), of)


def is_graphql(path: Column | str, content_type: Column | str, body: Column | str) -> Column:
    query = F.try_variant_get(parse(body), "$.query", "variant")
    return (
        c(path).contains("/graphql")
        | F.coalesce(c(content_type).contains("application/graphql"), F.lit(False))
        | F.coalesce(F.schema_of_variant(query) == "STRING", F.lit(False))
    )


def graphql_body(body: Column | str) -> Column:
    """(operation_name, query, variables) of a GraphQL body; null when it has no query text."""

    def of(v: Column) -> Column:
        query = F.try_variant_get(v, "$.query", "variant")
        return F.when(
            F.schema_of_variant(query) == "STRING",
            F.struct(
                F.try_variant_get(v, "$.operationName", "string").alias("operation_name"),
                F.try_variant_get(v, "$.query", "string").alias("query"),
                F.to_json(F.try_variant_get(v, "$.variables", "variant")).alias("variables"),
            ),
        )

    return let(parse(body), of)


def graphql_operation(query: Column | str, explicit: Column | str) -> Column:
    named = F.regexp_extract(
        c(query), r"^\s*(?:query|mutation|subscription)\s+([A-Za-z0-9_]+)", 1
    )
    return F.coalesce(
        F.nullif(c(explicit), F.lit("")), F.nullif(named, F.lit("")), F.lit("Anonymous")
    )


def exchange_operation(path: Column | str, content_type: Column | str, body: Column | str) -> Column:
    """GraphQL operation of an exchange; null for plain requests. Only a body that can hold a
    query is parsed."""
    return F.when(
        c(body).contains('"query"'),
        let(
            graphql_body(body),
            lambda g: F.when(g.isNotNull(), graphql_operation(g["query"], g["operation_name"])),
        ),
    )


_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_graphql_variable(node_type: Column, value: Column) -> Column:
    """A number, or a text like a cursor or UUID."""
    cursor = (F.length(value) > 10) & value.rlike(r"^[a-zA-Z0-9+/=_-]+$")
    return (node_type == "number") | ((node_type == "string") & (cursor | value.rlike(_UUID)))


def is_dynamic_key(key: Column) -> Column:
    return key.rlike(any_of(K.DYNAMIC_KEY_PARTS))


def is_dynamic_text(value: Column) -> Column:
    return (
        value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}|$)")
        | value.rlike(r"^(?:req|id|txn|msg|evt)_[a-zA-Z0-9]+$")
        | value.rlike(_UUID)
        | ((F.length(value) > 15) & value.rlike(r"^[a-zA-Z0-9+/=_-]+$"))
        | value.rlike(r"^[0-9]{4,}$")
    )


def body_variables(nodes: Column) -> Column:
    """Paths whose value is likely to change between requests. A dynamic key takes its whole
    subtree; arrays are not entered."""

    def named(n: Column) -> Column:
        return is_dynamic_key(n["key"]) & (n["type"] != "null")

    def of(ns: Column) -> Column:
        tops = F.transform(F.filter(ns, lambda n: n["hot"]), lambda n: F.concat(n["path"], F.lit(".")))

        def pick(ts: Column) -> Column:
            hits = F.filter(
                ns,
                lambda n: (n["hot"] | n["dynamic"]) & ~F.exists(ts, lambda t: n["path"].startswith(t)),
            )
            return F.array_sort(F.array_distinct(F.transform(hits, lambda n: n["path"])))

        return let(tops, pick)

    marked = F.transform(
        F.filter(nodes, lambda n: (n["path"] != "") & ~n["in_array"]),
        lambda n: F.struct(
            n["path"].alias("path"),
            named(n).alias("hot"),
            (
                (n["type"] == "number")
                | ((n["type"] == "string") & F.coalesce(is_dynamic_text(n["value"]), F.lit(False)))
            ).alias("dynamic"),
        ),
    )
    return let(marked, of)


def graphql_variables(nodes: Column) -> Column:
    """Paths below ``variables`` of a GraphQL body that change between requests."""
    hits = F.filter(
        nodes,
        lambda n: n["path"].startswith("variables.")
        & ~n["in_array"]
        & is_graphql_variable(n["type"], n["value"]),
    )
    return F.array_sort(F.transform(hits, lambda n: n["path"]))


def refreshable_tokens(nodes: Column) -> Column:
    """Paths of CSRF-like tokens; arrays are entered, an index is a plain path step."""
    hits = F.filter(
        nodes,
        lambda n: (n["type"] == "string")
        & n["key"].rlike(K.REFRESHABLE_NAME_RE)
        & ~n["key"].rlike(K.REFRESHABLE_EXCLUDE_RE)
        & n["value"].rlike(K.REFRESHABLE_VALUE_RE),
    )
    return F.array_sort(
        F.transform(hits, lambda n: F.regexp_replace(n["path"], r"\[([0-9]+)\]", ".$1"))
    )


def extract_path(body: Column | str, path: str) -> Column:
    """Text at a dotted path, null when it is missing or not a text."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    return let(
        parse(body),
        lambda v: F.when(
            F.schema_of_variant(F.try_variant_get(v, "$" + steps, "variant")) == "STRING",
            F.try_variant_get(v, "$" + steps, "string"),
        ),
    )


def scrub_node_value(key: Column, node_type: Column, value: Column) -> Column:
    """What a scalar of a body looks like after scrubbing."""
    text = node_type == "string"
    return (
        F.when(text & F.coalesce(key.rlike(K.SENSITIVE_BODY_RE), F.lit(False)), "[scrubbed]")
        .when(text, scrub_pii(value))
        .otherwise(value)
    )


# --- rewriting a body: its text is cut at string literals, which are replaced and joined again --------
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def unquoted(literal: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(literal), "$", "string")


def quoted(value: Column) -> Column:
    """The JSON literal of a text."""
    return let(F.to_json(F.array(value)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def _scrub_literals(pieces: Column, literals: Column) -> Column:
    def name_before(i: Column) -> Column:
        return F.when(F.get(pieces, i) == ":", unquoted(F.get(literals, i - 1)))

    def scrubbed(literal: Column, i: Column) -> Column:
        is_name = F.get(pieces, i + 1).startswith(":")
        hidden = F.coalesce(name_before(i).rlike(K.SENSITIVE_BODY_RE), F.lit(False))
        value = F.when(hidden, F.lit('"[scrubbed]"')).otherwise(quoted(scrub_pii(unquoted(literal))))
        return F.concat(F.when(is_name, literal).otherwise(value), F.get(pieces, i + 1))

    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(literals, scrubbed), ""))


def scrub_json(text: Column) -> Column:
    """JSON text with the texts of sensitive fields and personal data replaced, without white space between
    its tokens; numbers and the order of fields stay as they are. Depth does not matter, nothing recurses."""
    parts = F.struct(
        F.transform(F.split(text, _LITERAL, -1), lambda p: F.regexp_replace(p, "[ \t\r\n]+", "")).alias("pieces"),
        F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0)).alias("literals"))
    return let(parts, lambda p: _scrub_literals(p["pieces"], p["literals"]))


def scrub_body(body: Column | str) -> Column:
    """A body with sensitive fields and personal data replaced. A text that is not JSON is scrubbed as plain text;
    JSON whose objects repeat a name is scrubbed both ways."""
    text = c(body)
    repeats_names = text.rlike(r"^\s*[\[{]") & F.get_json_object(text, "$").isNotNull()
    return (
        F.when(variant_type(parse(text)).isin("object", "array"), scrub_json(text))
        .when(repeats_names, scrub_pii(scrub_json(text)))
        .otherwise(scrub_pii(text))
    )


def scrub_form(body: Column | str) -> Column:
    """A form body with the values of sensitive fields and personal data replaced."""
    def field(pair: Column) -> Column:
        name = F.substring_index(pair, "=", 1)
        return F.when(name.rlike(K.SENSITIVE_BODY_RE), F.concat(name, F.lit("=[scrubbed]"))).otherwise(scrub_pii(pair))

    return F.array_join(F.transform(F.split(c(body), "&"), field), "&")


# --- size limits ---------------------------------------------------------------------------------
def _escaped_bytes(char: Column) -> Column:
    """Bytes that one character takes inside a JSON literal."""
    return (
        F.when(char.isin('"', "\\", "\n", "\r", "\t", "\b", "\f"), 2)
        .when(char < " ", 6)
        .otherwise(F.octet_length(char))
    )


def _text_prefix(value: Column, max_bytes: int) -> Column:
    """Literal of the longest begin of a text that fits with the cut mark behind it: the escaped sizes of its
    characters, summed up in one pass."""
    room = max_bytes - 2 - len(K.TRUNCATED_SUFFIX.encode())

    def add(acc: Column, char: Column) -> Column:
        total = acc["bytes"] + _escaped_bytes(char)
        return F.struct(total.alias("bytes"), (acc["kept"] + (total <= room).cast("int")).alias("kept"))

    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    kept = F.aggregate(chars, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("kept")), add, lambda acc: acc["kept"])
    return quoted(F.concat(F.substring(value, F.lit(1), kept), F.lit(K.TRUNCATED_SUFFIX)))


def _shorter_fields(v: Column, max_bytes: int) -> Column:
    """Text of an object whose long texts are cut, the longest first, until it fits or none is left. How many are
    cut follows from a running sum of what each saves."""
    def field(e: Column) -> Column:
        text = F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string"))
        whole = F.concat(quoted(e["key"]), F.lit(":"), F.to_json(e["value"]))
        short = F.concat(quoted(e["key"]), F.lit(":"), quoted(
            F.concat(F.substring(text, 1, K.STRING_CAP), F.lit(K.TRUNCATED_SUFFIX))))
        return F.struct(whole.alias("whole"), F.when(F.length(text) > K.STRING_CAP, short).alias("short"),
                        F.length(text).alias("length"))

    def rebuilt(fields: Column) -> Column:
        total = F.aggregate(fields, F.lit(1), lambda acc, f: acc + F.octet_length(f["whole"]) + 1)
        cuts = F.array_sort(F.filter(
            F.transform(fields, lambda f, i: F.struct(
                (-f["length"]).alias("length"), i.alias("at"),
                (F.octet_length(f["whole"]) - F.octet_length(f["short"])).alias("saved"))),
            lambda f: f["saved"].isNotNull()))

        def take(acc: Column, cut: Column) -> Column:
            more = acc["bytes"] > max_bytes
            return F.struct((acc["bytes"] - F.when(more, cut["saved"]).otherwise(0)).alias("bytes"),
                            F.when(more, F.array_append(acc["places"], cut["at"])).otherwise(acc["places"]).alias("places"))

        start = F.struct(total.alias("bytes"), F.array().cast("array<int>").alias("places"))
        places = F.aggregate(cuts, start, take, lambda acc: acc["places"])
        return let(places, lambda at: F.concat(F.lit("{"), F.array_join(F.transform(
            fields, lambda f, i: F.when(F.array_contains(at, i), f["short"]).otherwise(f["whole"])), ","), F.lit("}")))

    return let(F.transform(F.map_entries(as_object(v)), field), rebuilt)


def array_prefix(v: Column, max_bytes: int) -> Column:
    """JSON text of the longest prefix of an array, at least one item, that fits in
    ``max_bytes``: a running sum over the item sizes."""

    def of(items: Column) -> Column:
        # bytes of the array when it ends after an item: brackets, items and commas
        running = F.aggregate(
            items,
            F.struct(F.lit(1).cast("bigint").alias("sum"), F.lit(0).cast("int").alias("kept")),
            lambda acc, x: F.struct(
                (acc["sum"] + F.octet_length(x) + 1).cast("bigint").alias("sum"),
                F.when(acc["sum"] + F.octet_length(x) + 1 <= max_bytes, acc["kept"] + 1)
                .otherwise(acc["kept"]).cast("int").alias("kept"),
            ),
            lambda acc: acc["kept"],
        )
        kept = F.slice(items, F.lit(1), F.greatest(running, F.lit(1)))
        return F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))

    return let(F.transform(as_array(v), lambda x: F.to_json(x)), of)


def truncate_responses(
    df: DataFrame, body: str, max_bytes: int = K.DEFAULT_MAX_BYTES
) -> DataFrame:
    """Add ``data`` and ``truncated``: the JSON text cut to ``max_bytes``. An array loses items from its end; the one
    item left, or an object, has its long texts cut; a text keeps its begin. An item that is still too
    large is given up."""
    staged = (
        df.withColumn("__v", parse(body))
        .withColumn("__text", F.to_json("__v"))
        .withColumn("__kind", variant_type(F.col("__v")))
        .withColumn("truncated", F.coalesce(
            (F.octet_length("__text") > max_bytes)
            & F.col("__kind").isin("object", "array", "string"), F.lit(False)))
        .withColumn("__short", F.when(F.col("truncated") & (F.col("__kind") == "array"),
                                      array_prefix(F.col("__v"), max_bytes)))
    )
    first = F.try_variant_get("__v", "$[0]", "variant")
    item = F.when(variant_type(first) == "object",
                  F.concat(F.lit("["), _shorter_fields(first, max_bytes - 2), F.lit("]")))
    one = let(item, lambda x: F.when(F.octet_length(x) <= max_bytes, x).otherwise("[]"))
    kind = F.col("__kind")
    cut = (
        F.when((kind == "array") & (F.octet_length("__short") <= max_bytes), F.col("__short"))
        .when(kind == "array", one)
        .when(kind == "object", _shorter_fields(F.col("__v"), max_bytes))
        .otherwise(_text_prefix(F.try_variant_get("__v", "$", "string"), max_bytes))
    )
    return staged.withColumn("data", F.when(F.col("truncated"), cut).otherwise(F.col(body))).drop(
        "__v", "__text", "__kind", "__short")
