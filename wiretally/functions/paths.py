"""Path templates, endpoint ids and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions.common import c, empty_strings, let

_WORD_RE = r"^[a-z]{2,}(?:-[a-z]{2,})*$"
_KEEP = sorted(set(K.STRUCTURAL_WORDS) | set(K.RESOURCE_SLOTS))
_SINGLE = {n: s[0] for n, s in K.RESOURCE_SLOTS.items()}


def _slot_map() -> Column:
    items = []
    for noun, slots in K.RESOURCE_SLOTS.items():
        items += [F.lit(noun), F.array(*[F.lit(s) for s in slots])]
    return F.create_map(*items)


def _segment_kind(seg: Column, prev: Column) -> Column:
    """What one path segment is. Only the slot queue needs the segments before it."""
    low = F.lower(seg)
    bare = F.regexp_replace(seg, "[-_]", "")
    n = F.length(seg)
    # the words first, which are none of the other kinds, and patterns only where the length allows a match
    return (
        F.when(seg == "", "empty")
        .when(low.isin(list(K.RESOURCE_SLOTS)), "noun")
        .when(low.isin(K.STRUCTURAL_WORDS), "structural")
        .when(seg.rlike(r"^[0-9]+$"), "number")
        .when((n >= 36) & seg.rlike(K.UUID_RE), "uuid")
        .when((n >= 16) & seg.rlike(r"(?i)^[0-9a-f]{16,}$"), "hash")
        .when((n >= 8) & seg.rlike(r"[0-9]{8,}"), "slug")
        .when((n >= 12) & (F.length(bare) >= 12) & bare.rlike("[A-Za-z]") & bare.rlike("[0-9]"), "hash")
        .when(prev.isin(_KEEP) & (F.length(seg) >= 2) & ~seg.rlike(_WORD_RE), "value")
        .otherwise("word")
    )


def parameterize_path(path: Column | str) -> Column:
    """Rewrite dynamic segments to ``:name`` slots: one fold over the segments whose state is the
    text so far and the queue of slot names the last noun left behind."""

    def fold(segments: Column) -> Column:
        tokens = F.transform(
            segments,
            lambda seg, i: F.struct(
                seg.alias("seg"),
                _segment_kind(
                    seg, F.coalesce(F.lower(F.get(segments, i - 1)), F.lit(""))
                ).alias("kind"),
            ),
        )
        start = F.struct(empty_strings().alias("out"), empty_strings().alias("slots"))

        def step(acc: Column, t: Column) -> Column:
            kind, seg = t["kind"], t["seg"]
            slot = F.get(acc["slots"], F.lit(0))
            text = (
                F.when(kind.isin("empty", "noun", "structural"), seg)
                .when(kind == "uuid", F.lit(":id"))
                .when(kind == "hash", F.lit(":hash"))
                .when(kind == "slug", F.lit(":slug"))
                .when(kind == "word", F.coalesce(slot, seg))
                .otherwise(F.coalesce(slot, F.lit(":id")))
            )
            slots = (
                F.when(kind == "empty", acc["slots"])
                .when(kind == "noun", F.try_element_at(_slot_map(), F.lower(seg)))
                .when(kind.isin("number", "value", "word"),
                      F.slice(acc["slots"], 2, F.greatest(F.size(acc["slots"]), F.lit(1))))
                .otherwise(empty_strings())
            )
            return F.struct(
                F.array_append(acc["out"], text).alias("out"), slots.alias("slots")
            )

        return F.aggregate(tokens, start, step, lambda acc: F.array_join(acc["out"], "/"))

    return let(F.split(c(path), "/"), fold)


def clean_framework_path(path: Column | str) -> Column:
    p = F.regexp_replace(c(path), r"^/_next/data/[^/]+/", "/")
    return F.coalesce(F.nullif(F.regexp_replace(p, r"\.json$", ""), F.lit("")), F.lit("/"))


def normalize_path(path: Column | str) -> Column:
    return F.regexp_replace(c(path), r":[A-Za-z_][A-Za-z0-9_]*", ":_")


def _slug(path: Column) -> Column:
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith(":"))
    text = F.lower(F.regexp_replace(F.array_join(kept, "-"), "[^A-Za-z0-9-]", ""))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("root"))


def endpoint_id(method: Column | str, path: Column | str, operation: Column | None = None) -> Column:
    """Readable id of a traffic endpoint; a GraphQL operation is named by itself."""
    rest = F.concat(F.lower(c(method)), F.lit("-"), _slug(clean_framework_path(path)))
    if operation is None:
        return rest
    return F.when(
        operation.isNotNull(), F.concat(F.lower(c(method)), F.lit("-graphql-"), operation)
    ).otherwise(rest)


def path_id(method: Column | str, path: Column | str) -> Column:
    """Id of a path that no framework prefix is cut from."""
    return F.concat(F.lower(c(method)), F.lit("-"), _slug(c(path)))


def dedup_key(method: Column | str, path: Column | str, operation: Column | None = None) -> Column:
    rest = F.concat(c(method), F.lit(" "), clean_framework_path(path))
    if operation is None:
        return rest
    return F.when(
        operation.isNotNull(), F.concat(c(method), F.lit(" graphql:"), operation)
    ).otherwise(rest)


def spec_endpoint_base_id(
    method: Column | str, path: Column | str, operation_id: Column | str
) -> Column:
    """Id of a spec operation before collisions are numbered."""
    named = F.lower(F.regexp_replace(c(operation_id), "[^A-Za-z0-9]", "-"))
    body = F.when(F.coalesce(c(operation_id), F.lit("")) != "", named).otherwise(_slug(c(path)))
    base = F.regexp_replace(F.concat(F.lower(c(method)), F.lit("-"), body), "-+", "-")
    return F.substring(F.regexp_replace(base, "^-|-$", ""), 1, K.SPEC_ID_CHARS)


def path_defaults(template: Column | str, example_path: Column | str) -> Column:
    """Values of the template's slots in one example path."""
    zipped = F.arrays_zip(
        F.split(c(template), "/").alias("t"), F.split(c(example_path), "/").alias("v")
    )
    hits = F.filter(zipped, lambda z: z["t"].startswith(":") & z["v"].isNotNull())
    pairs = F.transform(
        hits, lambda z: F.struct(F.substring(z["t"], F.lit(2), F.length(z["t"])).alias("name"), z["v"].alias("value"))
    )
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, _v: k != p["name"]), F.create_map(p["name"], p["value"])
        ),
    )


def render_path(template: Column | str, params: Column) -> Column:
    """Put values into the slots, wherever they stand in a segment; an unknown slot stays as it is."""
    slot = ":([A-Za-z_]+)"
    parts = F.struct(F.split(c(template), slot, -1).alias("between"),
                     F.regexp_extract_all(c(template), F.lit(slot), F.lit(1)).alias("names"))

    def of(p: Column) -> Column:
        filled = F.transform(p["names"], lambda name, i: F.concat(
            F.coalesce(F.try_element_at(params, name), F.concat(F.lit(":"), name)), F.get(p["between"], i + 1)))
        return F.concat(F.get(p["between"], F.lit(0)), F.array_join(filled, ""))

    return let(parts, of)
