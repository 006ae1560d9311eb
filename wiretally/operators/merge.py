"""Merge imported spec endpoints into a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions import paths

PARAM = "struct<type:string,example:string,required:boolean,enum:array<string>,from_spec:boolean>"
PARAMS = f"map<string,{PARAM}>"


def param(type_: Column, example: Column, required: Column | None = None,
          enum: Column | None = None, from_spec: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        type_.alias("type"), example.alias("example"),
        (required if required is not None else none).cast("boolean").alias("required"),
        (enum if enum is not None else none).cast("array<string>").alias("enum"),
        (from_spec if from_spec is not None else none).cast("boolean").alias("from_spec"),
    )


def plain_params(examples: Column | str) -> Column:
    """MAP name → example of traffic as full parameters."""
    m = F.col(examples) if isinstance(examples, str) else examples
    return F.transform_values(m, lambda _k, v: param(F.lit("string"), v)).cast(PARAMS)


def merge_params(captured: Column, spec: Column) -> Column:
    """Captured examples stay; a spec adds enum, required, a sharper type, and new parameters."""

    def one(_name: Column, e: Column, i: Column) -> Column:
        both = param(
            F.when((e["type"] == "string") & (i["type"] != "string"), i["type"]).otherwise(e["type"]),
            e["example"],
            F.coalesce(i["required"], e["required"]),
            F.coalesce(i["enum"], e["enum"]),
            F.when(i["from_spec"], F.lit(True)).otherwise(e["from_spec"]),
        )
        return F.when(i.isNull(), e).when(e.isNull(), i).otherwise(both)

    return F.map_zip_with(captured, spec, one)


def _adds_params(captured: Column, spec: Column) -> Column:
    def one(_name: Column, e: Column, i: Column) -> Column:
        return i.isNotNull() & (
            e.isNull()
            | (e["enum"].isNull() & i["enum"].isNotNull())
            | (e["required"].isNull() & i["required"].isNotNull())
            | ((e["type"] == "string") & (i["type"] != "string"))
        )

    return F.exists(F.map_values(F.map_zip_with(captured, spec, one)), lambda x: F.coalesce(x, F.lit(False)))


def _last(df: DataFrame) -> DataFrame:
    """One row per (domain, method, normalised path): the last one wins."""
    keyed = df.withColumn("match_path", paths.normalize_path("path")).withColumn(
        "match_method", F.upper("method")
    )
    keys = ["domain", "match_method", "match_path"]
    rest = [c for c in keyed.columns if c not in keys]
    return keyed.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[c for c in ("spec_id", "pos", "spec_source", "path") if c in rest])).alias("x")
    ).select(*keys, "x.*")


def merge_catalog(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Full outer merge on (domain, METHOD, normalised path) with an ``action`` per endpoint:
    preserved, enriched, skipped or added. The key is unique on both sides, so no key is hot.

    Both inputs: domain, method, path, pos, query_params, response_type, response_fields,
    confidence, provenance, spec_source, description.
    """
    names = ["method", "path", "pos", "query_params", "response_type", "response_fields",
             "confidence", "provenance", "spec_source", "description"]
    keys = ["domain", "match_method", "match_path"]

    def side(df: DataFrame, mark: str) -> DataFrame:
        return _last(df).select(*keys, *[F.col(n).alias(f"{mark}_{n}") for n in names])

    j = side(existing, "e").join(side(imported, "i"), keys, "full_outer")
    e = {n: F.col(f"e_{n}") for n in names}
    i = {n: F.col(f"i_{n}") for n in names}

    def text(x: Column) -> Column:
        return F.nullif(x, F.lit(""))

    only_e, only_i = F.col("i_method").isNull(), F.col("e_method").isNull()
    skeleton = F.coalesce(e["provenance"] == "skeleton", F.lit(False))
    takes_shape = (
        skeleton
        & (e["response_type"] == "unknown")
        & e["response_fields"].isNull()
        & (i["response_type"] != "unknown")
    )
    adds = (
        takes_shape
        | (text(e["description"]).isNull() & text(i["description"]).isNotNull())
        | (text(e["spec_source"]).isNull() & text(i["spec_source"]).isNotNull())
        | _adds_params(e["query_params"], i["query_params"])
    )
    any_spec = F.coalesce(
        text(e["spec_source"]), text(e["description"]), text(i["spec_source"]), text(i["description"])
    ).isNotNull()
    action = (
        F.when(only_i, "added")
        .when(only_e, "preserved")
        .when(adds, "enriched")
        .when(any_spec, "skipped")
        .otherwise("preserved")
    )
    staged = j.withColumn("action", action).withColumn("takes_shape", F.coalesce(takes_shape, F.lit(False)))
    rich, added = F.col("action") == "enriched", F.col("action") == "added"
    best = F.nullif(
        F.greatest(F.coalesce(e["confidence"], F.lit(0.0)), F.coalesce(i["confidence"], F.lit(0.0))),
        F.lit(0.0),
    )
    shape = F.col("takes_shape") & rich

    def pick(name: str, merged: Column) -> Column:
        return F.when(added, i[name]).when(rich, merged).otherwise(e[name]).alias(name)

    return staged.select(
        "domain",
        F.coalesce(e["method"], i["method"]).alias("method"),
        F.coalesce(e["path"], i["path"]).alias("path"),
        F.col("match_path").alias("normalized_path"),
        "action",
        pick("query_params", merge_params(e["query_params"], i["query_params"])),
        pick("response_type", F.when(shape, i["response_type"]).otherwise(e["response_type"])),
        pick("response_fields", F.when(shape, i["response_fields"]).otherwise(e["response_fields"])),
        pick("confidence", F.coalesce(best, e["confidence"])),
        pick("provenance", e["provenance"]),
        pick("spec_source", F.coalesce(text(e["spec_source"]), i["spec_source"])),
        pick("description", F.coalesce(text(e["description"]), i["description"])),
        # existing endpoints keep their place, added ones follow
        F.coalesce(e["pos"], i["pos"] + F.lit(1_000_000_000_000_000_000)).alias("pos"),
    )


def cap_endpoints(df: DataFrame, limit: int = K.MAX_ENDPOINTS_PER_DOMAIN) -> DataFrame:
    """At most ``limit`` endpoints per domain: captured ones first, then by confidence. Spark keeps
    only each task's best rows before the shuffle, so a hot domain stays small."""
    captured = F.coalesce(F.col("provenance") == "captured", F.lit(True))
    w = Window.partitionBy("domain").orderBy(
        F.when(captured, 0).otherwise(1), F.coalesce("confidence", F.lit(0.0)).desc(), "pos"
    )
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("place")


def merge_counts(merged: DataFrame) -> DataFrame:
    """Per domain: how many endpoints were preserved, added, enriched and skipped."""
    return merged.groupBy("domain").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("preserved", "added", "enriched", "skipped")]
    )


def import_history(counts: DataFrame, spec_url: Column, spec_version: Column, at_us: Column) -> DataFrame:
    """The history rows one import appends."""
    return counts.select(
        "domain", spec_url.alias("spec_url"), spec_version.alias("spec_version"),
        at_us.alias("imported_us"), F.col("added").alias("endpoints_added"),
        F.col("enriched").alias("endpoints_enriched"),
    )


def last_import(history: DataFrame) -> DataFrame:
    return history.groupBy("domain").agg(
        F.max("imported_us").alias("imported_us"),
        F.max_by("spec_url", "imported_us").alias("spec_url"),
    )


def up_to_date(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Directory entries with a skip reason. ``entries``: (domain, spec_url, updated_us); any earlier
    import of the same URL that is not older than the source makes it up to date."""
    newest = history.groupBy("domain", "spec_url").agg(F.max("imported_us").alias("imported_us"))
    return entries.join(newest, ["domain", "spec_url"], "left").withColumn(
        "skip", F.when(F.col("imported_us") >= F.col("updated_us"), "up to date")
    )
