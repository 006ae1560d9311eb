"""Response schemas and their drift from the catalog's baseline.

Two forms. ``schema_drift`` keeps the distinct schemas of an endpoint apart, with a digest for each: right for endpoints
that answer in a few shapes. ``drift_totals`` keeps one mergeable row per path and type instead, so its state is
bounded by the paths that occur, whatever their combinations; keys that look like ids count as one path.
Either way a hot endpoint with a third of all traffic sends a handful of rows, not its responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions import bodies
from wiretally.functions.common import let
from wiretally.session import reliable


def schema_rows(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """(keys, path, type) rows of a JSON column."""
    nodes = df.select(*keys, F.explode(bodies.schema_nodes(body)).alias("n"))
    return nodes.select(*keys, "n.*")


def schema_versions(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """Distinct schemas per key with how often and when they were seen. ``version`` is a digest of
    the schema."""
    # a generator drops rows without a schema and evaluates the schema once
    known = F.filter(F.array(bodies.schema_nodes(body)), lambda n: n.isNotNull())
    rows = df.select(*keys, "ts_us", F.explode(known).alias("nodes"))
    return (
        rows.groupBy(*keys, "nodes")
        .agg(F.count("*").alias("responses"), F.min("ts_us").alias("first_us"),
             F.max("ts_us").alias("last_us"))
        .withColumn("version", F.sha2(F.to_json("nodes"), 256))
    )


def schema_diff(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """error: a field disappeared; info: a new field; warn: a type changed. Nothing is reported below
    a change: a node is compared only when the container types above it (``chain``) agree.

    Both inputs: (keys, path, parent, key, chain, type, open).
    """
    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(
            *keys, "path", *[F.col(c).alias(f"{mark}_{c}") for c in ("parent", "key", "chain", "type")]
        )

    def opened(df: DataFrame, mark: str) -> DataFrame:
        return df.filter((F.col("type") == "object") & F.col("open")).select(
            *keys, F.col("path").alias("parent"), F.concat("chain", F.lit("o")).alias("chain"),
            F.lit(True).alias(mark),
        )

    both = side(expected, "e").join(side(actual, "a"), [*keys, "path"], "full_outer")
    changed = both.filter(
        (F.col("e_chain") == F.col("a_chain")) & (F.col("e_type") != F.col("a_type"))
    ).select(
        *keys, "path", F.lit("warn").alias("severity"),
        F.concat(
            F.lit("type changed: "), "e_type", F.lit(" → "), "a_type",
            F.when(F.col("a_type") == "null", " (became nullable)").otherwise(""),
        ).alias("message"),
    )

    def missing(mine: str, other: DataFrame, severity: str, message) -> DataFrame:
        rows = both.filter(
            F.col("a_type" if mine == "e" else "e_type").isNull() & (F.col(f"{mine}_key") != "[]")
        ).select(
            *keys, "path", F.col(f"{mine}_parent").alias("parent"), F.col(f"{mine}_chain").alias("chain"),
            F.col(f"{mine}_key").alias("key"), F.col(f"{mine}_type").alias("type"),
        )
        return rows.join(opened(other, "known"), [*keys, "parent", "chain"]).select(
            *keys, "path", F.lit(severity).alias("severity"), message.alias("message")
        )

    gone = missing("e", actual, "error",
                   F.concat(F.lit("field disappeared: "), "key", F.lit(" was "), "type"))
    new = missing("a", expected, "info",
                  F.concat(F.lit("new field: "), "key", F.lit(" ("), "type", F.lit(")")))
    return changed.unionByName(gone).unionByName(new)


def schema_drift(baseline: DataFrame, responses: DataFrame) -> DataFrame:
    """Drift rows of landed responses against the catalog's baseline.

    ``baseline``: (domain, key, response_schema), ``responses``: (domain, key, ts_us, response_body).
    """
    # a few rows per endpoint, used three times below
    versions = reliable(schema_versions(responses, "response_body", "domain", "key"))
    keys = ("domain", "key", "version")
    actual = versions.select(*keys, F.explode("nodes").alias("n")).select(*keys, "n.*")
    base = baseline.select("domain", F.col("key"), F.col("response_schema").alias("nodes"))
    expected = (
        versions.select(*keys)
        .join(base.filter(F.col("nodes").isNotNull()), ["domain", "key"])
        .select(*keys, F.explode("nodes").alias("n"))
        .select(*keys, "n.*")
    )
    renamed = [
        d.toDF(*keys, "path", "parent", "node_key", "chain", "type", "open").withColumnRenamed(
            "key", "endpoint").withColumnRenamed("node_key", "key")
        for d in (expected, actual)
    ]
    drift = schema_diff(*renamed, "domain", "endpoint", "version").withColumnRenamed("endpoint", "key")
    seen = versions.select(*keys, "responses", "first_us", "last_us")
    return drift.join(seen, list(keys))


# ------------------------------------------------------------------------------------------
# mergeable summaries
# ------------------------------------------------------------------------------------------
#: A key of a path that looks like an id: digits, a UUID, a long hash, or a text with eight digits in a row.
ID_KEY = (
    r"(?<![^.])(?:[0-9]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}"
    r"|[^.\[]*[0-9]{8}[^.\[]*)(?![^.\[])"
)
ANY_ID = "{id}"


def folded_nodes(nodes: Column) -> Column:
    """The distinct nodes of one schema with all id keys folded into one, each as (path, chain, parent, field, type,
    open, leads). ``leads`` marks the first of the types that a path has, so it counts the path once."""

    def fold(n: Column) -> Column:
        path = F.regexp_replace(n["path"], ID_KEY, ANY_ID)
        parent = F.regexp_replace(n["parent"], ID_KEY, ANY_ID)
        return F.struct(path.alias("path"), n["chain"].alias("chain"), parent.alias("parent"), n["key"].alias("key"),
                        n["type"].alias("type"), n["open"].alias("open"))

    # in a step of its own, so that the pattern passes over a path and its parent once
    def named(n: Column) -> Column:
        path, parent = n["path"], n["parent"]
        field = F.when(n["chain"].endswith("a"), n["key"]).otherwise(
            path.substr(F.length(parent) + F.when(parent == "", 1).otherwise(2), F.length(path)))
        return F.struct(path.alias("path"), n["chain"].alias("chain"), parent.alias("parent"),
                        F.when(n["key"].isNotNull(), field).alias("field"), n["type"].alias("type"), n["open"].alias("open"))

    def distinct(s: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            same = [x[f].eqNullSafe(before[f]) for f in ("path", "chain", "parent", "field")]
            leads = (i == 0) | ~(same[0] & same[1] & same[2] & same[3])
            return F.struct(*[x[f].alias(f) for f in ("path", "chain", "parent", "field", "type", "open")],
                            leads.alias("leads"), ((i > 0) & x.eqNullSafe(before)).alias("again"))

        return F.filter(F.transform(s, mark), lambda x: ~x["again"])

    return let(F.sort_array(F.transform(F.transform(nodes, fold), named)), distinct)


def summarise(df: DataFrame, nodes: Column, *keys: str) -> DataFrame:
    """One row per (keys, path, chain, type) of the schemas in ``nodes``: responses that have it, responses counted for
    the path (``present``, which adds up over the path's types), first and last time. Rows of two summaries merge by
    :func:`merge_summaries`. ``df`` needs ``ts_us``; rows without a schema give nothing."""
    rows = df.select(*keys, "ts_us", F.explode(folded_nodes(nodes)).alias("n")).select(*keys, "ts_us", "n.*")
    return rows.groupBy(*keys, "path", "chain", "parent", "field", "type", "open").agg(
        F.count("*").alias("responses"), F.count_if("leads").alias("present"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def schema_summary(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """:func:`summarise` over a column of JSON texts."""
    known = F.filter(F.array(bodies.schema_nodes(body)), lambda n: n.isNotNull())
    rows = df.select(*keys, "ts_us", F.explode(known).alias("nodes"))
    return summarise(rows, F.col("nodes"), *keys)


def merge_summaries(one: DataFrame, two: DataFrame, *keys: str) -> DataFrame:
    """The summary of all responses behind either summary: counts add up, times are extremes."""
    return one.unionByName(two).groupBy(*keys, "path", "chain", "parent", "field", "type", "open").agg(
        F.sum("responses").alias("responses"), F.sum("present").alias("present"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def summary_drift(baseline: DataFrame, summary: DataFrame, *keys: str) -> DataFrame:
    """What :func:`schema_diff` finds for each response by itself, with the number of responses it holds for, out of the
    counts alone. A field is missing in the responses that have its parent as an object, less those that have the field.
    ``first_us`` and ``last_us``: when a new or changed node was seen; for a field that disappeared, when it was
    there (null: never).

    ``baseline``: (keys, nodes); id keys are folded in it as well, and a path may have several types then.
    """
    at = [*keys, "path", "chain"]
    nodes = baseline.filter(F.col("nodes").isNotNull()).select(*keys, F.explode(folded_nodes(F.col("nodes"))).alias("n"))
    # as many rows as the baseline has paths, used four times; what the baseline is made of runs once
    expected = reliable(nodes.select(*keys, "n.*").groupBy(*at, "parent", "field").agg(
        F.array_sort(F.collect_set("type")).alias("types"),
        F.bool_or((F.col("type") == "object") & F.col("open")).alias("opened")))
    above = F.col("chain").substr(F.lit(1), F.length("chain") - 1)
    member = F.col("chain").endswith("o")

    def parents(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*keys, F.col("path").alias("parent"), F.col("chain").alias("above"), *more)

    kinds = F.array_join("types", " or ")
    changed = summary.join(expected.select(*at, "types"), at).filter(
        ~F.array_contains("types", F.col("type"))
    ).select(
        *keys, "path", F.lit("warn").alias("severity"),
        F.concat(F.lit("type changed: "), kinds, F.lit(" → "), "type",
                 F.when(F.col("type") == "null", " (became nullable)").otherwise("")).alias("message"),
        "responses", "first_us", "last_us")

    objects = parents(summary.filter((F.col("type") == "object") & F.col("open")), "responses")
    seen = summary.groupBy(*at).agg(
        F.sum("present").alias("present"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    gone = (
        expected.filter(member).withColumn("above", above)
        .join(objects, [*keys, "parent", "above"])
        .join(seen, at, "left")
        .withColumn("responses", F.col("responses") - F.coalesce("present", F.lit(0)))
        .filter("responses > 0")
        .select(*keys, "path", F.lit("error").alias("severity"),
                F.concat(F.lit("field disappeared: "), "field", F.lit(" was "), kinds).alias("message"),
                "responses", "first_us", "last_us"))

    new = (
        summary.filter(member).join(expected.select(*at), at, "left_anti").withColumn("above", above)
        .join(parents(expected.filter("opened")), [*keys, "parent", "above"])
        .select(*keys, "path", F.lit("info").alias("severity"),
                F.concat(F.lit("new field: "), "field", F.lit(" ("), "type", F.lit(")")).alias("message"),
                "responses", "first_us", "last_us"))
    return changed.unionByName(gone).unionByName(new)


def drift_totals(baseline: DataFrame, responses: DataFrame) -> DataFrame:
    """Drift of landed responses against the catalog's baseline, counted over responses.

    ``baseline``: (domain, key, response_schema), ``responses``: (domain, key, ts_us, response_body).
    """
    # as many rows as an endpoint has paths and types, used three times
    summary = reliable(schema_summary(responses, "response_body", "domain", "key"))
    base = baseline.select("domain", "key", F.col("response_schema").alias("nodes"))
    return summary_drift(base, summary, "domain", "key")


def confidence_upgrade(endpoints: DataFrame, results: DataFrame) -> DataFrame:
    """An endpoint below full confidence that answered 2xx becomes a captured one.

    ``results``: (domain, key, status)."""
    good = (
        results.groupBy("domain", "key")
        .agg(F.bool_or(F.col("status").between(200, 299)).alias("answered"))
        .filter("answered")
    )
    joined = endpoints.join(good, ["domain", "key"], "left")
    up = F.coalesce(F.col("answered") & (F.col("confidence") < 1.0), F.lit(False))
    return (
        joined.withColumn("upgraded", up)
        .withColumn("confidence", F.when(up, 1.0).otherwise(F.col("confidence")))
        .withColumn("provenance", F.when(up, "captured").otherwise(F.col("provenance")))
        .drop("answered")
    )
