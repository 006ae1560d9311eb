"""Catalog tables: storage, validation, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally import constants as K
from wiretally.functions import headers, urls
from wiretally.functions.bodies import scrub_body

BUCKETS = 256


def bucket(domain: Column | str = "domain", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash(domain), F.lit(buckets))


# ------------------------------------------------------------------------------------------
# storage: many domains share a bucket folder, so a million domains do not make a million folders
# ------------------------------------------------------------------------------------------
def write_catalog(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a whole catalog, clustered by domain inside its bucket."""
    placed = df.withColumn("bucket", bucket("domain", buckets))
    (
        placed.repartition("bucket")
        .sortWithinPartitions("bucket", "domain")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("bucket")
        .parquet(path)
    )


def replace_domains(spark: SparkSession, df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the given domains and keep all others. Only the buckets that change are rewritten;
    Spark's dynamic overwrite swaps them at commit."""
    new = df.withColumn("bucket", bucket("domain", buckets))
    touched = new.select("bucket").distinct()
    old = (
        spark.read.parquet(path)
        .join(touched, "bucket", "left_semi")
        .join(new.select("domain").distinct(), "domain", "left_anti")
    )
    (
        old.select(*new.columns)
        .unionByName(new)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "domain")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_catalog(spark: SparkSession, path: str, domain: str | None = None,
                 buckets: int = BUCKETS) -> DataFrame:
    """The catalog, or one domain of it: its bucket prunes the folders, and the domain filter
    reaches the parquet scan."""
    df = spark.read.parquet(path)
    if domain is None:
        return df.drop("bucket")
    # a constant: the planner folds it before it prunes
    return df.filter((F.col("bucket") == bucket(F.lit(domain), buckets)) & (F.col("domain") == domain)).drop("bucket")


def safe_documents(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse catalog documents (one JSON text each); broken ones are skipped, not fatal."""
    v = F.try_parse_json(raw)
    return docs.withColumn("doc", v).filter(
        F.col("doc").isNotNull() & F.try_variant_get("doc", "$.endpoints", "array<variant>").isNotNull()
    )


def documents_to_endpoints(docs: DataFrame) -> DataFrame:
    """Endpoints of catalog documents with the index defaults: method GET, path /."""
    parsed = safe_documents(docs)
    rows = parsed.select(
        F.try_variant_get("doc", "$.domain", "string").alias("domain"),
        F.coalesce(F.try_variant_get("doc", "$.provenance", "string"), F.lit("unsigned")).alias("provenance"),
        F.coalesce(F.try_variant_get("doc", "$.capturedAt", "string"), F.lit("")).alias("captured_at"),
        F.posexplode_outer(F.try_variant_get("doc", "$.endpoints", "array<variant>")).alias("pos", "e"),
    )

    def text(path: str, default: str) -> Column:
        return F.coalesce(F.try_variant_get("e", path, "string"), F.lit(default))

    return rows.select(
        "domain", "provenance", "captured_at", "pos",
        text("$.id", "").alias("id"), text("$.method", "GET").alias("method"),
        text("$.path", "/").alias("path"),
        F.try_variant_get("e", "$.replayability.tier", "string").alias("tier"),
        F.coalesce(F.try_variant_get("e", "$.replayability.verified", "boolean"), F.lit(False)).alias("verified"),
    )


def list_catalog(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("domain").agg(
        F.count("*").alias("endpoints"), F.max("last_us").alias("captured_us")
    )


# ------------------------------------------------------------------------------------------
# searched tables; the index itself is in ``search_index``
# ------------------------------------------------------------------------------------------
def remove_from_index(index: DataFrame, domains: DataFrame) -> DataFrame:
    return index.join(domains.select("domain").distinct(), "domain", "left_anti")


def search_summary(hits: DataFrame) -> DataFrame:
    """One row: found, and how many endpoints across how many domains. Counts per domain come first,
    so the distinct count is over domains."""
    per = hits.groupBy("domain").agg(F.count("*").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("d"))
    return total.select(
        (F.col("n") > 0).alias("found"),
        F.concat(
            F.col("n").cast("string"), F.lit(" endpoints across "), F.col("d").cast("string"),
            F.when(F.col("d") == 1, " domain").otherwise(" domains"),
        ).alias("summary"),
    )


def index_staleness(index_meta: DataFrame, catalog: DataFrame, as_of_us: Column) -> DataFrame:
    """(stale, reason, age_warning) of an index. ``index_meta``: (version, file_count, built_us), no
    row when there is none."""
    disk = catalog.select("domain").distinct().agg(F.count("*").alias("disk"))
    both = disk.unionByName(
        index_meta.select("version", "file_count", "built_us"), allowMissingColumns=True
    )
    joined = both.agg(*[F.max(n).alias(n) for n in ("disk", "version", "file_count", "built_us")])
    reason = (
        F.when(F.col("version").isNull(), "missing")
        .when(F.col("version") != 1, "version-mismatch")
        .when(F.col("disk") != F.col("file_count"), "filecount-mismatch")
    )
    old = as_of_us - F.col("built_us") > K.INDEX_STALE_HOURS * 3_600_000_000
    return joined.select(
        reason.isNotNull().alias("stale"), reason.alias("reason"),
        (reason.isNull() & old).alias("age_warning"),
    )


# ------------------------------------------------------------------------------------------
# validation and export
# ------------------------------------------------------------------------------------------
def domain_violations(domains: DataFrame) -> DataFrame:
    """(domain, pos, message) of catalog-level rules. ``domains``: (domain, base_url, endpoints)."""
    host = urls.url_host("base_url")
    ok_url = host.isNotNull() & urls.url_scheme("base_url").isin("http", "https")
    inside = (host == F.col("domain")) | host.endswith(F.concat(F.lit("."), "domain"))
    checks = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.length("domain").between(1, 253), F.lit(False)),
                   "Invalid domain: must be a string of 1-253 characters"),
            F.when(F.col("base_url").isNull(), "Missing baseUrl"),
            F.when(F.col("base_url").isNotNull() & ~ok_url,
                   "Invalid baseUrl: must be a valid HTTP(S) URL"),
            F.when(ok_url & ~inside,
                   F.concat(F.lit('baseUrl hostname "'), host, F.lit('" does not match domain "'),
                            F.col("domain"), F.lit('"'))),
            F.when(F.col("endpoints") > K.MAX_ENDPOINTS_PER_DOMAIN, "Too many endpoints (max 500)"),
        )
    )
    return domains.select("domain", F.lit(-1).alias("pos"), F.explode(checks).alias("message"))


def endpoint_violations(endpoints: DataFrame) -> DataFrame:
    """(domain, pos, message) of endpoint-level rules."""
    label = F.concat(F.lit("Endpoint "), F.col("pos").cast("string"), F.lit(": "))

    def rule(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.concat(label, F.lit(text)))

    rules = [
        rule(~F.length("id").between(1, 200), "id must be a string of 1-200 characters"),
        rule(~F.col("method").isin(K.ALLOWED_METHODS),
             "method must be one of " + ", ".join(K.ALLOWED_METHODS)),
        rule(~F.col("path").startswith("/"), "path must start with /"),
        rule(F.length("path") > 2000, "path exceeds 2000 characters"),
    ]
    if "body_type" in endpoints.columns and "has_body" in endpoints.columns:
        rules.append(
            F.when(F.col("has_body") & F.col("body_type").isNull(),
                   F.concat(label, F.lit("requestBody.contentType must be a string")))
        )
    return endpoints.select(
        "domain", "pos", F.explode(F.array_compact(F.array(*rules))).alias("message")
    )


def validate_catalog(domains: DataFrame, endpoints: DataFrame) -> DataFrame:
    """All violations of a catalog. A domain with none is valid."""
    return domain_violations(domains).unionByName(endpoint_violations(endpoints))


def first_violation(violations: DataFrame) -> DataFrame:
    return violations.groupBy("domain").agg(
        F.min_by("message", F.struct("pos", "message")).alias("message"), F.count("*").alias("violations")
    )


def catalog_url_safety(domains: DataFrame, endpoints: DataFrame) -> DataFrame:
    """First unsafe URL of each domain: base URL first, then example URLs in order."""
    base = domains.select(
        "domain", F.lit(-1).alias("pos"),
        F.concat(F.lit("baseUrl: "), urls.url_safety_reason("base_url")).alias("reason"),
    )
    examples = endpoints.filter(F.coalesce("example_url", F.lit("")) != "").select(
        "domain", "pos",
        F.concat(F.lit("endpoint "), "id", F.lit(": "), urls.url_safety_reason("example_url")).alias("reason"),
    )
    found = base.unionByName(examples).filter(F.col("reason").isNotNull())
    return found.groupBy("domain").agg(F.min_by("reason", F.struct("pos", "reason")).alias("reason"))


def catalog_fingerprint(endpoints: DataFrame) -> DataFrame:
    """Digest of a domain's endpoints in canonical form, for change detection: a digest per endpoint with its maps
    sorted by key, and the domain's digest over their sums. Sums do not depend on an order, so a domain of
    any size is one row of numbers in every task."""
    columns = [
        F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in sorted(endpoints.schema.fields, key=lambda f: f.name) if f.name not in ("domain", "provenance")
    ]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}), 256)
    rows = endpoints.select("domain", digest.alias("digest"))
    parts = [F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16, 31, 46)]
    sums = rows.groupBy("domain").agg(
        F.count("*").alias("endpoints"), *[F.sum(p).cast("string").alias(f"p{i}") for i, p in enumerate(parts)])
    return sums.select("domain", "endpoints", F.sha2(F.concat_ws("|", "p0", "p1", "p2", "p3"), 256).alias("fingerprint"))


def signature_state(stored: DataFrame, actual: DataFrame, as_of_us: Column) -> DataFrame:
    """valid, invalid or unsigned, and whether a signature is older than 180 days.
    ``stored``: (domain, fingerprint, signed_us)."""
    mine = actual.select("domain", F.col("fingerprint").alias("actual"))
    j = mine.join(stored, "domain", "left")
    return j.select(
        "domain",
        F.when(F.col("fingerprint").isNull(), "unsigned")
        .when(F.col("fingerprint") == F.col("actual"), "valid")
        .otherwise("invalid")
        .alias("state"),
        F.coalesce(
            as_of_us - F.col("signed_us") > K.SIGNATURE_MAX_DAYS * 86_400_000_000, F.lit(False)
        ).alias("stale"),
    )


def validate_import(domains: DataFrame, endpoints: DataFrame, signatures: DataFrame) -> DataFrame:
    """valid, reason and signature state per domain: structure, then signature, then URLs."""
    broken = first_violation(validate_catalog(domains, endpoints)).select(
        "domain", F.col("message").alias("structure"))
    unsafe = catalog_url_safety(domains, endpoints).select("domain", F.col("reason").alias("url"))
    j = (
        domains.select("domain", "endpoints")
        .join(broken, "domain", "left")
        .join(unsafe, "domain", "left")
        .join(signatures.select("domain", "state"), "domain", "left")
    )
    reason = (
        F.when(F.col("structure").isNotNull(), F.col("structure"))
        .when(F.col("state") == "invalid",
              "Skill file signature is invalid — file was tampered with or signed by a different instance")
        .when(F.col("url").isNotNull(), F.concat(F.lit("SSRF risk: "), "url"))
    )
    return j.select(
        "domain", "endpoints", reason.isNull().alias("valid"), reason.alias("reason"),
        F.coalesce("state", F.lit("unsigned")).alias("signature"),
    )


def export_scrubbed(endpoints: DataFrame) -> DataFrame:
    """Endpoints ready to leave the house: secret headers stored, body templates scrubbed."""
    out = endpoints.withColumn("headers", headers.scrub_export_headers("headers"))
    if "request_template" in endpoints.columns:  # a catalog from elsewhere may hold raw bodies
        out = out.withColumn("request_template", scrub_body("request_template"))
    return out
