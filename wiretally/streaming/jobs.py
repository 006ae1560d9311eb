"""Structured Streaming jobs: continuous index, pairing, sessions, dedup, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wiretally import constants as K
from wiretally.operators import passive_index, traffic
from wiretally.session import remove, spread_groups
from wiretally.streaming import stateful

LATE = "10 minutes"
#: An endpoint that a session has not met for so long is new to it again.
FORGET_SECONDS = 60 * 86_400


def event_time(df: DataFrame, late: str = LATE) -> DataFrame:
    """``ts`` as an instant, taken from the epoch column so that no session time zone enters, with a
    watermark on it."""
    return df.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)


# ------------------------------------------------------------------------------------------
# continuous index
# ------------------------------------------------------------------------------------------
#: Version of the index's layout; readers refuse any other.
INDEX_VERSION = 2
#: Rows of the index are kept apart by the day they were seen on, so that what a domain did before it was idle can go.
SLICE_SECONDS = 86_400
IDLE_DAYS = K.DELETE_DAYS


def index_writer(ex: DataFrame, folder: str, checkpoint: str, slice_s: int = SLICE_SECONDS) -> DataStreamWriter:
    """Write the index of every micro-batch as one partition of the folder's deltas.

    A repeated batch overwrites its own partition, so a lost executor or a restarted query never
    counts a hit twice. The index is the merge of the deltas, see :func:`read_index`. ``slice_s`` must not exceed the
    idle time of :func:`expired_domains`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch of a few files is dealt to all cores
        obs = passive_index.observations(spread_groups(batch)).withColumn("slice", F.floor(F.col("ts_us") / (slice_s * 1_000_000)))
        by = ("slice",)
        (
            passive_index.endpoint_index(passive_index.combinations(obs, by), by)
            .withColumn("version", F.lit(INDEX_VERSION))
            .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(f"{folder}/deltas")
        )

    return ex.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def expired_domains(ex: DataFrame, idle: str = f"{IDLE_DAYS} days", late: str = LATE) -> DataFrame:
    """``domain, first_us, last_us, hits`` of every span of observations after which a domain was idle for ``idle``.

    A domain's span is a session window. It is the only state of the domain, and when the watermark passes its end the
    span is emitted and leaves the state. A domain that comes back later begins another span."""
    obs = event_time(passive_index.observations(ex).select("ts", "ts_us", "domain"), late)
    return obs.groupBy("domain", F.session_window("ts", idle).alias("w")).agg(
        F.count("*").alias("hits"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    ).select("domain", "first_us", "last_us", "hits")


def expiry_writer(ex: DataFrame, folder: str, checkpoint: str, idle: str = f"{IDLE_DAYS} days") -> DataStreamWriter:
    """Append expired spans to the folder of an index; its readers leave out what they cover."""
    return expired_domains(ex, idle).writeStream.format("parquet").outputMode("append").option(
        "path", f"{folder}/expired").option("checkpointLocation", checkpoint)


def _names(spark: SparkSession, folder: str, need: str = "") -> list[int]:
    """Numbers n of the folders ``…=n`` below a folder, of those that hold ``need``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(
        int(f.getPath().getName().partition("=")[2]) for f in system.listStatus(path)
        if "=" in f.getPath().getName()
        and (not need or system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), need))))


def _generation(spark: SparkSession, folder: str) -> int | None:
    """The newest whole generation: its number is the last batch that it covers."""
    return max(_names(spark, f"{folder}/generations", "_SUCCESS"), default=None)


def _alive(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """Rows of an index without those that were last seen in an expired span of their domain. Spans are as few as
    domains went idle; a gap is at least a slice long, so no row reaches across it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/expired/_spark_metadata")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return parts
    spans = spark.read.parquet(f"{folder}/expired").groupBy("domain").agg(F.max("last_us").alias("expired_us"))
    return parts.join(spans, "domain", "left").filter(
        F.col("expired_us").isNull() | (F.col("last_us") > F.col("expired_us"))).drop("expired_us")


def _index_parts(spark: SparkSession, folder: str, up_to: int | None = None) -> DataFrame:
    covered = _generation(spark, folder)
    deltas = spark.read.parquet(f"{folder}/deltas")
    newer = deltas.filter(F.col("batch_id") > F.lit(-1 if covered is None else covered))
    if up_to is not None:
        newer = newer.filter(F.col("batch_id") <= up_to)
    newer = newer.drop("batch_id")
    if covered is not None:
        newer = spark.read.parquet(f"{folder}/generations/covers={covered}").unionByName(newer)
    wrong = F.raise_error(F.concat(F.lit("index version "), F.col("version").cast("string")))
    checked = newer.filter(F.when(F.col("version") == INDEX_VERSION, True).otherwise(wrong.cast("boolean")))
    return checked.drop("version")


def read_index(spark: SparkSession, folder: str, domain: str | None = None) -> DataFrame:
    """The index a stream has built so far, or one domain of it: the newest generation and the deltas after it,
    without expired spans, merged, the earliest known value first. Another version of the layout is an error. A reader
    may overlap one compaction: the generation before the newest and the deltas after it stay."""
    parts = _index_parts(spark, folder)
    if domain is not None:
        parts = parts.filter(F.col("domain") == domain)
    return passive_index.merge_index(_alive(spark, folder, parts).drop("slice"))


def compact_index(spark: SparkSession, folder: str, as_of_us: int | None = None, *, slice_s: int = SLICE_SECONDS,
                  idle_s: int = IDLE_DAYS * 86_400) -> None:
    """Write a generation: all deltas of now and the generation before, merged, without expired spans. The writer may go
    on meanwhile, its later batches stay deltas. Readers see the generation once it is whole; then the deltas of the
    generation before it and all older generations are removed.

    ``as_of_us``: a time that the watermark has passed. Domains that were idle for too long then are left out as well,
    and slices that no later expiry can part any more become one, so an old domain costs a row per path."""
    covered = _generation(spark, folder)
    last = max(_names(spark, f"{folder}/deltas"), default=None)
    if last is None or last == covered:
        return
    rows = _alive(spark, folder, _index_parts(spark, folder, last))
    if as_of_us is not None:
        settled = (as_of_us - idle_s * 1_000_000) // (slice_s * 1_000_000)
        rows = rows.withColumn("slice", F.greatest("slice", F.lit(settled)))
    merged = passive_index.merge_index(rows, by=("slice",))
    if as_of_us is not None:
        seen = merged.groupBy("domain").agg(F.max("last_us").alias("last_us"))
        dead = passive_index.lifecycle(seen, as_of_us).filter("freshness = 'deleted'").select("domain")
        merged = merged.join(dead, "domain", "left_anti")
    merged.withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(
        f"{folder}/generations/covers={last}")
    if covered is not None:
        for n in _names(spark, f"{folder}/deltas"):
            if n <= covered:
                remove(spark, f"{folder}/deltas/batch_id={n}")
        for n in _names(spark, f"{folder}/generations"):
            if n < covered:
                remove(spark, f"{folder}/generations/covers={n}")


# ------------------------------------------------------------------------------------------
# pairing
# ------------------------------------------------------------------------------------------
def pair_stream(events: DataFrame, late: str = LATE, horizon: str = "5 minutes") -> DataFrame:
    """Stream–stream join of the three request events. Watermarks and the time range bound the state,
    in place of a row cap that drops old pairs. A request whose finished event is late is emitted
    without it (left outer), once the watermark passes."""
    keyed = event_time(events, late)
    sent = keyed.filter("kind = 'sent'").select("session", "request_id", "url", "method",
                                                F.col("ts").alias("sent_ts"), F.col("ts_us").alias("sent_us"))
    got = keyed.filter("kind = 'received'").select(
        F.col("session").alias("r_session"), F.col("request_id").alias("r_request"), "status", "content_type",
        F.col("ts").alias("got_ts"))
    done = keyed.filter("kind = 'finished'").select(
        F.col("session").alias("f_session"), F.col("request_id").alias("f_request"),
        F.col("ts").alias("done_ts"), F.col("ts_us").alias("finished_us"))
    span = F.expr(f"interval {horizon}")
    first = sent.join(
        got,
        (F.col("session") == F.col("r_session")) & (F.col("request_id") == F.col("r_request"))
        & (F.col("got_ts") >= F.col("sent_ts")) & (F.col("got_ts") <= F.col("sent_ts") + span),
    )
    return first.join(
        done,
        (F.col("session") == F.col("f_session")) & (F.col("request_id") == F.col("f_request"))
        & (F.col("done_ts") >= F.col("sent_ts")) & (F.col("done_ts") <= F.col("sent_ts") + span),
        "left_outer",
    ).select("session", "request_id", "url", "method", "status", "content_type", "sent_us", "finished_us")


# ------------------------------------------------------------------------------------------
# new endpoints, sessions, counts
# ------------------------------------------------------------------------------------------
def new_endpoint_stream(ex: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each (session, endpoint): stream deduplication with bounded state."""
    keyed = event_time(traffic.with_keys(traffic.accepted(ex)), late)
    return keyed.select("session", "domain", "key", "ts", "ts_us", "seq").dropDuplicatesWithinWatermark(
        ["session", "domain", "key"]
    )


def session_stream(ex: DataFrame, idle_s: int = K.IDLE_SECONDS, late: str = LATE,
                   forget_s: int = FORGET_SECONDS) -> DataFrame:
    """Capture sessions of a stream: they end ``idle_s`` after the last endpoint that was new to the session.

    Two operators in a row: first sightings of endpoints, whose state forgets an endpoint ``forget_s`` after the session
    met it last, and session windows over what is left."""
    keyed = event_time(traffic.with_keys(traffic.accepted(ex)), late)
    news = stateful.first_sightings(keyed, ["session", "domain", "key"], forget_s)
    return (
        news.groupBy("session", F.session_window("ts", f"{idle_s} seconds").alias("w"))
        .agg(F.count("*").alias("endpoints"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
        .select("session", "endpoints", "start_us", "end_us")
    )


def count_stream(ex: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """Captured and filtered exchanges per window."""
    marked = event_time(traffic.with_reject_reason(ex), late)
    return marked.groupBy(F.window("ts", size).alias("w")).agg(
        F.count_if(F.col("reason").isNull()).alias("captured"),
        F.count_if(F.col("reason").isNotNull()).alias("filtered"),
    ).select(F.col("w.start").alias("start"), "captured", "filtered")


def run_available(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that has landed, write parquet, and stop."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


