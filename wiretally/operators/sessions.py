"""Traffic over time: pairing, capture sessions, idle gaps, rates, promotions.

A window over a hot session or domain would put a third of all rows into one task. So time is cut
into buckets first: a window runs inside (key, bucket), and only one summary row per bucket crosses
bucket borders.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally import constants as K


def pair_exchanges(events: DataFrame) -> DataFrame:
    """request ⋈ response ⋈ finished on (session, request): inner, so lone events vanish."""
    keys = ["session", "request_id"]
    sent = events.filter("kind = 'sent'").select(*keys, "url", "method", F.col("ts_us").alias("sent_us"))
    got = events.filter("kind = 'received'").select(*keys, "status", "content_type")
    done = events.filter("kind = 'finished'").select(*keys, F.col("ts_us").alias("finished_us"))
    return sent.join(got, keys).join(done, keys)


def previous_time(df: DataFrame, keys: list[str], ts_us: str, bucket_us: int) -> DataFrame:
    """Add ``prev_us``: the time of the row before, per key. Exact for any gap, and no key is sorted
    as a whole: rows look back inside their bucket, and the first row of a bucket takes the last time
    of the bucket before, found over one row per bucket."""
    b = df.withColumn("__bucket", F.floor(F.col(ts_us) / F.lit(bucket_us)).cast("bigint"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(ts_us)
    within = b.withColumn("__prev", F.lag(ts_us).over(inside))
    edges = within.groupBy(*keys, "__bucket").agg(F.max(ts_us).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    before = edges.select(*keys, "__bucket", F.lag("__last").over(across).alias("__before"))
    return within.join(before, [*keys, "__bucket"]).withColumn(
        "prev_us", F.coalesce("__prev", "__before")
    ).drop("__bucket", "__prev", "__before")


def new_endpoints(keyed: DataFrame, owner: str = "session") -> DataFrame:
    """First time each owner met an endpoint: (owner, domain, key, ts_us, seq)."""
    return keyed.groupBy(owner, "domain", "key").agg(
        F.min("ts_us").alias("ts_us"), F.min_by("seq", F.struct("ts_us", "seq")).alias("seq")
    )


def idle_gaps(news: DataFrame, owner: str = "session", idle_s: int = K.IDLE_SECONDS,
              bucket_us: int = 3_600_000_000) -> DataFrame:
    """Gaps of at least ``idle_s`` between new endpoints: each fires once."""
    steps = previous_time(news.select(owner, "ts_us").distinct(), [owner], "ts_us", bucket_us)
    gap = F.col("ts_us") - F.col("prev_us")
    return steps.filter(gap >= idle_s * 1_000_000).select(
        owner, F.col("prev_us").alias("idle_from_us"), F.col("ts_us").alias("resumed_us"), gap.alias("gap_us")
    )


def capture_sessions(news: DataFrame, owner: str = "session", idle_s: int = K.IDLE_SECONDS) -> DataFrame:
    """Sessions of new endpoints (see :func:`new_endpoints`) separated by idle gaps. Spark merges sessions
    map-side first."""
    return (
        news.withColumn("ts", F.timestamp_micros("ts_us")).groupBy(owner, F.session_window("ts", f"{idle_s} seconds").alias("w"))
        .agg(F.count("*").alias("endpoints"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
        .drop("w")
    )


def last_endpoints(news: DataFrame, owner: str = "session", n: int = 5) -> DataFrame:
    """The last ``n`` discovered endpoints of each owner, newest first: a bounded list."""
    w = Window.partitionBy(owner).orderBy(F.col("ts_us").desc(), F.col("seq").desc())
    top = news.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return top.groupBy(owner).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("recent")
    )


def sliding_counts(df: DataFrame, keys: list[str], window_ms: int = K.RATE_WINDOW_MS) -> DataFrame:
    """Calls per key in the ``window_ms`` up to and including each millisecond.

    Calls are counted per millisecond first, see :func:`_in_window`."""
    per_ms = df.groupBy(*keys, F.floor(F.col("ts_us") / 1000).cast("bigint").alias("ts_ms")).agg(
        F.count("*").alias("calls")
    )
    return _in_window(per_ms, keys, "ts_ms", window_ms).select(*keys, "ts_ms", "calls", "in_window")


def _in_window(counts: DataFrame, keys: list[str], at: str, window: int) -> DataFrame:
    """``counts`` (keys, at, calls) with ``in_window``: the calls of a key in the ``window`` up to and including ``at``.

    A count enters its own bucket, of one window, at its time and leaves the next one a window later. So every window lies
    inside one (key, bucket) group, as what the bucket before left behind and a running sum; a sliding frame would add up
    all of its rows for each row."""
    own = F.floor(F.col(at) / F.lit(window)).cast("bigint")
    steps = counts.withColumn("own", own).filter("own is not null").select(
        *keys, "calls", F.explode(F.array(
            F.struct(F.col("own").alias("bucket"), F.col(at).alias("at"), F.col("calls").alias("step")),
            F.struct((F.col("own") + 1).alias("bucket"), (F.col(at) + window).alias("at"), (-F.col("calls")).alias("step")))).alias("s")
    ).select(*keys, "calls", "s.*")
    group = Window.partitionBy(*keys, "bucket")
    left = -F.sum(F.when(F.col("step") < 0, F.col("step")).otherwise(0)).over(group)
    running = F.sum("step").over(group.orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("in_window", left + running).filter("step > 0").select(
        *keys, F.col("at").alias(at), "calls", "in_window")


def rate_limit(calls: DataFrame, limit: int = K.RATE_LIMIT, window_ms: int = K.RATE_WINDOW_MS) -> DataFrame:
    """Which calls a sliding limiter lets through; rejected calls are not counted.

    A call with at most ``limit`` calls in its window, rejected ones included, passes whatever came before. So
    only stretches of overload need the limiter's memory: they begin a window before their first doubtful call,
    where all calls passed, and end with their last one; a window without doubtful calls separates them. A key
    without overload is never in one task, and a stretch is read in order, keeping ``limit`` times.
    ``calls``: (key, seq, ts_us)."""
    window_us = window_ms * 1000
    bucket_us = window_us * 60
    rows = calls.select("key", "seq", "ts_us")
    doubtful = _busy(rows, limit, window_us).filter(~F.col("sure")).select("key", "ts_us").distinct()
    steps = previous_time(doubtful, ["key"], "ts_us", bucket_us)
    starts = steps.filter(F.col("prev_us").isNull() | (F.col("ts_us") - F.col("prev_us") > window_us)).select(
        "key", F.col("ts_us").alias("burst"))
    spans = _as_of(doubtful.withColumn("seq", F.lit(0).cast("bigint")), starts, bucket_us).groupBy("key", "burst").agg(
        F.max("ts_us").alias("end_us"))
    # a stretch takes in the window before its first doubtful call
    opened = spans.select("key", (F.col("burst") - window_us).alias("burst"))
    placed = _as_of(rows, opened, bucket_us)
    ends = spans.select(F.col("key").alias("k"), (F.col("burst") - window_us).alias("b"), "end_us")
    inside = placed.join(ends, (F.col("key") == F.col("k")) & (F.col("burst") == F.col("b")), "left").withColumn(
        "hard", F.coalesce(F.col("ts_us") <= F.col("end_us"), F.lit(False)))
    easy = inside.filter(~F.col("hard")).select("key", "seq", "ts_us", F.lit(True).alias("allowed"))
    hard = inside.filter("hard").select("key", "burst", "ts_us", "seq").repartition("key", "burst").sortWithinPartitions(
        "key", "burst", "ts_us", "seq")

    def limiter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, kept = None, deque()
        for part in parts:
            keys, bursts, times = (np.asarray(part.column(i)) for i in range(3))
            allowed = np.zeros(len(times), bool)
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (bursts[1:] != bursts[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(times)], strict=True):
                if (keys[start], bursts[start]) != place:
                    place, kept = (keys[start], bursts[start]), deque()
                at = start
                # from one call that passes to the next: the calls between them are rejected
                while at < end and (len(kept) < limit or (
                        at := at + int(np.searchsorted(times[at:end], kept[0] + window_us))) < end):
                    ts = int(times[at])
                    while kept and kept[0] <= ts - window_us:
                        kept.popleft()
                    kept.append(ts)
                    allowed[at] = True
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(3), part.column(2), pa.array(allowed)],
                names=["key", "seq", "ts_us", "allowed"])

    return easy.unionByName(hard.mapInArrow(limiter, easy.schema))


def _busy(rows: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Adds ``sure``: at most ``limit`` calls of the key lie in the window up to and including the call's time."""
    per_us = rows.groupBy("key", "ts_us").agg(F.count("*").alias("calls"))
    return _in_window(per_us, ["key"], "ts_us", window_us).select(
        "key", "ts_us", (F.col("in_window") <= limit).alias("sure"))


def _as_of(rows: DataFrame, starts: DataFrame, bucket_us: int) -> DataFrame:
    """Add the latest start at or before each row, bucket-wise like :func:`previous_time`; null before the first."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(bucket_us)).cast("bigint")
    both = rows.select("key", "seq", "ts_us", F.lit(None).cast("bigint").alias("start")).unionByName(
        starts.select("key", F.lit(None).cast("bigint").alias("seq"), F.col("burst").alias("ts_us"),
                      F.col("burst").alias("start"))
    ).withColumn("b", bucket("ts_us"))
    w = Window.partitionBy("key", "b").orderBy("ts_us", F.col("seq").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    filled = both.withColumn("burst", F.last("start", ignorenulls=True).over(w)).filter("start is null")
    edges = both.groupBy("key", "b").agg(F.max("start").alias("last_start"))
    past = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = edges.select("key", "b", F.last("last_start", ignorenulls=True).over(past).alias("before"))
    return filled.join(before, ["key", "b"]).select(
        "key", "seq", "ts_us", F.coalesce("burst", "before").alias("burst"))


def over_limit(df: DataFrame, keys: list[str], limit: int = K.RATE_LIMIT,
               window_ms: int = K.RATE_WINDOW_MS) -> DataFrame:
    return sliding_counts(df, keys, window_ms).filter(F.col("in_window") > limit)


def threshold(value: int | None) -> int:
    """A promotion threshold inside its bounds."""
    return max(K.PROMOTION_MIN, min(K.PROMOTION_MAX, K.PROMOTION_DEFAULT if value is None else value))


def promotions(obs: DataFrame, hits: int | None = None) -> DataFrame:
    """When each domain reached the promotion threshold: its n-th observation. Only n rows per domain
    and task leave the map side."""
    n = threshold(hits)
    w = Window.partitionBy("domain").orderBy("ts_us", "seq")
    ranked = obs.select("domain", "ts_us", "seq").withColumn("place", F.row_number().over(w))
    return ranked.filter(F.col("place") <= n).groupBy("domain").agg(
        F.max("place").alias("hits"), F.max("ts_us").alias("promoted_us")
    ).filter(F.col("hits") == n).select("domain", "promoted_us")


def traffic_counts(df: DataFrame, size: str = "1 minute", slide: str | None = None,
                   accepted: Column | None = None) -> DataFrame:
    """Tumbling or sliding traffic counts."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    ok = F.lit(True) if accepted is None else accepted
    return df.groupBy(w.alias("w")).agg(
        F.count_if(ok).alias("captured"), F.count_if(~ok).alias("filtered")
    ).select(F.col("w.start").alias("start"), "captured", "filtered")
