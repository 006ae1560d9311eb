"""Checks of pairing, sessions, rates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.checks.base import query
from wiretally.checks.signals import _OBS, index_columns
from wiretally.checks.sqlparts import EXR, KEYED, WITH
from wiretally.checks.traffic import ex, keyed
from wiretally.operators import passive_index, sessions, traffic
from wiretally.session import state_folder
from wiretally.sources import derived as D
from wiretally.sources.exchanges import EVENT_SCHEMA, request_events, stream_exchanges
from wiretally.streaming import jobs, stateful

_GAP = 3600  # seconds; the test events are minutes apart


def events(spark, sf):
    return D.landed(spark, sf, "request_events", lambda: request_events(ex(spark, sf)))


_PAIRED = f"{WITH}{EXR} SELECT session, request_id, url, method, status, ts_us AS sent_us, ts_us + 120000 AS finished_us FROM exr"


@query("pair_exchanges", _PAIRED)
def _(spark, sf):
    return sessions.pair_exchanges(events(spark, sf)).drop("content_type")


_NEWS = f"""{WITH}{KEYED}, news AS (SELECT session, domain, key, min(ts_us) AS ts_us, arg_min(seq, (ts_us, seq)) AS seq FROM keyed GROUP BY ALL)"""


@query("idle_gaps", f"""{_NEWS},
 g AS (SELECT session, ts_us, lag(ts_us) OVER (PARTITION BY session ORDER BY ts_us) AS prev FROM (SELECT DISTINCT session, ts_us FROM news))
SELECT session, prev AS idle_from_us, ts_us AS resumed_us, ts_us - prev AS gap_us FROM g WHERE ts_us - prev >= {_GAP}000000""")
def _(spark, sf):
    return sessions.idle_gaps(sessions.new_endpoints(keyed(spark, sf)), idle_s=_GAP)


@query("capture_sessions", f"""{_NEWS},
 s AS (SELECT session, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session ORDER BY ts_us) < {_GAP}000000 THEN 0 ELSE 1 END AS st FROM news),
 n AS (SELECT *, sum(st) OVER (PARTITION BY session ORDER BY ts_us) AS grp FROM s)
SELECT session, count(*) AS endpoints, min(ts_us) AS start_us, max(ts_us) AS end_us FROM n GROUP BY session, grp""")
def _(spark, sf):
    return sessions.capture_sessions(sessions.new_endpoints(keyed(spark, sf)), idle_s=_GAP)


@query("last_endpoints", f"""{_NEWS},
 r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_us DESC, seq DESC) AS rn FROM news)
SELECT session, string_agg(key, '|' ORDER BY rn) AS recent FROM r WHERE rn <= 5 GROUP BY session""")
def _(spark, sf):
    out = sessions.last_endpoints(sessions.new_endpoints(keyed(spark, sf)))
    return out.select("session", F.array_join("recent", "|").alias("recent"))


@query("previous_time", f"""{WITH}{KEYED}
SELECT domain, seq, lag(ts_us) OVER (PARTITION BY domain ORDER BY ts_us) AS prev_us FROM keyed""")
def _(spark, sf):
    return sessions.previous_time(keyed(spark, sf), ["domain"], "ts_us", 600_000_000).select("domain", "seq", "prev_us")


@query("sliding_counts", f"""{WITH}{EXR}, c AS (SELECT domain, CAST(floor(ts_us / 1000) AS BIGINT) AS ts_ms, count(*) AS calls FROM exr GROUP BY ALL)
SELECT domain, ts_ms, calls, CAST(sum(calls) OVER (PARTITION BY domain ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM c""")
def _(spark, sf):
    e = traffic.with_reject_reason(ex(spark, sf)).select("domain", "ts_us")
    return sessions.sliding_counts(e, ["domain"], 3_600_000)


@query("over_limit", f"""{WITH}{EXR}, c AS (SELECT domain, CAST(floor(ts_us / 1000) AS BIGINT) AS ts_ms, count(*) AS calls FROM exr GROUP BY ALL),
 w AS (SELECT domain, ts_ms, sum(calls) OVER (PARTITION BY domain ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n FROM c)
SELECT domain, ts_ms FROM w WHERE n > 4""")
def _(spark, sf):
    e = traffic.with_reject_reason(ex(spark, sf)).select("domain", "ts_us")
    return sessions.over_limit(e, ["domain"], 4, 3_600_000).select("domain", "ts_ms")


def calls(df):
    return df.select((F.col("session") % 5).alias("key"), "seq", "ts_us")


# the limiter call by call: its memory is the list of calls that it let through in the last window
_LIMITED = f"""{WITH}{EXR},
 c AS (SELECT session % 5 AS key, seq, ts_us, row_number() OVER (PARTITION BY session % 5 ORDER BY ts_us, seq) AS n FROM exr),
 r AS (SELECT key, seq, ts_us, n, true AS allowed, [ts_us] AS kept FROM c WHERE n = 1
  UNION ALL SELECT c.key, c.seq, c.ts_us, c.n, len(list_filter(r.kept, lambda t: t > c.ts_us - 3600000000)) < 3,
   CASE WHEN len(list_filter(r.kept, lambda t: t > c.ts_us - 3600000000)) < 3
     THEN list_append(list_filter(r.kept, lambda t: t > c.ts_us - 3600000000), c.ts_us)
     ELSE list_filter(r.kept, lambda t: t > c.ts_us - 3600000000) END
  FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1)
SELECT key, seq, ts_us, allowed FROM r"""


@query("rate_limit", _LIMITED)
def _(spark, sf):
    return sessions.rate_limit(calls(ex(spark, sf)), 3, 3_600_000)


@query("promotions", f"""{_OBS}
SELECT domain, ts_us AS promoted_us FROM (SELECT domain, ts_us, row_number() OVER (PARTITION BY domain ORDER BY ts_us, seq) AS rn FROM obs) WHERE rn = 7""")
def _(spark, sf):
    return sessions.promotions(passive_index.observations(ex(spark, sf)), 7)


@query("traffic_counts", f"""{WITH}{EXR}
SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, count(*) FILTER (WHERE reason IS NULL) AS captured, count(*) FILTER (WHERE reason IS NOT NULL) AS filtered FROM exr GROUP BY 1""")
def _(spark, sf):
    marked = traffic.with_reject_reason(ex(spark, sf))
    return epoch(sessions.traffic_counts(marked, "1 hour", accepted=F.col("reason").isNull()))


@query("traffic_counts_sliding", f"""{WITH}{EXR}, s AS (SELECT ts, reason, time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes * t.i AS w FROM exr, (VALUES (0), (1)) AS t(i))
SELECT epoch_us(w) AS start_us, count(*) FILTER (WHERE reason IS NULL) AS captured, count(*) FILTER (WHERE reason IS NOT NULL) AS filtered FROM s GROUP BY 1""")
def _(spark, sf):
    marked = traffic.with_reject_reason(ex(spark, sf))
    return epoch(sessions.traffic_counts(marked, "1 hour", "30 minutes", F.col("reason").isNull()))


def epoch(df):
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', start)")
    if dict(df.dtypes)["start"] == "timestamp":
        us = F.unix_micros("start")
    return df.select(us.alias("start_us"), "captured", "filtered")


# ------------------------------------------------------------------------------------------
# streams: run over all landed files, then compared with the batch rule
# ------------------------------------------------------------------------------------------
def stream(spark, sf):
    path = D.landed_path(spark, sf, "exchanges", ex)
    return stream_exchanges(spark, path)


def outcome(spark, df, name, mode="append"):
    folder = state_folder(spark, f"{name}-out")
    jobs.run_available(df, folder, state_folder(spark, f"{name}-cp"), mode)
    return spark.read.parquet(folder)


@query("stream_index", f"{_OBS} SELECT * FROM idx")
def _(spark, sf):
    folder = state_folder(spark, "index")
    path = D.landed_path(spark, sf, "exchanges", ex)
    source = stream_exchanges(spark, path, files_per_trigger=3)
    q = jobs.index_writer(source, folder, state_folder(spark, "index-cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return index_columns(jobs.read_index(spark, folder))


@query("stream_index_compacted", f"{_OBS} SELECT * FROM idx")
def _(spark, sf):
    # stream a part of the files, compact, stream on, compact, stream the rest
    folder, checkpoint = state_folder(spark, "index"), state_folder(spark, "index-cp")
    path = D.landed_path(spark, sf, "exchanges", ex)
    for files in ("part-0000[0-1]*", "part-0000[0-4]*", "part-*"):
        source = stream_exchanges(spark, path, glob=files)
        q = jobs.index_writer(source, folder, checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if files != "part-*":
            jobs.compact_index(spark, folder)
    return index_columns(jobs.read_index(spark, folder))


_IDLE = 3 * 3600  # seconds; no domain of the test events is idle for days
_EXPIRED = _OBS.replace(" obs AS (", " obs0 AS (", 1).replace("\n idx AS (", f"""
 gaps AS (SELECT domain, ts_us, lead(ts_us) OVER (PARTITION BY domain ORDER BY ts_us) AS nxt FROM obs0),
 cut AS (SELECT domain, max(ts_us) AS until_us FROM gaps WHERE (nxt IS NULL OR nxt - ts_us >= {_IDLE}000000)
   AND ts_us + {_IDLE}000000 <= (SELECT max(ts_us) // 1000 * 1000 FROM obs0) - 600000000 GROUP BY domain),
 obs AS (SELECT obs0.* FROM obs0 LEFT JOIN cut USING (domain) WHERE until_us IS NULL OR ts_us > until_us),
 idx AS (""", 1)


@query("stream_index_expired", f"{_EXPIRED} SELECT * FROM idx")
def _(spark, sf):
    """Part of the files, compaction, the rest; then all domains' idle spans, another compaction, and the index."""
    folder, checkpoint = state_folder(spark, "index"), state_folder(spark, "index-cp")
    path = D.landed_path(spark, sf, "exchanges", ex)
    for files in ("part-0000[0-3]*", "part-*"):
        source = stream_exchanges(spark, path, glob=files)
        jobs.index_writer(source, folder, checkpoint, 3600).trigger(availableNow=True).start().awaitTermination()
        jobs.compact_index(spark, folder, slice_s=3600, idle_s=_IDLE)
    jobs.expiry_writer(stream(spark, sf), folder, state_folder(spark, "expiry-cp"), f"{_IDLE} seconds").trigger(
        availableNow=True).start().awaitTermination()
    return index_columns(jobs.read_index(spark, folder))


@query("stream_index_domain", f"{_OBS} SELECT * FROM idx WHERE domain = 'api.shop.example.com'")
def _(spark, sf):
    folder = state_folder(spark, "index")
    q = jobs.index_writer(stream(spark, sf), folder, state_folder(spark, "index-cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return index_columns(jobs.read_index(spark, folder, "api.shop.example.com"))


@query("stream_pairing", _PAIRED)
def _(spark, sf):
    path = D.landed_path(spark, sf, "request_events", events)
    source = spark.readStream.schema(EVENT_SCHEMA).parquet(path)
    return outcome(spark, jobs.pair_stream(source), "pairs").drop("content_type")


@query("stream_new_endpoints", f"{_NEWS} SELECT session, domain, key FROM news")
def _(spark, sf):
    # in one batch, rows of one endpoint race: which row stays is open, that one stays is not
    return outcome(spark, jobs.new_endpoint_stream(stream(spark, sf), "60 days"), "news").select(
        "session", "domain", "key")


@query("stream_sessions", f"""{_NEWS},
 s AS (SELECT session, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session ORDER BY ts_us) < {_GAP}000000 THEN 0 ELSE 1 END AS st FROM news),
 n AS (SELECT *, sum(st) OVER (PARTITION BY session ORDER BY ts_us) AS grp FROM s),
 g AS (SELECT session, count(*) AS endpoints, min(ts_us) AS start_us, max(ts_us) AS end_us FROM n GROUP BY session, grp)
SELECT * FROM g WHERE end_us + {_GAP}000000 <= (SELECT max(ts_us) // 1000 * 1000 FROM keyed) - 600000000""")
def _(spark, sf):
    _rocksdb(spark)
    return outcome(spark, jobs.session_stream(stream(spark, sf), _GAP), "sessions")


@query("stream_counts", f"""{WITH}{EXR}, c AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS w, count(*) FILTER (WHERE reason IS NULL) AS captured, count(*) FILTER (WHERE reason IS NOT NULL) AS filtered FROM exr GROUP BY 1)
SELECT epoch_us(w) AS start_us, captured, filtered FROM c WHERE w + INTERVAL 1 hour <= (SELECT max(ts) FROM exr) - INTERVAL 10 minutes""")
def _(spark, sf):
    return epoch(outcome(spark, jobs.count_stream(stream(spark, sf)), "counts"))


def _rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)


@query("stream_rate_limit", _LIMITED)
def _(spark, sf):
    _rocksdb(spark)
    return outcome(spark, stateful.limit_stream(calls(stream(spark, sf)), 3, 3_600_000), "limit")


_PLATEAU = f"""{_NEWS},
 c AS (SELECT session, ts_us, row_number() OVER (PARTITION BY session ORDER BY ts_us, seq) AS i FROM news),
 r AS (SELECT session, i, ts_us AS start_us, ts_us AS last_us, 1::BIGINT AS n, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::BIGINT AS m FROM c WHERE i = 1
  UNION ALL SELECT c.session, c.ci, CASE WHEN ended THEN c.ts_us ELSE start_us END, c.ts_us, CASE WHEN ended THEN 1 ELSE n + 1 END,
   CASE WHEN ended THEN start_us END, CASE WHEN ended THEN end_us END, CASE WHEN ended THEN n END
  FROM (SELECT r.*, least(last_us + 3600000000, start_us + 7200000000) AS end_us, c.ts_us, c.i AS ci,
      c.ts_us >= least(last_us + 3600000000, start_us + 7200000000) AS ended FROM r JOIN c ON c.session = r.session AND c.i = r.i + 1) c),
 tail AS (SELECT session, start_us, least(last_us + 3600000000, start_us + 7200000000) AS end_us, n,
   row_number() OVER (PARTITION BY session ORDER BY i DESC) AS back FROM r)
SELECT session, s AS start_us, e AS end_us, m AS endpoints FROM r WHERE s IS NOT NULL
UNION ALL SELECT session, start_us, end_us, n FROM tail WHERE back = 1
 AND end_us // 1000 + 1 < (SELECT max(ts_us) // 1000 - 600000 FROM keyed)"""


@query("stream_plateau", _PLATEAU)
def _(spark, sf):
    _rocksdb(spark)
    rows = jobs.event_time(traffic.with_keys(traffic.accepted(stream(spark, sf)))).select(
        "session", "ts", "ts_us", "seq", F.concat_ws(" ", "domain", "key").alias("endpoint"))
    return outcome(spark, stateful.plateau_stream(rows, 3600, 7200), "plateau")


@query("stream_promotions", f"""{_OBS},
 o AS (SELECT domain, ts_us, seq, row_number() OVER w AS hits, bool_or(seq > 9000) OVER w AS promoted FROM obs WINDOW w AS (PARTITION BY domain ORDER BY ts_us, seq)),
 rd AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts_us, seq) AS i FROM o WHERE hits >= 3 AND NOT promoted),
 r AS (SELECT domain, ts_us, hits, i, ts_us AS last, true AS fired FROM rd WHERE i = 1
  UNION ALL SELECT q.domain, q.ts_us, q.hits, q.i, CASE WHEN q.ts_us - r.last >= {K.PROMOTION_BACKOFF_MINUTES * 60_000_000} THEN q.ts_us ELSE r.last END,
   q.ts_us - r.last >= {K.PROMOTION_BACKOFF_MINUTES * 60_000_000} FROM r JOIN rd q ON q.domain = r.domain AND q.i = r.i + 1)
SELECT domain, ts_us AS attempt_us, hits FROM r WHERE fired""")
def _(spark, sf):
    _rocksdb(spark)
    obs = passive_index.observations(stream(spark, sf)).select("domain", "ts_us", "seq", (F.col("seq") > 9000).alias("promoted"))
    return outcome(spark, stateful.promotion_stream(obs, 3), "promote")
