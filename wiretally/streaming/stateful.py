"""Stateful processors for rules that need their own state and timers.

Each keeps a bounded state per key: at most the accepted calls of one window, or a few numbers. Where keys are many, a slot
holds the states of a share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiretally import constants as K

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: Groups that the keys of a stream share. A call of Python and its trips to the state cost milliseconds, so they are paid
#: per slot and batch, not per key.
SLOTS = 4096


def _slotted(rows: DataFrame, keys: list[str], slots: int, *columns: Column | str) -> GroupedData:
    """``columns`` of the rows, grouped by a slot of their keys."""
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("slot"), *columns).groupBy("slot")


def _tuples(rows: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows as plain values, None where one is missing."""
    return zip(*(rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in columns), strict=True)


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    frames = list(rows)
    if not frames:
        return None
    return pd.concat(frames).sort_values(["ts_us", "seq"])


class FirstSightings(StatefulProcessor):
    """Rows of a key before which it was not seen for ``forget_s``, by event time, whatever the micro-batches are. Input
    rows are those of a slot, which many keys share; keys are texts. State: when each key of the slot was seen last, a list
    that batches append to and that is written anew when half of it is outdated or old enough to be forgotten; a timer
    drops it when all of it is."""

    def __init__(self, keys: list[str], forget_s: int) -> None:
        self.keys, self.forget_us = keys, forget_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState(
            "last", _struct(*((k, T.StringType()) for k in self.keys), ("ts_us", T.LongType())))

    def _timer(self, ts: int) -> int:
        return (ts + self.forget_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        met: dict[tuple, set[int]] = {}
        for r in rows:
            for *k, ts in _tuples(r, [*self.keys, "ts_us"]):
                met.setdefault(tuple(k), set()).add(ts)
        stored = list(self.last.get())
        last: dict[tuple, int] = {}
        for *k, ts in stored:
            last[tuple(k)] = max(ts, last.get(tuple(k), ts))
        before = max(last.values(), default=None)
        new, moved = [], {}
        for k, times in met.items():
            known = newest = last.get(k)
            for ts in sorted(times):
                if newest is None or ts - newest >= self.forget_us:
                    new.append((*k, ts))
                newest = ts if newest is None else max(newest, ts)
            if newest != known:
                moved[k] = newest
        past = timerValues.getCurrentWatermarkInMs() * 1000 - self.forget_us
        alive = {k: ts for k, ts in (last | moved).items() if ts > past}
        self._store(len(stored), moved, alive)
        after = max(alive.values(), default=None)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            if after is not None:
                self.handle.registerTimer(self._timer(after))
        if new:
            out = pd.DataFrame(new, columns=[*self.keys, "ts_us"])
            yield out.assign(ts=pd.to_datetime(out["ts_us"], unit="us", utc=True))[[*self.keys, "ts", "ts_us"]]

    def _store(self, stored: int, moved: dict[tuple, int], alive: dict[tuple, int]) -> None:
        if not alive:
            self.last.clear()
        elif stored + len(moved) > 2 * len(alive):
            self.last.put([(*k, ts) for k, ts in alive.items()])
        elif moved:
            self.last.appendList([(*k, ts) for k, ts in moved.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_sightings(rows: DataFrame, keys: list[str], forget_s: int, slots: int = SLOTS) -> DataFrame:
    """``keys, ts, ts_us`` of the rows by which a key is new; ``rows`` has these columns and a watermark on ``ts``, which
    the result keeps, so that another stateful operator can follow. Rows without a time are left out. A key's state is one
    number in one of ``slots`` lists: a session of any size is spread over all tasks by its endpoints. Keys are numbers
    and texts; they travel as texts, so that missing ones stay apart from all others. A checkpoint holds for one number
    of slots."""
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), T.StructField("ts", T.TimestampType()),
                           T.StructField("ts_us", T.LongType())])
    texts = (F.col(k).cast("string").alias(k) for k in keys)
    new = _slotted(rows.filter(F.col("ts_us").isNotNull()), keys, slots, *texts, "ts", "ts_us").transformWithStateInPandas(
        FirstSightings(keys, forget_s), schema, "Append", "eventTime", eventTimeColumnName="ts")
    return new.select(*(F.col(k).cast(rows.schema[k].dataType).alias(k) for k in keys), "ts", "ts_us")


class RateLimiter(StatefulProcessor):
    """Greedy sliding limiter: a call passes while fewer than ``limit`` passed calls lie in the window
    before it. State: the passed calls of one window. It is dropped after a quiet window."""

    def __init__(self, limit: int = K.RATE_LIMIT, window_ms: int = K.RATE_WINDOW_MS) -> None:
        self.limit, self.window_us = limit, window_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getListState("passed", _struct(("ts_us", T.LongType())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows)
        if pdf is None:
            return
        kept = [r[0] for r in self.passed.get()]
        flags = []
        for ts in pdf["ts_us"].tolist():
            kept = [t for t in kept if t > ts - self.window_us]
            ok = len(kept) < self.limit
            if ok:
                kept.append(ts)
            flags.append(ok)
        if kept:
            self.passed.put([(t,) for t in kept])
        else:
            self.passed.clear()
        yield pd.DataFrame({"key": pdf["key"].values, "seq": pdf["seq"].values,
                            "ts_us": pdf["ts_us"].values, "allowed": flags})

    def close(self) -> None:
        pass


LIMIT_OUTPUT = _struct(("key", T.LongType()), ("seq", T.LongType()), ("ts_us", T.LongType()),
                       ("allowed", T.BooleanType()))


class PlateauCapture(StatefulProcessor):
    """Captures that end after ``idle_s`` without a new endpoint or ``max_s`` in total. Input rows are
    exchanges (session, ts_us, seq, endpoint) of a slot, which many sessions share; sessions are texts. An endpoint counts
    when the session meets it first, so the state holds the endpoints of the slot's sessions, a list that batches append to,
    and their open captures. One row per ended capture; a timer at the first end of open ones ends those that the
    watermark passed."""

    def __init__(self, idle_s: int = K.PLATEAU_IDLE_SECONDS, max_s: int = K.PLATEAU_MAX_SECONDS) -> None:
        self.idle_us, self.max_us = idle_s * 1_000_000, max_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        session = ("session", T.StringType())
        self.seen = handle.getListState("seen", _struct(session, ("endpoint", T.StringType())))
        self.open = handle.getListState(
            "open", _struct(session, ("start_us", T.LongType()), ("last_us", T.LongType()), ("n", T.LongType())))

    def _end(self, start: int, last: int) -> int:
        return min(last + self.idle_us, start + self.max_us)

    def _timer(self, start: int, last: int) -> int:
        return self._end(start, last) // 1000 + 1

    def _first_timer(self, captures: dict[str, tuple]) -> int | None:
        return min((self._timer(start, last) for start, last, _ in captures.values()), default=None)

    def _captures(self) -> dict[str, tuple]:
        return {session: capture for session, *capture in self.open.get()}

    def _store(self, captures: dict[str, tuple]) -> None:
        if captures:
            self.open.put([(session, *capture) for session, capture in captures.items()])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        one = ["session", "endpoint"]
        firsts = [r.sort_values(["ts_us", "seq"]).drop_duplicates(one) for r in rows]
        pdf = _sorted(firsts)
        if pdf is None:
            return
        seen = set(self.seen.get())
        captures = self._captures()
        before = self._first_timer(captures)
        out, met = [], []
        for session, endpoint, ts in _tuples(pdf.drop_duplicates(one), [*one, "ts_us"]):
            if (session, endpoint) in seen:
                continue
            met.append((session, endpoint))
            start, last, n = captures.get(session, (None, None, 0))
            if start is not None and ts >= self._end(start, last):
                out.append((session, start, self._end(start, last), n))
                start = None
            if start is None:
                start, n = ts, 0
            captures[session] = (start, ts, n + 1)
        if not met:
            return
        self.seen.appendList(met)
        self._store(captures)
        after = self._first_timer(captures)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        if out:
            yield pd.DataFrame(out, columns=PLATEAU_OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        captures = self._captures()
        now = timerValues.getCurrentWatermarkInMs()
        ended = {s: c for s, c in captures.items() if self._timer(*c[:2]) < now}
        left = {s: c for s, c in captures.items() if s not in ended}
        if ended:
            self._store(left)
            yield pd.DataFrame([(s, start, self._end(start, last), n) for s, (start, last, n) in ended.items()],
                               columns=PLATEAU_OUTPUT.names)
        if left:
            self.handle.registerTimer(self._first_timer(left))

    def close(self) -> None:
        pass


PLATEAU_OUTPUT = _struct(("session", T.StringType()), ("start_us", T.LongType()), ("end_us", T.LongType()),
                         ("endpoints", T.LongType()))


class Promoter(StatefulProcessor):
    """Promotion attempts of a domain: at its n-th hit, then again after ``backoff_min`` minutes as
    long as it is not promoted. Input rows: (domain, ts_us, seq, promoted)."""

    def __init__(self, hits: int, backoff_min: int = K.PROMOTION_BACKOFF_MINUTES) -> None:
        self.hits, self.backoff_us = hits, backoff_min * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = _struct(("hits", T.LongType()), ("last_us", T.LongType()), ("promoted", T.BooleanType()))
        self.state = handle.getValueState("domain", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows)
        if pdf is None:
            return
        hits, last, promoted = self.state.get() if self.state.exists() else (0, -1, False)
        out = []
        for ts, done in zip(pdf["ts_us"].tolist(), pdf["promoted"].tolist()):
            hits += 1
            promoted = promoted or bool(done)
            ready = hits >= self.hits and not promoted
            if ready and (last < 0 or ts - last >= self.backoff_us):
                last = ts
                out.append((key[0], ts, hits))
        self.state.update((hits, last, promoted))
        if out:
            yield pd.DataFrame(out, columns=["domain", "attempt_us", "hits"])

    def close(self) -> None:
        pass


PROMOTE_OUTPUT = _struct(("domain", T.StringType()), ("attempt_us", T.LongType()), ("hits", T.LongType()))


def limit_stream(calls: DataFrame, limit: int = K.RATE_LIMIT, window_ms: int = K.RATE_WINDOW_MS) -> DataFrame:
    """``calls``: (key, seq, ts_us)."""
    return calls.groupBy("key").transformWithStateInPandas(
        RateLimiter(limit, window_ms), LIMIT_OUTPUT, "Append", "none")


def plateau_stream(news: DataFrame, idle_s: int = K.PLATEAU_IDLE_SECONDS,
                   max_s: int = K.PLATEAU_MAX_SECONDS, slots: int = SLOTS) -> DataFrame:
    """``news``: (session, ts, ts_us, seq, endpoint) with a watermark on ``ts``. Rows without a time are left out; sessions
    are numbers or texts and share ``slots`` lists of state. A checkpoint holds for one number of slots."""
    session = F.col("session").cast("string").alias("session")
    ended = _slotted(news.filter(F.col("ts_us").isNotNull()), ["session"], slots, session, "ts", "ts_us", "seq",
                     "endpoint").transformWithStateInPandas(PlateauCapture(idle_s, max_s), PLATEAU_OUTPUT, "Append", "eventTime")
    return ended.withColumn("session", F.col("session").cast(news.schema["session"].dataType))


def promotion_stream(obs: DataFrame, hits: int) -> DataFrame:
    """``obs``: (domain, ts_us, seq, promoted)."""
    return obs.groupBy("domain").transformWithStateInPandas(
        Promoter(hits), PROMOTE_OUTPUT, "Append", "none")
