"""Stateful streams whose keys share slots: rows of many keys over several runs beside a plain loop."""

import pytest
from pyspark.sql import functions as F

from wiretally.streaming import jobs, stateful

SCHEMA = "session bigint, ts_us bigint, seq bigint, endpoint string"
HOUR = 3_600_000_000
BASE = 500_000 * HOUR


@pytest.fixture
def runs(spark):
    """Three runs of rows, later than each other: numbers beyond 2^53, missing sessions, rows without a time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    spans, out = ((0, 30), (31, 70), (200, 230)), []
    for run, (start, stop) in enumerate(spans):
        rows = []
        for i in range(1500):
            n = i * 7919 + run * 104_729
            session = None if n % 19 == 0 else 2**60 + n % 61
            ts = None if n % 97 == 0 else BASE + start * HOUR + n * 1_000_003 % ((stop - start) * HOUR)
            rows.append((session, ts, run * 10_000 + i, f"e{n % 13}"))
        out.append(rows + rows[:200])
    return out


def drain(spark, tmp_path, runs, make):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in runs:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.event_time(spark.readStream.schema(SCHEMA).parquet(source))
        jobs.run_available(make(stream), folder, checkpoint)
    return spark.read.parquet(folder).collect(), checkpoint


def held(spark, checkpoint, name):
    """Groups that hold a state."""
    state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return state.select(F.to_json("key")).distinct().count()


def test_first_sightings_share_slots(spark, tmp_path, runs):
    forget = 20 * 3600
    got, checkpoint = drain(
        spark, tmp_path, runs, lambda s: stateful.first_sightings(s, ["session", "endpoint"], forget, slots=16))
    want, last = [], {}
    for session, ts, _, endpoint in sorted((r for rows in runs for r in rows if r[1] is not None), key=lambda r: r[1]):
        before = last.get((session, endpoint))
        if before is None or ts - before >= forget * 1_000_000:
            want.append((session, endpoint, ts))
        last[session, endpoint] = ts
    order = lambda rows: sorted(rows, key=str)
    assert order((r.session, r.endpoint, r.ts_us) for r in got) == order(want)
    assert any(session is None for session, _, _ in want) and len(want) > len(last) > 700
    assert held(spark, checkpoint, "last") <= 16


def test_plateau_shares_slots(spark, tmp_path, runs):
    idle, most = HOUR, 2 * HOUR
    got, checkpoint = drain(spark, tmp_path, runs, lambda s: stateful.plateau_stream(s, 3600, 7200, slots=16))
    rows = sorted((r for run in runs for r in run if r[1] is not None), key=lambda r: (r[1], r[2]))
    want, seen, open_ = [], set(), {}
    for session, ts, _, endpoint in rows:
        if (session, endpoint) in seen:
            continue
        seen.add((session, endpoint))
        start, last, n = open_.get(session, (None, None, 0))
        if start is not None and ts >= min(last + idle, start + most):
            want.append((session, start, min(last + idle, start + most), n))
            start = None
        open_[session] = (ts, ts, 1) if start is None else (start, ts, n + 1)
    passed = rows[-1][1] // 1000 - 600_000
    want += [(s, start, end, n) for s, (start, last, n) in open_.items()
             for end in [min(last + idle, start + most)] if end // 1000 + 1 < passed]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.session, r.start_us, r.end_us, r.endpoints) for r in got) == order(want)
    assert any(s is None for s, *_ in want) and max(n for *_, n in want) > 1
    assert held(spark, checkpoint, "seen") <= 16
