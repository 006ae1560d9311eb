"""Steps whose work must grow no faster than their input."""

import json

import pytest
from pyspark.sql import functions as F

from wiretally import constants as K
from wiretally.functions import text, urls
from wiretally.operators import sessions, specs
from wiretally.sources import archives
from wiretally.sources import derived as D
from wiretally.sources.exchanges import stream_exchanges
from wiretally.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_is_dealt_to_all_cores(spark):
    """A table of one row group is derived by all cores, not by the task that reads the group."""
    sizes = D._exchanges(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism


def test_windows_are_not_added_up_for_each_row(spark):
    calls = spark.range(4000).select(F.lit(1).alias("key"), F.col("id").alias("seq"), (F.col("id") * 1700 % 5_000_000).alias("ts_us"))
    for df in (sessions.sliding_counts(calls, ["key"], 1000), sessions.rate_limit(calls, 5, 1000)):
        assert "specifiedwindowframe(RangeFrame, -" not in plan(df)
    times = sorted(i * 1700 % 5_000_000 // 1000 for i in range(4000))
    got = {r.ts_ms: (r.calls, r.in_window) for r in sessions.sliding_counts(calls, ["key"], 1000).collect()}
    assert got == {t: (times.count(t), sum(t - 1000 < x <= t for x in times)) for t in set(times)}
    kept, want = [], {}
    for ts, seq in sorted((i * 1700 % 5_000_000, i) for i in range(4000)):
        kept = [t for t in kept if t > ts - 1_000_000]
        want[seq] = len(kept) < 5
        kept += [ts] * want[seq]
    assert {r.seq: r.allowed for r in sessions.rate_limit(calls, 5, 1000).collect()} == want


def test_small_ranges_share_tasks(spark, tmp_path):
    entry = {"startedDateTime": "2024-01-01T00:00:00Z", "request": {"url": "https://a/b"}, "response": {"status": 200}}
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": [entry] * 200}}))
    rows = archives.raw_entries(spark, f"file://{tmp_path}", split_bytes=200)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(r.pos for r in rows.collect()) == list(range(200))


def test_operations_are_worked_out_once(spark):
    raw = '{"openapi":"3.0.0","servers":[{"url":"https://a.b"}],"paths":{"/x":{"get":{"responses":{}}}}}'
    none = '{"openapi":"3.0.0","servers":[{"url":"https://a.b"}],"paths":{}}'
    docs = spark.createDataFrame([(1, "https://s/1", raw), (2, "https://s/2", none)], "spec_id bigint, spec_url string, raw string")
    out = specs.spec_operations(specs.profile_specs(specs.read_specs(docs)))
    assert "size(transform" not in plan(out)
    assert [r.spec_id for r in out.select("spec_id").collect()] == [1]


def test_index_batches_use_all_cores(spark, tmp_path, monkeypatch):
    D._exchanges(spark, SF).drop("kind").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen, real = [], jobs.passive_index.observations
    monkeypatch.setattr(jobs.passive_index, "observations", lambda df: seen.append(df.rdd.getNumPartitions()) or real(df))
    source = stream_exchanges(spark, f"{tmp_path}/in")
    jobs.index_writer(source, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert min(seen) >= spark.sparkContext.defaultParallelism


ODD = [None, "", "http://a", "HTTPS://A.b/c?d#e", "https://u:p@localhost/x", "http://LOCALHOST", "http://localhost.example.com/",
       "http://127.0.0.1:80/", "https://10.1.2.3?x", "https://10.1.2.3.example.com", "http://[::1]/", "chrome://a/b", "ws://a.b/",
       "data:text", "https:///x", "https://a b/", "https://a.b:99x/", "https://a.b/ws", "https://a.b/__webpack/x", "http://0.0.0.0#f",
       "https://x@y@z/", "https://a.b/\n", "http://localhost\n", "https://172.20.0.1", "https://172.32.0.1/"]


def test_allowed_urls_in_one_pass(spark):
    u = F.col("u")
    blocked = F.lit(False)
    for scheme in K.BLOCKED_SCHEMES:
        blocked = blocked | F.lower(u).startswith(scheme)
    rule = (u.isNotNull() & ~blocked & F.coalesce(urls.url_scheme(u).isin("http", "https"), F.lit(False))
            & ~F.coalesce(urls.url_host(u).rlike(K.PRIVATE_HOST_RE), F.lit(True)) & ~u.rlike(K.NOISE_URL_RE))
    rows = spark.createDataFrame([(x,) for x in ODD], "u string").select("u", urls.is_allowed_url("u").alias("got"), rule.alias("want"))
    assert [r.u for r in rows.collect() if r.got != r.want] == []
    assert plan(rows.select("got")).count("RLIKE") == 2


@pytest.mark.parametrize("value, want", [
    (None, (False, "medium", "opaque")), ("short", (False, "medium", "opaque")),
    ("123e4567-e89b-12d3-a456-426614174000", (False, "medium", "opaque")),
    ("Bearer eyJhIjoxfQ.eyJhIjoxfQ.c2ln", (True, "high", "jwt")),
    ("eyJhIjoxfQ.bm90IGpzb24.c2ln", (True, "medium", "opaque")),
    ("aaaabbbbccccdddd", (False, "medium", "opaque"))])
def test_tokens(spark, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(text.classify_token("v").alias("t")).first()["t"]
    assert tuple(got) == want
