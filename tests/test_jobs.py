"""Jobs against brute force on small tables, streams against their batch rule."""

import json
import random

from pyspark.sql import functions as F

from wiretally.operators import drift, merge, sessions, specs, traffic
from wiretally.session import state_folder
from wiretally.streaming import jobs, stateful


def diff(a, b, prefix, out):
    """Brute-force comparison of two JSON values."""
    kind = lambda x: "list" if isinstance(x, list) else "object" if isinstance(x, dict) or x is None else type(x).__name__
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if (num(a) != num(b)) or (not num(a) and kind(a) != kind(b)):
        if prefix:
            out.add(prefix)
    elif isinstance(a, list):
        if len(a) != len(b):
            if prefix:
                out.add(prefix)
        else:
            for i, (x, y) in enumerate(zip(a, b)):
                diff(x, y, f"{prefix}[{i}]", out)
    elif isinstance(a, dict) and isinstance(b, dict):
        for k in set(a) | set(b):
            path = f"{prefix}.{k}" if prefix else k
            if k not in a or k not in b:
                out.add(path)
            else:
                diff(a[k], b[k], path, out)
    elif a != b and prefix:
        out.add(prefix)


def random_json(rng, depth=0):
    pick = rng.random()
    if depth < 3 and pick < 0.35:
        return {k: random_json(rng, depth + 1) for k in rng.sample("abc", rng.randint(0, 3))}
    if depth < 3 and pick < 0.5:
        return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2, "x", "y", None, True, 1.5])


def test_body_diff_matches_brute_force(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for g in range(60):
        docs = [{"a": random_json(rng), "b": random_json(rng)} for _ in range(rng.randint(1, 5))]
        for i, d in enumerate(docs):
            rows.append((f"d{g}", "POST /x", i, i, "POST", json.dumps(d), False))
        out = set()
        for d in docs[1:]:
            diff(docs[0], d, "", out)
        want |= {(f"d{g}", p) for p in out}
    df = spark.createDataFrame(
        rows, "domain string, key string, ts_us bigint, seq bigint, method string, request_body string, body_missing boolean"
    ).withColumn("ord", traffic.ordinal("ts_us", "seq"))
    got = {(r.domain, r.path) for r in traffic.body_diff(df).collect()}
    assert got == want and want


def test_form_bodies(spark):
    rows = [("d", "POST /x", i, i, "POST", b, False) for i, b in enumerate(
        ["cursor=a&q=1&name=J+D", "cursor=b&q=1&name=J%20D"])]
    rows += [("e", "POST /x", i, i, "POST", b, False) for i, b in enumerate(["a=1", "plain"])]
    df = spark.createDataFrame(
        rows, "domain string, key string, ts_us bigint, seq bigint, method string, request_body string, body_missing boolean"
    ).withColumn("ord", traffic.ordinal("ts_us", "seq"))
    assert [(r.domain, r.path) for r in traffic.body_diff(df).collect()] == [("d", "cursor")]


def test_schema_diff(spark):
    def rows(body):
        return drift.schema_rows(spark.createDataFrame([("e", body)], "endpoint string, b string"), "b", "endpoint")

    def run(a, b):
        return {(r.severity, r.path, r.message) for r in drift.schema_diff(rows(a), rows(b), "endpoint").collect()}

    assert run('{"id":1}', '{"id":2}') == set()
    assert run('{"id":1,"name":"x"}', '{"id":2}') == {("error", "name", "field disappeared: name was string")}
    assert run('{"id":1}', '{"id":2,"n":[]}') == {("info", "n", "new field: n (array)")}
    assert run('{"a":{"b":1}}', '{"a":[1]}') == {("warn", "a", "type changed: object → array")}
    assert run('{"a":1}', '{"a":null}') == {("warn", "a", "type changed: number → null (became nullable)")}
    assert run('[{"a":1}]', '[{"a":"x"}]') == {("warn", "[].a", "type changed: number → string")}
    assert run('[]', '[{"a":"x"}]') == set()


def limiter(calls, limit, window):
    kept, flags = [], {}
    for ts, seq in sorted(calls):
        kept = [t for t in kept if t > ts - window]
        flags[seq] = len(kept) < limit
        if flags[seq]:
            kept.append(ts)
    return flags


def make_calls(spark, seed=3, n=600):
    rng = random.Random(seed)
    calls = {k: sorted((rng.randint(0, 40_000_000 if k else 2_000_000), k * 1000 + i) for i in range(n)) for k in (0, 1)}
    rows = [(k, s, t) for k, cs in calls.items() for t, s in cs]
    want = {s: ok for cs in calls.values() for s, ok in limiter(cs, 5, 1_000_000).items()}
    return spark.createDataFrame(rows, "key bigint, seq bigint, ts_us bigint"), want


def test_rate_limit(spark):
    calls, want = make_calls(spark)
    got = {r.seq: r.allowed for r in sessions.rate_limit(calls, 5, 1000).collect()}
    assert got == want and not all(want.values())


def stream_of(spark, df, name, files=1):
    folder = state_folder(spark, name)
    df.coalesce(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def finish(spark, df, name):
    out = state_folder(spark, name)
    jobs.run_available(df, out, state_folder(spark, name + "-cp"))
    return spark.read.parquet(out).collect()


def test_stateful_streams(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    calls, want = make_calls(spark)
    got = finish(spark, stateful.limit_stream(stream_of(spark, calls, "calls"), 5, 1000), "limited")
    assert {r.seq: r.allowed for r in got} == want

    s = 1_000_000
    times = [0, 5 * s, 9 * s, 30 * s, 200 * s] + [300 * s + i * 8 * s for i in range(20)]
    base = 1_000_000 * s
    rows = [(1, base + t, i, f"e{i}") for i, t in enumerate(times)]
    rows += [(1, ts + 3 * s, i + 100, endpoint) for _, ts, i, endpoint in rows]  # known endpoints change nothing
    news = spark.createDataFrame(rows, "session bigint, ts_us bigint, seq bigint, endpoint string")
    out = finish(spark, stateful.plateau_stream(jobs.event_time(stream_of(spark, news, "news"), "0 seconds"), 10, 120), "plateau")
    ends = {((r.start_us - base) // s, (r.end_us - base) // s, r.endpoints) for r in out}
    assert {(0, 19, 3), (30, 40, 1), (200, 210, 1), (300, 420, 15)} <= ends

    m = 60 * s
    obs = spark.createDataFrame(
        [("d", t, i, t > 100 * m) for i, t in enumerate([0, m, 2 * m, 3 * m, 20 * m, 33 * m, 64 * m, 101 * m, 200 * m])],
        "domain string, ts_us bigint, seq bigint, promoted boolean")
    tries = finish(spark, stateful.promotion_stream(stream_of(spark, obs, "obs"), 3), "promote")
    assert sorted(r.attempt_us // m for r in tries) == [2, 33, 64]


def endpoint(**kw):
    base = dict(domain="a.com", method="GET", path="/x", pos=1, query_params={}, response_type="object",
                response_fields=None, confidence=None, provenance=None, spec_source=None, description=None)
    return {**base, **kw}


SCHEMA = ("domain string, method string, path string, pos bigint, query_params " + merge.PARAMS + ", response_type string, "
          "response_fields array<string>, confidence double, provenance string, spec_source string, description string")


def test_merge_rules(spark):
    p = lambda **kw: dict(dict(type="string", example="", required=None, enum=None, from_spec=True), **kw)
    old = [endpoint(path="/same"), endpoint(path="/u/:id", query_params={"q": p(example="1", from_spec=None)}),
           endpoint(path="/done", spec_source="s", description="d"),
           endpoint(path="/sk", provenance="skeleton", confidence=0.8, response_type="unknown")]
    new = [endpoint(path="/u/:name", pos=1, query_params={"q": p(type="integer", enum=["1"])}, confidence=0.7),
           endpoint(path="/done", spec_source="s2", description="d2"),
           endpoint(path="/sk", response_type="array", response_fields=["id"], confidence=0.6),
           endpoint(path="/new", confidence=0.6, provenance="openapi-import"), endpoint(path="/new", pos=2, description="last")]
    got = {r.path: r for r in merge.merge_catalog(
        spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()}
    assert {k: r.action for k, r in got.items()} == {
        "/same": "preserved", "/u/:id": "enriched", "/done": "skipped", "/sk": "enriched", "/new": "added"}
    q = got["/u/:id"].query_params["q"]
    assert (q.type, q.example, q.enum, q.from_spec, got["/u/:id"].confidence) == ("integer", "1", ["1"], True, 0.7)
    assert (got["/sk"].response_type, got["/sk"].confidence, got["/sk"].provenance) == ("array", 0.8, "skeleton")
    assert got["/new"].description == "last" and got["/done"].description == "d"


def test_references(spark):
    doc = {"openapi": "3.0.0", "paths": {"/a": {"get": {"responses": {"200": {"$ref": "#/components/responses/R"}}},
           "post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Loop"}}}},
                    "responses": {"2XX": {"content": {"application/json": {"schema": {"anyOf": [{"$ref": "#/components/schemas/All"}]}}}}}}}},
           "components": {"responses": {"R": {"content": {"application/json": {"schema": {"$ref": "other.json#/x"}}}}},
                          "schemas": {"Loop": {"$ref": "#/components/schemas/Loop"},
                                      "All": {"allOf": [{"properties": {"a": {}}}, {"$ref": "#/components/schemas/In"}]},
                                      "In": {"allOf": [{"properties": {"b": {}}}, {"$ref": "#/components/schemas/All"}]}}}}
    df = spark.createDataFrame([(1, "https://h.example.org/s.json", json.dumps(doc))], "spec_id int, spec_url string, raw string")
    out = {r.method: r for r in specs.spec_operations(specs.profile_specs(specs.read_specs(df))).collect()}
    assert (out["GET"].response_type, out["GET"].response_fields) == ("unknown", None)
    assert (out["POST"].response_type, out["POST"].response_fields) == ("object", ["a", "b"])
    assert out["POST"].domain == "h.example.org" and out["POST"].request_body is None


def test_skewed_previous_time(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.9 else 1, rng.randint(0, 10_000)) for _ in range(3000)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "k int, t bigint")
    got = {(r.k, r.t): r.prev_us for r in sessions.previous_time(df, ["k"], "t", 97).collect()}
    want, last = {}, {}
    for k, t in rows:
        want[(k, t)] = last.get(k)
        last[k] = t
    assert got == want


def test_time_zone_does_not_matter(spark):
    from wiretally.sources import derived

    sf = "/root/testdata/sf0.001"
    a = derived.exchanges(spark, sf).agg(F.sum("ts_us")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert derived._exchanges(spark, sf).agg(F.sum("ts_us")).first()[0] == a
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_two_archives_keep_their_rows_apart(spark, tmp_path):
    import json

    from wiretally.operators import traffic
    from wiretally.sources.archives import read_archives
    from wiretally.sources.exchanges import EXCHANGE_SCHEMA

    def entry(i, host):
        return {
            "startedDateTime": f"2024-01-01T00:00:0{i}.250Z",
            "request": {"url": f"https://{host}/api/v1/things", "method": "GET",
                        "headers": [{"name": "Accept", "value": "application/json"}]},
            "response": {"status": 200, "headers": [{"name": "Content-Type", "value": "application/json"}],
                         "content": {"mimeType": "application/json", "text": f'{{"id":{i}}}'}}}

    for n, host in enumerate(("a.example.com", "b.example.com")):
        (tmp_path / f"{n}.har").write_text(json.dumps({"log": {"entries": [entry(i, host) for i in range(3)]}}))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        rows = read_archives(spark, str(tmp_path))
        assert rows.schema.names == EXCHANGE_SCHEMA.names
        got = rows.collect()
        assert len({r["seq"] for r in got}) == 6 and len({r["session"] for r in got}) == 2
        assert {str(r["ts"]) for r in got} == {f"2024-01-01 00:00:0{i}.250000" for i in range(3)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    made = traffic.build_endpoints(traffic.accepted(rows)).collect()
    assert sorted((r["domain"], r["hits"]) for r in made) == [("a.example.com", 3), ("b.example.com", 3)]
    first = traffic.first_occurrence(traffic.with_keys(traffic.accepted(rows))).filter("is_new").count()
    assert first == 2


def test_cut_bytes_never_splits_a_character(value):
    from pyspark.sql import functions as F

    from wiretally.sources.exchanges import cut_bytes

    for text in ("plain text", "ä" * 9, "a" + "ä" * 9, "汉字汉字", "x😀😀😀", "é" + "汉" * 3 + "😀z"):
        raw = text.encode()
        for limit in range(1, len(raw) + 2):
            want = raw[:limit].decode(errors="ignore")
            assert value(cut_bytes(F.col("t"), limit), t=text) == want, (text, limit)


def test_map_order_does_not_change_a_fingerprint(spark):
    from wiretally.operators.catalog import catalog_fingerprint

    def print_of(a, b, path="/x"):
        df = spark.sql(f"select 'd' as domain, 'captured' as provenance, '{path}' as path, map('{a}', 1, '{b}', 2) as m")
        if (a, b) != ("p", "q"):
            df = spark.sql(f"select 'd' as domain, 'captured' as provenance, '{path}' as path, map('{a}', 2, '{b}', 1) as m")
        return catalog_fingerprint(df).first()["fingerprint"]

    assert print_of("p", "q") == print_of("q", "p") != print_of("p", "q", "/y")


def test_landed_alone_removes_what_led_to_it(spark):
    import os

    from wiretally.session import checkpoint_root, landed, landed_alone

    def make():
        one = landed(spark.range(10), "alone-step")
        two = landed_alone(spark, lambda: landed(one, "alone-inner").filter("id > 3"), "alone-nested")
        return two.filter("id < 8")

    found = landed_alone(spark, make, "alone-result")
    assert sorted(r["id"] for r in found.collect()) == [4, 5, 6, 7]
    left = {n.rsplit("-", 1)[0] for n in os.listdir(checkpoint_root(spark)) if n.startswith("alone-")}
    assert left == {"alone-result"}
