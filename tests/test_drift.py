"""Schema summaries against a comparison of every response by itself."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from wiretally.functions import bodies
from wiretally.operators import drift

DEPTH = 5


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string"}.get(type(v), "number")


def plain_diff(a, b, path="", depth=0):
    """Warnings of one response ``b`` against ``a``, by descent."""
    if kind(a) != kind(b):
        more = " (became nullable)" if b is None else ""
        return [("warn", path, f"type changed: {kind(a)} → {kind(b)}{more}")]
    out = []
    if isinstance(a, dict) and depth < DEPTH:
        for k in {**a, **b}:
            at = f"{path}.{k}" if path else k
            if k not in b:
                out.append(("error", at, f"field disappeared: {k} was {kind(a[k])}"))
            elif k not in a:
                out.append(("info", at, f"new field: {k} ({kind(b[k])})"))
            else:
                out += plain_diff(a[k], b[k], at, depth + 1)
    if isinstance(a, list) and a and b:
        out += plain_diff(a[0], b[0], path + "[]", depth + 1)
    return out


def some(rng, depth=0):
    roll = rng.random()
    if depth < 7 and roll < 0.45:
        return {k: some(rng, depth + 1) for k in rng.sample("abc", rng.randint(0, 3))}
    if depth < 7 and roll < 0.6:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 2))]
    return rng.choice([None, True, 1, "x"])


def test_totals_against_plain(spark):
    rng = random.Random(11)
    base = {f"e{i}": some(rng) for i in range(25)}
    base["hot"] = {"a": {"b": 1, "c": [{"a": 1}]}, "b": None}
    sent, want = [], Counter()
    for e, a in base.items():
        for n in range(400 if e == "hot" else 25):
            b = rng.choice([a, some(rng), {**a, "c": some(rng, 1)} if isinstance(a, dict) else some(rng)])
            sent.append(("d", e, n, json.dumps(b)))
            want.update((e, *w) for w in plain_diff(a, b))
    # texts without a schema give no drift
    sent += [("d", "hot", 1, None), ("d", "hot", 1, ""), ("d", "hot", 1, "<html>"), (None, "hot", 1, "{}"), ("d", "unknown", 1, "{}")]
    rows = spark.createDataFrame(sent, "domain string, key string, ts_us bigint, response_body string")
    catalog = spark.createDataFrame([("d", e, json.dumps(a), 0) for e, a in base.items()] + [("d", "bodyless", None, 0)],
                                    "domain string, key string, body string, path int")
    catalog = catalog.withColumn("response_schema", bodies.schema_nodes("body"))
    got = {(r["key"], r["severity"], r["path"], r["message"]): r["responses"] for r in drift.drift_totals(catalog, rows).collect()}
    assert got == dict(want) and len(want) > 100
    versions = drift.schema_drift(catalog, rows).groupBy("key", "severity", "path", "message").agg(F.sum("responses").alias("n"))
    assert {(r["key"], r["severity"], r["path"], r["message"]): r["n"] for r in versions.collect()} == got


def test_id_keys_are_one_path(spark):
    ids = lambda i: [str(i), f"{i:08x}-0000-4000-8000-{i:012x}", f"{i:016x}", f"order-{i:08d}"]
    sent = [("d", "e", i, json.dumps({"m": {k: {"v": "x" if i % 4 == 0 else 1} for k in ids(i)}})) for i in range(1, 401)]
    rows = spark.createDataFrame(sent, "domain string, key string, ts_us bigint, response_body string")
    summary = drift.schema_summary(rows, "response_body", "domain", "key")
    by_path = {(r["path"], r["type"]): (r["responses"], r["present"]) for r in summary.collect()}
    assert by_path == {("", "object"): (400, 400), ("m", "object"): (400, 400), ("m.{id}", "object"): (400, 400),
                       ("m.{id}.v", "number"): (300, 300), ("m.{id}.v", "string"): (100, 100)}
    base = spark.createDataFrame([("d", "e", '{"m":{"77":{"v":1,"w":[]}}}')], "domain string, key string, b string")
    base = base.withColumn("response_schema", bodies.schema_nodes("b"))
    got = {(r["severity"], r["path"], r["message"], r["responses"], r["first_us"], r["last_us"]) for r in drift.drift_totals(base, rows).collect()}
    assert got == {("warn", "m.{id}.v", "type changed: number → string", 100, 4, 400),
                   ("error", "m.{id}.w", "field disappeared: w was array", 400, None, None)}


def test_types_of_one_response_count_its_path_once(spark):
    sent = [("e", 5, '{"m":{"1":{"v":1},"2":{"v":"x"},"3":{}}}'), ("e", 9, '{"m":{"1":{}}}')]
    rows = spark.createDataFrame(sent, "key string, ts_us bigint, b string")
    summary = drift.schema_summary(rows, "b", "key")
    v = {r["type"]: (r["responses"], r["present"]) for r in summary.filter("path = 'm.{id}.v'").collect()}
    assert v == {"number": (1, 1), "string": (1, 0)}
    base = rows.limit(1).select("key", bodies.schema_nodes("b").alias("nodes"))
    got = [(r["severity"], r["path"], r["message"], r["responses"], r["last_us"]) for r in drift.summary_drift(base, summary, "key").collect()]
    assert got == [("error", "m.{id}.v", "field disappeared: v was number or string", 1, 5)]


def test_summaries_merge(spark):
    rng = random.Random(3)
    sent = [(f"e{i % 3}", i, json.dumps(some(rng))) for i in range(200)]
    whole = spark.createDataFrame(sent, "key string, ts_us bigint, b string")
    parts = [drift.schema_summary(whole.filter(f"ts_us % 2 = {k}"), "b", "key") for k in (0, 1)]
    both = drift.merge_summaries(*parts, "key")
    want = drift.schema_summary(whole, "b", "key")
    assert sorted(map(str, both.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert drift.schema_summary(whole.filter("false"), "b", "key").count() == 0


def test_the_baseline_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    base = spark.createDataFrame([("d", "e", '{"a":1,"b":{"c":[]},"x":[null]}')], "domain string, key string, b string")
    base = base.mapInArrow(count, base.schema).withColumn("response_schema", bodies.schema_nodes("b"))
    rows = spark.createDataFrame([("d", "e", 1, '{"a":"s","b":{"c":[[]]},"n":0,"x":[1]}')], "domain string, key string, ts_us bigint, response_body string")
    got = {(r["severity"], r["path"], r["message"]) for r in drift.drift_totals(base, rows).collect()}
    assert got == {("warn", "a", "type changed: number → string"), ("info", "n", "new field: n (number)"),
                   ("warn", "x[]", "type changed: null → number")}
    assert made.value == 1
