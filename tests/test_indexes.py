"""Postings, joins on contained texts, and the index of a stream over time."""

import random

import pytest
from pyspark.sql import functions as F

from wiretally.functions.grams import containing, grams
from wiretally.operators import requests, search_index
from wiretally.operators.catalog import bucket
from wiretally.sources.exchanges import EXCHANGE_SCHEMA, stream_exchanges
from wiretally.streaming import jobs


def endpoints(spark, rows):
    return spark.createDataFrame(rows, "domain string, id string, method string, path string, tier string, verified boolean")


def random_endpoints(seed, n):
    rng = random.Random(seed)
    words = ["users", "orders", "v1", "v2", "x", "é", "a b", "ORDERS"]
    return [(f"d{rng.randrange(4)}.example.com", f"id-{rng.choice(words)}-{i % 50}", rng.choice(["GET", "POST", None]),
             rng.choice([None, "/" + "/".join(rng.choices(words, k=3))]), None, None) for i in range(n)]


def plain_search(rows, query):
    out = []
    for domain, id_, method, path, *_ in rows:
        shown = (domain, id_ or "", method or "GET", path or "/")
        text = " ".join((shown[0], shown[1], shown[3], shown[2])).lower()
        if all(t in text for t in query.lower().split()):
            out.append((*shown, "unknown", False))
    return sorted(out)


QUERIES = ["orders", "ORDERS post", "v2", "x", "é", "/", "d1 users", "nothing here", "", "id-orders-7 get", "a b"]


def test_search_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(search_index, "SLICE", 64)  # several slices per domain
    rows = random_endpoints(1, 800)
    index = search_index.build_search_index(endpoints(spark, rows))
    for query in QUERIES:
        assert sorted(map(tuple, search_index.search(index, query).collect())) == plain_search(rows, query), query


def test_saved_index_is_replaced_by_domain(spark, tmp_path):
    folder, rows = str(tmp_path / "index"), random_endpoints(2, 300)
    search_index.save_search_index(search_index.build_search_index(endpoints(spark, rows), 4), folder)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "index" / "entries").glob("bucket=*/*.parquet")}
    new = [("d1.example.com", "fresh", "PUT", "/new/orders", None, None)]
    search_index.replace_in_search_index(spark, folder, endpoints(spark, new), endpoints(spark, new), 4)
    gone = spark.createDataFrame([("d2.example.com",), ("never.example.com",)], "domain string")
    search_index.replace_in_search_index(spark, folder, gone, buckets=4)
    want = [r for r in rows if r[0] not in ("d1.example.com", "d2.example.com")] + new
    index = search_index.open_search_index(spark, folder)
    for query in QUERIES:
        assert sorted(map(tuple, search_index.search(index, query).collect())) == plain_search(want, query), query
    touched = {r["b"] for r in gone.unionByName(endpoints(spark, new).select("domain")).select(
        bucket("domain", 4).alias("b")).collect()}
    kept = {f.name for f in (tmp_path / "index" / "entries").glob("bucket=*/*.parquet")
            if int(f.parent.name[7:]) not in touched}
    assert kept <= set(before)


def test_search_reads_the_grams_of_its_terms_only(spark, tmp_path):
    folder = str(tmp_path / "index")
    search_index.save_search_index(search_index.build_search_index(endpoints(spark, random_endpoints(3, 100)), 2), folder)
    plan = search_index.search(search_index.open_search_index(spark, folder), "orders")._jdf.queryExecution().toString()
    assert "In(gram, [der,ers,ord,rde])" in plan


def test_grams(spark):
    row = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("é😀x",)], "t string")
    assert [r[0] for r in row.select(grams(F.col("t"))).collect()] == [["abc", "bca", "cab"], [], [], [], ["é😀x"]]


@pytest.mark.parametrize("seed", range(3))
def test_containing_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab/", k=rng.randrange(0, 9))) for _ in range(120)]
    texts += [t * 3 + rng.choice(["", "x"]) for t in texts[50:70]]
    needles = sorted({(rng.randrange(3), t) for t in texts[::2]})
    stacks = sorted({(rng.randrange(3), t + u) for t in texts[1::2] for u in ("", "b/a")} | {(0, None)}, key=str)
    found = containing(spark.createDataFrame(needles, "g int, needle string"),
                       spark.createDataFrame(stacks, "g int, haystack string"), "g")
    assert sorted(map(tuple, found.collect())) == sorted(
        (g, n, h) for g, n in needles for k, h in stacks if g == k and h is not None and n in h)


def test_overlap_grows_with_its_matches(spark, tmp_path):
    """10,000 endpoints and as many paths of one domain: the joins give what overlaps and nothing else."""
    n = 10_000
    spark.range(n).select(
        F.concat(F.lit("d"), F.col("id") * 0).alias("domain"), F.concat(F.lit("/orders/k"), "id", F.lit("/z")).alias("path"),
        F.concat(F.lit("/orders/k"), "id", F.lit("/z/:id")).alias("template")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = requests.overlapping(rows.select("domain", "path"), rows.select("domain", "template"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Inner, Contains" not in plan
    assert found.count() == n and found.filter("not startswith(template, path)").count() == 0


def exchange(i, day, host):
    us = day * 86_400_000_000 + i * 1000
    return (i, None, us, 1, i, f"https://{host}/api/v1/things", "GET", {"accept": "application/json"}, None, 200,
            "application/json", {}, '{"a":1}', False)


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, EXCHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_an_idle_domain_leaves_state_and_index(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")

    def step(rows):
        land(spark, source, "x", rows)
        drain(jobs.index_writer(stream_exchanges(spark, source), folder, str(tmp_path / "cp1")))
        query = drain(jobs.expiry_writer(stream_exchanges(spark, source), folder, str(tmp_path / "cp2"), "180 days"))
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
        return state, {r["domain"]: r["hits"] for r in jobs.read_index(spark, folder).collect()}

    state, index = step([exchange(1, 10, "idle.example.com"), exchange(2, 10, "busy.example.com"),
                         exchange(3, 12, "idle.example.com")])
    assert index == {"idle.example.com": 2, "busy.example.com": 1}
    state, index = step([exchange(4, 150, "busy.example.com")])
    assert state == 2 and index == {"idle.example.com": 2, "busy.example.com": 2}
    jobs.compact_index(spark, folder)
    state, index = step([exchange(5, 300, "busy.example.com")])
    assert state == 1 and index == {"busy.example.com": 3}
    jobs.compact_index(spark, folder, 300 * 86_400_000_000)
    state, index = step([exchange(6, 301, "idle.example.com")])  # it comes back: what it did before stays forgotten
    assert state == 2 and index == {"busy.example.com": 3, "idle.example.com": 1}
    for day in (302, 303):
        jobs.compact_index(spark, folder)
        land(spark, source, "x", [exchange(day, day, "busy.example.com")])
        drain(jobs.index_writer(stream_exchanges(spark, source), folder, str(tmp_path / "cp1")))
    jobs.compact_index(spark, folder)
    assert {r["domain"]: r["hits"] for r in jobs.read_index(spark, folder).collect()} == {
        "busy.example.com": 5, "idle.example.com": 1}
    generations = [p.name for p in (tmp_path / "index" / "generations").iterdir()]
    deltas = [p.name for p in (tmp_path / "index" / "deltas").iterdir() if "=" in p.name]
    assert len(generations) == 2 and len(deltas) == 1  # the newest, the one before, and the delta between them


def test_a_reader_keeps_its_generation_over_a_compaction(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")
    for day in (1, 2, 3):
        land(spark, source, "x", [exchange(day, day, "a.example.com")])
        drain(jobs.index_writer(stream_exchanges(spark, source), folder, str(tmp_path / "cp")))
        reader = jobs.read_index(spark, folder)
        jobs.compact_index(spark, folder)
        assert [r["hits"] for r in reader.collect()] == [day]


def test_first_sightings_forget(spark, tmp_path):
    """Sessions count endpoints that are new; after the time to forget an endpoint is new again."""
    from wiretally.streaming import stateful

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day in (1, 2, 30, 60, 61):
        land(spark, source, "x", [exchange(day, day, "a.example.com"), exchange(day + 500, day, "a.example.com")])
        stream = jobs.session_stream(stream_exchanges(spark, source), 60, forget_s=20 * 86_400)
        jobs.run_available(stream, out, str(tmp_path / "cp"))
    rows = spark.read.parquet(out).collect()
    assert sorted((r["start_us"] // 86_400_000_000, r["endpoints"]) for r in rows) == [(1, 1), (30, 1), (60, 1)]
