"""Queries that must take all rows and kinds of their tables."""

from wiretally.checks import QUERIES, traffic

SF = "/root/testdata/sf0.001"


def test_wiki_bodies_with_links(spark):
    from wiretally.sources import derived as D

    n = D.table(spark, SF, "documents").filter("doc_id % 8 = 7").count()
    assert QUERIES["wiki_links"](spark, SF).count() == n > 0


def test_previews_and_tokens_of_all_exchanges(spark):
    n = traffic.ex(spark, SF).count()
    for name in ("response_preview", "refreshable_tokens"):
        assert QUERIES[name](spark, SF).count() == n


def test_all_calls_are_rendered_whole(spark):
    rows = QUERIES["render_requests"](spark, SF).collect()
    urls = [r["url"] for r in rows if r["endpoint_id"] == "post-api-users-profile" and r["url"]]
    assert len(rows) == traffic.ex(spark, SF).count() and urls
    assert all("&order_id=" in u and "&session_token=" in u for u in urls)
    assert all("&order_id=" in r["url"] for r in rows if r["endpoint_id"] == "get-api-v1-products" and r["url"])


def test_merge_takes_endpoints_of_one_key(spark):
    rows = QUERIES["merge_catalog"](spark, SF).filter("path = '/graphql'").collect()
    assert rows and len({r["domain"] for r in rows}) == len(rows)


def test_rules_of_a_table_equal_the_columns(spark):
    """Both forms of the framework detectors on pages made of the rules' own texts."""
    import itertools

    from pyspark.sql import functions as F

    from wiretally import constants as K
    from wiretally.functions import pages as G
    from wiretally.operators import registry

    rows = [(None, None), ("", {}), ('"buildId": "b7" /_next/ __NEXT_DATA__', {"X-Powered-By": "Next.js"})]
    for one, two in itertools.combinations(K.FRAMEWORK_RULES, 2):
        html = " ".join(r[4] for r in (one, two) if r[3] == "html")
        rows.append((html, {r[3].title(): (r[4] or "yes").upper() if r[5] else r[4] or "yes" for r in (one, two)
                            if r[3] != "html"}))
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, html string, headers map<string,string>")
    got = {r["n"]: r["frameworks"] for r in registry.detect(pages, ["n"]).collect()}
    want = {r["n"]: r["f"] for r in pages.select("n", G.page_frameworks("html", "headers").alias("f")).collect()}
    assert {n: [tuple(x) for x in f] for n, f in got.items()} == {n: [tuple(x) for x in f or []] for n, f in want.items()}
    assert sum(map(len, got.values())) > 700
    assert registry.detect(pages, ["n"], registry.default_rules(spark).filter(F.lit(False))).filter(
        "size(frameworks) > 0").count() == 0


def test_addresses_with_leading_zeros_are_addresses(spark):
    from pyspark.sql import functions as F

    from wiretally.functions import urls

    zeros = "0" * 60
    hosts = {"127.0.0.1": "127.0.0.1", f"0x{zeros}7f.0.0.1": "127.0.0.1", f"{zeros}177.0.0.1": "127.0.0.1",
             f"0x{zeros}7f000001": "127.0.0.1", f"0x{zeros}a9.0xfe.0{zeros}.0": "169.254.0.0", "0x0.0.0.0": "0.0.0.0",
             "00.00.00.00": "0.0.0.0", "0x1ffffffffffffffff": None, "256.1.1.1": None, "09.1.1.1": None, "0x": None}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.normalize_ipv4("h").alias("ip"))
    assert {r["h"]: r["ip"] for r in rows.collect()} == hosts
    found = spark.createDataFrame([(f"http://{h}/x",) for h in hosts], "u string").select(
        "u", urls.url_safety_reason(F.col("u")).alias("why")).collect()
    assert all(r["why"] for r in found if hosts[r["u"][7:-2]])


def test_pages_of_a_batch_become_python_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from wiretally.operators import registry

    matcher = registry.Matcher([(0, "A", "count", "a", "html", "<main", True), (1, "A", "count", "b", "Server", None, False)])
    pages = [None if i % 100 == 0 else ("<MAIN>" if i % 3 == 0 else "") + "x" * 20_000 for i in range(1_000)]
    headers = [None if i % 7 == 0 else [{"key": "server", "value": "s" if i % 2 else None}] for i in range(1_000)]
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    part = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(pages), pa.array(headers, kind)], names=["n", "html", "h"])
    tracemalloc.start()
    got = []
    for some in registry.matched(matcher, part, ["n", "html", "found"]):
        assert some.column(1).equals(part.column(1).slice(len(got), some.num_rows))
        got += list(zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # all pages together have 20 MB
    want = [(["a"] if i % 3 == 0 and i % 100 else []) + (["b"] if i % 7 and i % 2 else []) for i in range(1_000)]
    assert [n for n, _ in got] == list(range(1_000))
    assert [[s for f in found for s in f["signals"]] for _, found in got] == want
