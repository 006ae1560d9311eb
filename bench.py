"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The derived input tables are landed first and not timed, as logs are landed before a job reads them.
Every query is run to its last row through Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "filter_traffic", "endpoint_catalog", "body_diff", "catalog_with_variables", "domain_counters",
    "passive_index", "schema_drift", "truncate_responses", "merge_catalog", "search_catalog",
    "list_catalog", "token_savings", "inspect_summary", "read_pages", "savings_vs_html",
    "page_frameworks", "site_discovery", "scrub_documents", "pii_by_source", "classify_tokens",
    "spec_operations", "import_specs", "forum_posts", "normalise_payloads", "render_requests",
    "pick_endpoints", "idle_gaps", "sliding_counts", "rate_limit", "stream_index", "stream_pairing",
]


def main() -> None:
    from wiretally.checks import QUERIES
    from wiretally.checks.catalog import endpoints, searched
    from wiretally.checks.timeline import events
    from wiretally.session import build_session
    from wiretally.sources import derived

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "wiretally-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    only = set(sys.argv[1:])
    for land in (derived.exchanges, derived.page_responses, derived.specs, derived.directories,
                 endpoints, searched, events):
        land(spark, sf)
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
