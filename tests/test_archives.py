import json
import random

import pytest
from pyspark.sql import functions as F

from wiretally.sources import archives


def nasty(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choice('{}[]"\\,:a é😀\n') for _ in range(rng.randrange(12)))
    if kind == 1:
        return rng.choice([None, True, 3, -1.5e9, '"entries": [{', "\\", '\\"', "entries"])
    if kind <= 3:
        return "plain"
    if kind <= 5:
        return {nasty(rng, 9) if rng.random() < 0.2 else f"k{i}": nasty(rng, depth + 1) for i in range(rng.randrange(4))}
    return [nasty(rng, depth + 1) for _ in range(rng.randrange(4))]


def document(seed):
    rng = random.Random(seed)
    entries = [{"n": i, "x": nasty(rng), "entries": [{"a": nasty(rng)}]} for i in range(rng.choice([0, 1, 7, 40]))]
    entries = json.loads(json.dumps(entries))
    log = {"version": "1.2", "pages": [{"title": nasty(rng)}, {"entries": [{}, {}]}], "creator": {"entries": [{"b": 1}]}}
    items = [*log.items(), ("entries", entries)]
    rng.shuffle(items)
    text = json.dumps({"log": {str(k): v for k, v in items}}, ensure_ascii=rng.random() < 0.5,
                      indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":"), (" , ", " : ")]))
    return text.encode(), entries


@pytest.mark.parametrize("seed", range(60))
def test_ranges_hold_all_entries(seed):
    data, entries = document(seed)
    for block in (1, 3, 17, 1 << 20):
        for split in (1, 100, 1 << 20):
            planner = archives.Planner(split)
            for at in range(0, len(data), block):
                planner.feed(data[at:at + block])
            got = []
            for start, end, first in planner.done():
                assert first == len(got)
                got += [json.loads(raw) for raw in archives.entries_of(data[start:end])]
            assert got == entries
            assert split > 1 or len(planner.ranges) == len(entries)


def test_a_document_that_is_cut_off_keeps_its_whole_entries():
    data = json.dumps({"log": {"entries": [{"n": i} for i in range(50)]}}).encode()
    planner = archives.Planner(64)
    planner.feed(data[:-300])
    got = [json.loads(raw)["n"] for a, b, _ in planner.done() for raw in archives.entries_of(data[:-300][a:b])]
    assert got == list(range(len(got))) and 20 < len(got) < 50


def test_several_tasks_read_one_file(spark, tmp_path):
    def entry(i):
        return {"startedDateTime": f"2024-01-01T00:00:{i % 60:02}.5Z",
                "request": {"url": f"https://h.example.com/{i}", "method": "GET", "headers": [{"name": "A", "value": "1"},
                                                                                               {"name": "a", "value": "2"}]},
                "response": {"status": 200, "content": {"mimeType": "application/json", "text": '{"x":"' + "y" * 500}}}

    for name, n in (("b.har", 300), ("a.har", 200), ("empty.har", 0)):
        (tmp_path / name).write_text(json.dumps({"log": {"entries": [entry(i) for i in range(n)]}}))
    planned = archives.ranges(spark, str(tmp_path), 20_000).groupBy("file").count().collect()
    assert len(planned) == 2 and all(r["count"] > 3 for r in planned)
    raw = archives.raw_entries(spark, str(tmp_path), 20_000)
    assert raw.withColumn("task", F.spark_partition_id()).filter("file = 1").select("task").distinct().count() > 1
    rows = archives.read_archives(spark, str(tmp_path), 20_000).collect()
    assert sorted(r["seq"] for r in rows) == [*range(200), *range(1 << 32, (1 << 32) + 300)]
    assert all(r["url"].endswith(f"/{r['request_id']}") and r["request_headers"] == {"a": "2"} for r in rows)
    assert all(r["response_headers"] == {} and r["session"] == r["seq"] >> 32 for r in rows)


def test_no_archives(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).count() == 0
