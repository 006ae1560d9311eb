import itertools
import random
import re

import numpy as np
import xxhash
from odd_documents import ODD
from pyspark.sql import functions as F

from wiretally.llm import simhash
from wiretally.llm.components import components


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    sums = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            sums[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(parts))


def plain_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_three_positions_leave_one_posting_set():
    assert len(simhash.POSTINGS) == 14
    for three in itertools.combinations(range(8), 3):
        assert any(not set(three) & set(s) for s in simhash.POSTINGS)


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", "  \n", "One", "one TWO", "ÀB c d\x1fe f", "a b c " * 50, *(" ".join(
        rng.choice(["A", "bb", "ccc", "é"]) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    got = simhash.fingerprints([t.encode() for t in texts])
    assert [int(x) & (1 << 64) - 1 for x in got] == [plain_fingerprint(t) for t in texts]


def near_prints(seed, n=120):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):  # chains of links
            out.append(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    return sorted(set(out))


def test_links_join_what_all_links_join(spark, monkeypatch):
    nodes = near_prints(2)
    want = plain_roots([signed(x) for x in nodes], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    fps = spark.createDataFrame([(signed(x),) for x in nodes], "fp bigint")
    for block in (2048, 3):  # 3: lists are cut into blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        links = [tuple(r) for r in simhash.links(fps).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
        pairs = {frozenset(x) for x in links}
        assert plain_roots(list(want), lambda a, b, pairs=pairs: frozenset((a, b)) in pairs) == want


def test_long_lists_are_compared_whole(spark):
    rng = random.Random(3)
    nodes = sorted({signed(0xABCD << 48 | rng.getrandbits(14)) for _ in range(400)})
    want = plain_roots(nodes, lambda a, b: (a ^ b).bit_count() <= 3)
    links = simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp bigint"))
    pairs = {frozenset(r) for r in links.collect()}
    assert plain_roots(nodes, lambda a, b: frozenset((a, b)) in pairs) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 130)}, 200: 199}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_classes_of_odd_rows(spark, odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    prints = {plain_fingerprint(t) for _, t, *_ in ODD}
    roots = plain_roots(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t, *_ in ODD:
        r = roots[plain_fingerprint(t)]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), signed(plain_fingerprint(t)), str(least.get(roots[plain_fingerprint(t)]))) for i, t, *_ in ODD)
    assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in rows) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_document_of_each_class_stays(spark, odd, nothing):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    roots = plain_roots(sorted({plain_fingerprint(t) for _, t, *_ in ODD}), lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(roots[plain_fingerprint(r["text"])] for r in rows) == sorted(set(roots.values()))
    assert kept.filter("doc_id is null").count() == 2  # two classes have no id at all
    assert all(r["score"] == f"score-{r['doc_id']}" for r in rows)
    assert simhash.deduplicated(nothing).count() == 0


def test_query(spark):
    from wiretally.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    ids, values = list(prints), np.array(list(prints.values()), np.uint64)
    linked = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(
        np.bitwise_count(values ^ values[i]) <= 3)}
    roots = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if roots[b] < roots[a]:
                roots[a], changed = roots[b], True
    rows = QUERIES["op7_simhash_postings"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted((i, f"{prints[i]:016x}", roots[i]) for i in ids)
    assert QUERIES["op7_simhash_postings"](spark, sf).select(F.length("fingerprint").alias("n")).distinct().collect()[0]["n"] == 16
