import itertools
import random

import pytest
from odd_documents import ODD

from wiretally.llm import packing


def padding(histogram, edges):
    return sum(n * (min(e for e in edges if e >= length) - length) for length, n in histogram)


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 8))
        histogram = [(x, rng.randint(1, 9)) for x in lengths]
        k = rng.randint(1, 5)
        edges = packing.boundaries(histogram, k)
        assert len(edges) == min(k, len(lengths)) and edges == sorted(edges)
        best = min(padding(histogram, (*c, max(lengths)))
                   for c in itertools.combinations(sorted(lengths)[:-1], len(edges) - 1))
        assert padding(histogram, edges) == best
    assert packing.boundaries([], 3) == []


def check(rows, docs, max_len, budget):
    pieces = {}
    for r in rows:
        assert 0 <= r["n_tokens"] <= r["boundary"] <= max_len
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
    want = {}
    for i, text, *_ in docs:
        n = len((text or "").split())
        for p in range(max(1, -(-n // max_len))):
            want.setdefault(i, []).append((p, min(n - p * max_len, max_len)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    seats = {}
    for r in rows:
        seats.setdefault((r["bucket"], r["batch"], r["boundary"]), []).append(r["slot"])
    for (bucket, batch, boundary), slots in seats.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * boundary <= budget
        later = [b for k, b, _ in seats if k == bucket and b > batch]
        assert not later or len(slots) == budget // boundary  # only the last batch of a bucket is not full


def test_odd_rows(odd):
    rows = packing.pack(odd, max_len=100, budget=400, n_buckets=3).collect()
    check(rows, ODD, 100, 400)


def test_places_do_not_depend_on_the_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 7)) for i in range(500)], "doc_id bigint, text string")
    whole = sorted(packing.pack(docs, max_len=8, budget=32, n_buckets=2).collect())
    monkeypatch.setattr(packing, "SLICE", 10)
    assert sorted(packing.pack(docs, max_len=8, budget=32, n_buckets=2).collect()) == whole


def test_texts_of_the_pieces(spark):
    docs = spark.createDataFrame([(1, "a  b\nc d\te"), (2, ""), (3, None)], "doc_id bigint, text string")
    rows = packing.pack(docs, max_len=2, budget=4, texts=True).collect()
    assert sorted((r["doc_id"], r["piece"], r["text"]) for r in rows) == [
        (1, 0, "a  b"), (1, 1, "\nc d"), (1, 2, "\te"), (2, 0, ""), (3, 0, "")]


def test_empty_table_and_bad_limits(nothing):
    assert packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, max_len=10, budget=5)
