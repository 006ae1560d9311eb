import collections
import random

import numpy as np
import pytest
from odd_documents import ODD
from test_simhash import plain_fingerprint, plain_roots

import corpus_pipeline
from wiretally.llm import nearcopies, simhash

STAGE = dict(corpus_pipeline.STAGES)["near_duplicates"]


def plain_set(text):
    words = (text or "").lower().split()  # ASCII texts only
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(rows, linked_sets):
    """The ids that stay, by all pairs."""
    prints = simhash.fingerprints([(t or "").encode() for _, t in rows]).view(np.uint64)
    near = {(i, j) for i in range(len(rows)) for j in (i + 1 + np.flatnonzero(
        np.bitwise_count(prints[i + 1:] ^ prints[i]) <= 3)).tolist()}
    roots = plain_roots(range(len(rows)), lambda i, j: (i, j) in near or (i, j) in linked_sets)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[roots[i]] = min(doc_id, least.get(roots[i], doc_id))
    return sorted(least.values())


def pairs_of(sets):
    """Similarity of all pairs that share a shingle."""
    at, both = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for found in at.values():
        both.update((i, j) for n, j in enumerate(found) for i in found[:n])
    return {p: c / (len(sets[p[0]]) + len(sets[p[1]]) - c) for p, c in both.items()}


def test_stage_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = pairs_of([set(simhash.hashes((t or "").encode(), 5)) for _, t in rows])
    linked = {p for p, s in found.items() if s >= 0.8}
    prints = simhash.fingerprints([(t or "").encode() for _, t in rows]).view(np.uint64)
    assert any(int(prints[i] ^ prints[j]).bit_count() > 3 for i, j in linked)  # not found by the fingerprints
    single = STAGE(spark, docs, sf)
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == alike(rows, linked)


@pytest.fixture(scope="module")
def edited():
    """Families of texts with a few changed words: chains, one large group, and pairs at 0.8 or a little less."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for family in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([30, 60, 150, 400]))]
        for _ in range(60 if family == 0 else rng.randint(1, 8)):
            texts.append(" ".join(text))
            changed = text if rng.random() < 0.5 else list(text)
            for at in rng.sample(range(len(text)), rng.randint(1, max(1, len(text) // 40))):
                changed[at] = rng.choice(words)
            text = changed
    return list(enumerate(texts))


def test_edited_texts_against_all_pairs(spark, edited):
    found = pairs_of([plain_set(t) for _, t in edited])
    linked = {p for p, s in found.items() if s >= 0.8}
    assert sum(s < 0.85 for p, s in found.items() if p in linked) > 20
    docs = spark.createDataFrame(edited, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in nearcopies.deduplicated(docs).collect()) == alike(edited, linked)


def test_bands_of_pairs_at_the_limit():
    rng = np.random.default_rng(7)
    met = 0
    for _ in range(2000):  # similarity 0.8: 80 of 100 shingles
        found = rng.integers(0, 1 << 64, 100, np.uint64)
        a, b = np.sort(found[:90]), np.sort(found[10:])
        assert nearcopies.similar(a, b) and not nearcopies.similar(np.sort(found[:89]), b[1:])
        met += bool(set(nearcopies.bands(a)) & set(nearcopies.bands(b)))
    assert met >= 1999


def test_odd_rows(spark, odd, nothing):
    rows = STAGE(spark, odd, "").collect()
    roots = plain_roots(sorted({plain_fingerprint(t) for _, t, *_ in ODD}), lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(roots[plain_fingerprint(r["text"])] for r in rows) == sorted(set(roots.values()))
    assert all(r["score"] == f"score-{r['doc_id']}" for r in rows)
    assert STAGE(spark, nothing, "").columns == nothing.columns and STAGE(spark, nothing, "").count() == 0
