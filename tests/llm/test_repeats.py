import hashlib
import random

import numpy as np
import pytest
from odd_documents import ODD

from wiretally.llm import repeats


def brute(texts, length):
    """Runs of bytes that lie in a string of ``length`` bytes that starts at two places."""
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        hit = [(i, i + length) for i in range(len(t) - length + 1) if count[t[i:i + length]] > 1]
        out.append(repeats.merged(hit))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)

    def noise(k):
        return "".join(rng.choice("abcdefgé \n") for _ in range(k))

    shared = [noise(rng.randint(200, 900)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [noise(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 150)
            parts += [s[a:a + rng.randint(100, 900)], noise(rng.randint(0, 40))]
        texts.append("".join(parts))
    return [*texts, texts[3], "x" * 700, "ab" * 600, texts[5][:300] + "Q" + texts[5][301:]]


def test_statistics_of_the_index():
    rng = random.Random(1)
    for _ in range(60):
        text = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcd") for _ in range(rng.randint(1, 90))) + b"\xff"
        got = repeats.RunIndex(np.frombuffer(text, np.uint8)).statistics()
        for i in range(len(text)):
            best = 0
            for j in range(len(text)):
                k = 0
                while i != j and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best, (text, i)


def test_transform_is_run_compressed():
    text = np.frombuffer(b"the same line again\n" * 200 + b"\xff", np.uint8)
    assert len(repeats.RunIndex(text).heads) < 60


def test_windows_of_contexts():
    contexts = [b"a" * 300, b"b" + b"a" * 280, b"c" * 260]
    found = repeats.repeated_windows(contexts, 270)
    assert [f.tolist() for f in found] == [[[0, 31]], [[1, 12]], []]


def test_contexts_after_equal_bytes():
    found = repeats.repeated_windows([b"ab" * 128 + b"a", b"ab" * 128], 256)
    assert [f.tolist() for f in found] == [[[0, 1]], [[0, 1]]]


@pytest.mark.parametrize("group", [repeats.GROUP, 0])
def test_against_brute_force(spark, group):
    texts = corpus(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    raw = [t.encode() for t in texts]
    want = brute(raw, 256)
    rows = repeats.without_repeats(docs, length=256, group=group).collect()
    assert len(rows) == len(texts) and sum(map(bool, want)) > 20
    for r in rows:
        i = r["doc_id"]
        assert [(s["from"], s["to"]) for s in r["spans"]] == want[i], i
        at, kept = 0, b""
        for a, b in want[i]:
            kept, at = kept + raw[i][at:a], b
        assert bytes(r["kept"]) == kept + raw[i][at:] and r["n_bytes"] == len(raw[i])


def test_odd_rows(odd, nothing):
    rows = repeats.without_repeats(odd, length=256).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        size = len(next((t or "").encode() for i, t, *_ in ODD if i == r["doc_id"])) if r["doc_id"] in (2, 3, 7) else None
        if size is not None:
            assert r["n_bytes"] == size
        if r["doc_id"] == 7:
            assert [(s["from"], s["to"]) for s in r["spans"]] == [(0, size)] and bytes(r["kept"]) == b""
    assert repeats.without_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(odd, length=100)


def test_repeated_rows_repeat_all(spark):
    text = "".join(random.Random(9).choice("abcdefgh") for _ in range(500))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:399])], "doc_id bigint, text string")
    rows = sorted((r["doc_id"], len(r["kept"])) for r in repeats.without_repeats(docs).collect())
    assert rows == [(1, 0), (1, 0), (2, 399)]


def test_query(spark):
    from wiretally.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute([t for _, t in docs], 400)
    rows = {r["doc_id"]: r for r in QUERIES["op5_run_length_index"](spark, sf).collect()}
    for (i, t), runs in zip(docs, want, strict=True):
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        assert tuple(rows[i]) == (i, len(t), sum(b - a for a, b in runs), len(runs),
                                  hashlib.sha256(kept + t[at:]).hexdigest())
