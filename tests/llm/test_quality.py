import zlib

import numpy as np

from wiretally.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from wiretally.llm.queries import QUERIES
    rows = QUERIES["op3_quality_nbsvm"](spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert np.mean([p == y for _, p, y in held]) > 0.97


def test_descent_reaches_the_optimum_of_a_small_problem():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(40)]
    y = np.where([5 in r or 7 in r for r in rows], 1, -1)
    scale, cost = np.ones(30), np.full(40, 1.0)
    x = np.zeros((40, 31))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
    x[:, 30] = 1

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()

    w, bias = quality.descend(rows, y, scale, cost, epochs=2000)
    ours = loss(np.append(w, bias))
    best, at = np.zeros(31), np.inf  # plain subgradient steps as the other way
    for k in range(20000):
        g = best - ((y * (x @ best) < 1) * y) @ x
        best = best - g / (k + 10)
        at = min(at, loss(best))
    assert ours <= at + 1e-2


def test_log_ratios():
    rows, y = [np.array([1, 2]), np.array([1]), np.array([3])], np.array([1, 1, -1])
    r = quality.log_ratios(rows, y)
    assert r[1] > r[2] > 0 > r[3] and r[9] == 0


def test_features_are_sets_of_the_text_alone():
    make = quality.Featuriser()
    texts = ["a b a b", "", "a b a b", "B!! c"]
    found, ends = make(texts)
    parts = [found[ends[i]:ends[i + 1]] for i in range(4)]
    assert (parts[0] == parts[2]).all() and len(parts[1]) == 0 and len(set(parts[0])) == len(parts[0])
    alone, _ = quality.Featuriser()(["B!! c"])
    assert (parts[3] == alone).all()


def test_labels_without_two_classes(spark, odd, nothing):
    def labels(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    assert quality.train(odd, labels([])) == 0.5
    assert quality.train(odd, labels([(1, 1, 0), (None, 0, 0), (3, None, 1)])) == 1.0
    assert quality.train(odd, labels([(1, 1, 0), (1, 0, 0), (5, 0, 0)])) == 0.0  # 1 is labelled both ways
    assert quality.train(odd, labels([(99, 1, 0), (98, 0, 0)])) == 0.5  # labels of no document
    assert quality.score(nothing, 0.5, ["doc_id"]).count() == 0


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (5, 0, 0), (8, 0, 1), (7, 1, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.score(odd.select("doc_id", "text"), model, ["doc_id", "text"]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.score(nothing, model, ["doc_id"]).count() == 0


TOP = (1 << 64) - 1


def plain_features(text):
    """The set of feature numbers of a text, gram by gram."""
    import xxhash

    def mix(x):
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & TOP
        return (x ^ (x >> 29)) >> (64 - quality.BITS)

    a, b, c = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    words = text.split()
    w = [xxhash.xxh64_intdigest(x.lower(), 1) for x in words]
    s = [xxhash.xxh64_intdigest(quality.shape(x), 2) for x in words]
    s = [(x * 3 + 1) & TOP if i and w[i] == w[i - 1] else x for i, x in enumerate(s)]
    found = {mix(x) for x in w} | {mix((x + c) & TOP) for x in s}
    found |= {mix((x * a + y * b) & TOP) for x, y in zip(w, w[1:], strict=False)}
    found |= {mix((x * b + y * a + c) & TOP) for x, y in zip(s, s[1:], strict=False)}
    return found | {mix((x * a + y * c + z * b) & TOP) for x, y, z in zip(s, s[1:], s[2:], strict=False)}


def plain_score(model, text):
    found = sorted(plain_features(text or ""))
    size = np.sqrt(sum(float(model.scale[f]) ** 2 for f in found))
    margin = sum(float(model.weights[f]) for f in found) / (size if size > 1e-9 else 1.0) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -60, 60)))


def small_model():
    rng = np.random.default_rng(12)
    size = 1 << quality.BITS
    return quality.Model(rng.standard_normal(size).astype(np.float32), rng.standard_normal(size).astype(np.float32),
                         0.1, 1.3, -0.2)


def test_query_equals_plain_scores(spark):
    from wiretally.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter(~quality.held_out())
    model = quality.train(docs, labels)
    want = {r["doc_id"]: plain_score(model, r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in QUERIES["op3_quality_nbsvm"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_a_score_does_not_depend_on_its_neighbours(spark, monkeypatch):
    model, make = small_model(), quality.Featuriser()
    texts = ["one two three " * n for n in range(1, 40)] + ["", None, "x" * 5000 + "9" * 50, "é Ü ß"]
    alone = [quality.score_texts(model, make, [t])[0] for t in texts]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(texts)).tolist()
        monkeypatch.setattr(quality, "TOGETHER", 10 ** (seed + 2))
        assert quality.score_texts(model, make, [texts[i] for i in order]).tolist() == [alone[i] for i in order]
    assert np.allclose(alone, [plain_score(model, t) for t in texts], atol=1e-9)


def test_equal_texts_have_equal_scores(spark):
    from wiretally.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {}
    for r in QUERIES["op3_quality_nbsvm"](spark, SF).collect():
        scores.setdefault(docs[r["doc_id"]], set()).add(r["score"])
    assert any(n > 1 for n in np.unique(list(map(str, docs.values())), return_counts=True)[1])
    assert all(len(s) == 1 for s in scores.values())


def test_an_id_on_many_rows_is_learned_once(spark):
    rows = [(i, f"good text number {i} of many words") for i in range(30)]
    rows += [(100 + i, f"BAD {i} !!! BUY {i}") for i in range(30)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id bigint, quality int")
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    often = once.unionByName(spark.createDataFrame([(3, "zz later text")] * 500 + [rows[3]] * 500, once.schema))
    a, b = quality.train(once, labels), quality.train(often, labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias and a.slope == b.slope
