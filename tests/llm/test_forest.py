import numpy as np
from pyspark.sql import functions as F

from wiretally.llm import forest

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(rows, queries, wanted=5):
    """Brute force over all usable rows."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q in queries:
            best = {}
            for i, y in ok:
                if i != q:
                    s = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))
                    best[i] = max(s, best.get(i, -2))
            out[q] = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:wanted]
    return out


def check(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    for found in got.values():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    return got


def test_recall_and_scores(spark):
    from wiretally.llm.queries import QUERIES
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    size = np.sqrt((x * x).sum(axis=1))
    got = check(QUERIES["op10_projection_forest"](spark, SF))
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    hits = total = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at] / (size * size[at])
        s[at] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits, total = hits + len(best & {i for i, _ in found}), total + 5
        for i, score in found:
            assert abs(score - s[int(np.flatnonzero(ids == i)[0])]) < 1e-12
    assert hits / total >= 0.9


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, []), (50, [-1.0, 0.5]),
            (0, [1.0, 0.0]), (3, [1.0, 0.9]), (100, [1.0, 0.0]), (150, None), *[(200 + i, [0.5, 0.5]) for i in range(1, 40)]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("score", F.lit("clash"))
    got = check(forest.nearest(df, F.col("vec_id") % 50 == 0))
    want = exact(rows, {0, 50, 100})
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    for q, f in got.items():
        assert np.allclose([s for _, s in f], [s for _, s in want[q]], atol=1e-12)


def test_few_or_no_candidates(spark):
    def run(rows):
        return check(forest.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 50 == 0))

    assert run([]) == {} and run([(0, None)]) == {} and run([(0, [1.0])]) == {}
    one = run([(0, [1.0, 2.0]), (7, [2.0, 4.0])])
    assert list(one) == [0] and one[0][0][0] == 7 and abs(one[0][0][1] - 1) < 1e-12
    assert [i for i, _ in run([(0, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0]), (9, [1.0, 2.0])])[0]] == [7, 9]


def test_blocks_of_a_leaf(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(forest, "BLOCK", 16)
    got = check(forest.nearest(df, F.col("vec_id") % 50 == 0, leaf=100, share=50.0))
    want = exact(rows, {0, 50, 100, 150, 200, 250})
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_probes_reach_every_leaf_in_the_end():
    rng = np.random.default_rng(2)
    unit = forest.unit_rows(rng.normal(size=(500, 8)))
    trees = forest.grow(unit, 3, 20)
    assert trees.weights.sum() == 1500 and trees.weights.max() <= 20
    probes = trees.probe(unit[0], 10**9)
    assert sorted(probes) == list(range(len(trees.weights)))
    assert set(trees.leaves(unit[:1])[0]) <= set(probes[:3])
