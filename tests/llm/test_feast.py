import numpy as np
import pytest
from odd_vectors import ODD, vector_rows

from wiretally.llm import feast
from wiretally.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def spectra():
    rng = np.random.default_rng(5)
    yield "noise", np.cov(rng.standard_normal((500, 24)).T, bias=True)
    yield "steep", np.diag(10.0 ** -np.arange(12))
    turn, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    tied = turn @ np.diag([7.0] * 10 + [1.0] * 10) @ turn.T
    yield "tied", (tied + tied.T) / 2
    flat = rng.standard_normal((40, 3))
    yield "few", flat @ flat.T
    yield "single", np.array([[4.0]])
    yield "equal", np.eye(9) * 3
    yield "indefinite pivots", np.array([[0.0, 1.0], [1.0, 0.0]]) + np.eye(2)


@pytest.mark.parametrize("name, v", list(spectra()))
def test_leading_equals_all_eigenvalues(name, v):
    values, vectors = feast.leading(v, 8)
    every = np.linalg.eigvalsh(v)[::-1]
    want = min(8, int((every > 1e-10 * every[0]).sum()))
    assert len(values) == want
    assert np.allclose(values, every[:want], rtol=1e-12, atol=1e-13 * every[0])
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * every[0]
    assert np.abs(vectors.T @ vectors - np.eye(want)).max() < 1e-13


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(6)
    for size in (1, 2, 3, 10, 31):
        v = rng.standard_normal((size, size))
        v += v.T
        every = np.linalg.eigvalsh(v)
        for shift in (*rng.uniform(every[0] - 1, every[-1] + 1, 20), 0.0):
            assert feast.above(v, shift) == (every > shift).sum()


def test_no_eigenvalue_of_an_interval_is_missed():
    rng = np.random.default_rng(7)
    v = np.cov(rng.standard_normal((300, 30)).T, bias=True)
    v /= np.trace(v)
    every = np.linalg.eigvalsh(v)
    low, high = every[10] - 1e-4, every[15] + 1e-6
    count = feast.above(v, low) - feast.above(v, high)
    got = feast.inside(v, low, high, count, 1e-14)
    values = np.linalg.eigvalsh(got.T @ v @ got)
    assert np.allclose(values, every[(every > low) & (every <= high)], atol=1e-14)


def plain(vectors):
    x = np.floor(np.array(vectors, float) * 1024).astype(int) + 100_000
    n, total = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    off = x - total / n
    v = off.T @ off / n
    values, turned = np.linalg.eigh(v)
    keep = [i for i in np.argsort(-values)[:8] if values[i] > 1e-9 * values.max()]
    return deviation, off @ turned[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(v)


def compare(rows, vectors, order):
    """``rows`` of the result beside the plain result, by place; signs are free, but the same for all rows."""
    deviation, whitened, explained = plain(vectors)
    k = len(explained)
    got = {}
    for r in rows:
        got.setdefault(order(r), []).append(r)
    assert sorted(got) == list(range(len(vectors)))
    table = np.array([[r["whitened"] for r in sorted(got[i], key=lambda r: r["component"])] for i in range(len(vectors))])
    signs = np.sign((table * whitened).sum(axis=0))
    assert table.shape == (len(vectors), k) and np.abs(table * signs - whitened).max() < 1e-9
    for i, want in enumerate(deviation):
        assert {int(r["deviation"]) for r in got[i]} == {want}
        assert sorted(r["component"] for r in got[i]) == list(range(1, k + 1))
    assert np.allclose([r["explained"] for r in sorted(got[0], key=lambda r: r["component"])], explained, rtol=1e-9)
    assert {r["n"] for r in rows} == {len(vectors)}
    assert max(r["identity_error"] for r in rows) < 1e-9 and len({r["identity_error"] for r in rows}) == 1


def test_query_equals_dense_eigenvectors(spark):
    source = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    place = {r["vec_id"]: i for i, r in enumerate(source)}
    rows = QUERIES["op11_feast_whitening"](spark, SF).collect()
    assert rows[0].asDict().keys() == {
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    compare(rows, [r["embedding"] for r in source], lambda r: place[r["vec_id"]])


def test_partitions_do_not_change_components(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    a = feast.fit(table.repartition(1))
    b = feast.fit(table.repartition(37))
    assert a.n == b.n and a.sums == b.sums and (a.vectors == b.vectors).all() and (a.values == b.values).all()


def test_odd_vectors(spark):
    kept = [(i, v) for i, v, _ in ODD if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    filled = [v + [0.0] * (3 - len(v)) for _, v in kept]
    table = vector_rows(spark, ODD)
    rows = feast.whiten(table, ["vec_id"]).collect()
    deviation, whitened, _ = plain(filled)
    assert len(rows) == len(kept) * whitened.shape[1]
    want = sorted((str(i), d) for (i, _), d in zip(kept, deviation, strict=True))
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in rows if r["component"] == 1) == want
    with pytest.raises(ValueError):
        feast.whiten(table, ["vec_id", "whitened"])


def test_large_numbers_stay_exact(spark):
    vectors = [[1e8, -3.0], [-1e8, 5.0], [12345.678, 0.25]] * 3
    table = vector_rows(spark, [(i, v, 0) for i, v in enumerate(vectors)])
    got = {r["vec_id"]: int(r["deviation"]) for r in feast.whiten(table, ["vec_id"]).collect()}
    assert [got[i] for i in range(9)] == plain(vectors)[0]


def test_nothing_to_whiten(spark):
    empty = feast.whiten(vector_rows(spark, []), ["vec_id"])
    assert empty.collect() == [] and empty.columns == ["vec_id", *feast.RESULT]
    assert feast.whiten(vector_rows(spark, [(1, [0.5, 1.0], 0)] * 4), ["vec_id"]).collect() == []
    assert feast.whiten(vector_rows(spark, [(1, [], 0), (2, None, 0)]), ["vec_id"]).collect() == []
