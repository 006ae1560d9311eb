import duckdb
import numpy as np
import pytest
from odd_vectors import ODD, vector_rows

from wiretally.llm import product
from wiretally.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, cosine=0.98):
    """``id, links, class, kept`` of rows of id, vector, label, by all pairs."""
    usable = [y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
              for _, v, y in rows]
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    filled = [np.array(list(v) + [0.0] * (dim - len(v))) if ok else None
              for (_, v, _), ok in zip(rows, usable, strict=True)]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2]:
                u, v = filled[a], filled[b]
                if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= cosine:
                    near[a].append(b)
                    near[b].append(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            todo = [b for b in {b for c in todo for b in near[c]} if b not in seen]
            seen.update(todo)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(near[a]), least, rows[a][0] is not None and rows[a][0] == least))
    return sorted(out, key=str)


def crowd(seed, groups, dim=16, noise=0.02):
    """Vectors around random centres, labels in turn, with exact copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for size, spread in groups:
        centre = rng.standard_normal(dim)
        for _ in range(size):
            v = centre + rng.standard_normal(dim) * spread * noise * np.linalg.norm(centre)
            rows.append((len(rows), (v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + n, rows[n * 3][1], rows[n * 3][2]) for n in range(len(rows) // 6)]
    return rows


@pytest.mark.parametrize("groups", [
    [(1, 0)] * 80, [(120, 1.0), (60, 2.5), (5, 1.0)] + [(1, 0)] * 20, [(150, 3.0)], [(90, 0.4), (90, 1.5), (40, 0.1)]])
@pytest.mark.parametrize("block", [7, 4096])
def test_links_equal_all_pairs(spark, monkeypatch, groups, block):
    monkeypatch.setattr(product, "BLOCK", block)
    monkeypatch.setattr(product, "CHUNK", 5)
    rows = crowd(len(groups), groups)
    found = product.near_duplicates(vector_rows(spark, rows), ["vec_id"], per_list=5)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    x = product.directions(np.concatenate([rng.standard_normal((300, 16)), rng.standard_normal((1, 16)) +
                                           0.05 * rng.standard_normal((200, 16))]))
    index = product.build(x[::2], 0.98, 30, 4)
    own, _, probe = index.lists(x)
    code, missed = index.codes(x, own)
    apart = np.sqrt(product.squared(x, x))
    pruned = 0
    for a, b in np.argwhere(apart <= index.reach):
        assert own[a] == own[b] or probe[a, own[b]]
    for one in np.unique(own):
        mine = np.flatnonzero(own == one)
        bound = index.bounds(x, one, code[mine], missed[mine])
        assert (bound <= apart[:, mine] + product.SLACK).all()
        pruned += (bound > index.reach).sum()
    assert pruned > 0 and (~probe).mean() > 0.2  # the index does spare comparisons


def test_query_equals_all_pairs(spark):
    source = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = QUERIES["op12_product_near_duplicates"](spark, SF).collect()
    assert sorted(map(tuple, rows), key=str) == plain(source)


def test_sql_of_a_crowd(spark, tmp_path):
    rows = crowd(9, [(40, 1.5), (30, 2.5), (10, 0.1)] + [(1, 0)] * 20)
    rows += [(900, [0.0] * 16, 0), (901, None, 1), (902, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    vector_rows(spark, rows).select("vec_id", "embedding", "label").coalesce(1).write.parquet(str(tmp_path / "v"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as from read_parquet('{tmp_path}/v/*.parquet')")
    found = con.execute(ORACLES["op12_product_near_duplicates"]).fetchall()
    assert sorted(found, key=str) == plain(rows)


def test_odd_vectors(spark):
    found = product.near_duplicates(vector_rows(spark, ODD), ["vec_id"])
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(ODD)
    with pytest.raises(ValueError):
        product.near_duplicates(vector_rows(spark, ODD), ["n_links"])


def test_extreme_lengths_of_vectors(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [1e300, -1e300], 0), (4, [5e-324, 0.0], 0)]
    found = product.near_duplicates(vector_rows(spark, rows), ["vec_id"]).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_no_vectors(spark):
    assert product.near_duplicates(vector_rows(spark, []), ["vec_id"]).collect() == []
    one = product.near_duplicates(vector_rows(spark, [(7, None, 1)]), ["vec_id"]).collect()
    assert [tuple(r) for r in one] == [(7, 0, 7, True)]


def test_a_ball_is_counted_without_pairs(spark, monkeypatch):
    """A dense group of near copies never reaches the comparison of pairs."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(n, (centre + 1e-3 * rng.standard_normal(16)).tolist(), 0) for n in range(400)]
    distinct = product.nodes_of(vector_rows(spark, rows), ["vec_id"], "vec_id", "embedding", "label").selectExpr(
        "node", "label", "vec", "1L as copies")
    unit = product.directions(np.array([v for _, v, _ in rows]))
    index = product.build(unit[:100], 0.98, 20, 8)
    assert len(index.coarse) == 1
    counts, pairs = product.links(distinct, index, 16, 0.98)
    assert counts.agg({"links": "sum"}).first()[0] == 400 * 399
    assert pairs.count() == 400  # the star of the ball
