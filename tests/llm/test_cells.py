import hashlib

import numpy as np
import pytest
from odd_vectors import ODD, vector_rows

from wiretally.llm import cells
from wiretally.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and the digest of the codebooks, with every distance evaluated. ``rows``: id, vector."""
    dim = -(-max(len(v) for _, v in rows) // parts) * parts
    cut = [np.floor(np.array(list(v) + [0.0] * (dim - len(v))) * 4096).astype(int).reshape(parts, -1) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, list(rows[k][1])))
    books = [[cut[k][p].tolist() for k in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((int(a) - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        near = [[nearest(p, x[p])[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [x[p] for x, n in zip(cut, near, strict=True) if n[p] == j]
                if mine:
                    books[p][j] = [sum(int(m[i]) for m in mine) // len(mine) for i in range(len(mine[0]))]
    last = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    flat = [str(c) for book in books for e in book for c in e]
    return (["".join(f"{j:02x}" for _, j in row) for row in last], [sum(d for d, _ in row) for row in last],
            hashlib.sha256(",".join(flat).encode()).hexdigest())


@pytest.mark.parametrize("bits, limit", [(0, 1 << 10), (6, 1 << 10), (8, 64), (8, 3), (14, 1 << 10)])
def test_memo_equals_all_distances(bits, limit):
    rng = np.random.default_rng(2)
    book = rng.integers(-2000, 2000, (16, 8))
    book[5] = book[3]  # a tie
    memo = cells.Memo(book, bits, limit)
    for _ in range(3):  # later rounds come out of the memory
        parts = np.concatenate([rng.integers(-3000, 3000, (400, 8)), book, (book[:-1] + book[1:]) // 2])
        index, distance = memo.nearest(parts)
        every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert len(memo.cells) <= limit


def test_cells_of_one_hash_are_told_apart():
    rng = np.random.default_rng(3)
    book = rng.integers(-500, 500, (16, 4))
    memo = cells.Memo(book, 5)
    memo.factors[:] = 0  # all cells share a hash
    parts = rng.integers(-800, 800, (500, 4))
    index, _ = memo.nearest(parts)
    assert (index == ((parts[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_memo_leaves_entries_out():
    book = np.array([[0, 0], [1000, 1000], [5000, 0], [-4000, 300]])
    memo = cells.Memo(book, 6)
    assert memo.candidates(np.array([[10, 10], [4990, 7]])).tolist() == [
        [True, False, False, False], [False, False, True, False]]


def test_query_equals_plain_rounds(spark):
    source = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    codes, errors, digest = plain([(r["vec_id"], r["embedding"]) for r in source], rounds=6)
    of_label = {}
    for r, e in zip(source, errors, strict=True):
        of_label[r["label"]] = of_label.get(r["label"], 0) + e
    want = [(r["vec_id"], c, e, of_label[r["label"]], digest) for r, c, e in zip(source, codes, errors, strict=True)]
    assert sorted(map(tuple, QUERIES["op13_grid_cell_codes"](spark, SF).collect())) == want


def test_partitions_do_not_change_codebooks(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert (cells.train(table.repartition(1)) == cells.train(table.repartition(23))).all()


def test_odd_vectors(spark):
    kept = [(i, v, y) for i, v, y in ODD if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    codes, errors, digest = plain([(i, v) for i, v, _ in kept])
    table = vector_rows(spark, ODD)
    books = cells.train(table)
    assert cells.digest(books) == digest and books.shape == (8, len(kept), 1)
    coded = cells.with_group_error(cells.compress(table, books, ["vec_id", "label", "row"]), "label").collect()
    total = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        total[y] = total.get(y, 0) + e
    want = [(i, y, "r", c, e, total[y]) for (i, _, y), c, e in zip(kept, codes, errors, strict=True)]
    assert sorted(map(str, (tuple(r) for r in coded))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        cells.compress(table, books, ["code"])
    with pytest.raises(ValueError):
        cells.train(vector_rows(spark, [(1, [1e300], 0)]))


def test_no_vectors(spark):
    table = vector_rows(spark, [(1, None, 0)])
    books = cells.train(table)
    coded = cells.with_group_error(cells.compress(table, books, ["vec_id", "label"]), "label")
    assert coded.collect() == [] and coded.columns == ["vec_id", "label", "code", "error", "group_error"]
    assert cells.digest(books) == hashlib.sha256(b"").hexdigest()
