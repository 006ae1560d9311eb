"""Compression of vectors to codes: each part of a vector becomes the index of its nearest codebook entry.

Components become whole numbers and everything after that is arithmetic on whole numbers, so codes, codebooks and errors
do not depend on how rows are spread. A round of training is one pass: tasks return counts and sums of each
entry, Spark adds them up, and the driver sees numbers of the size of the codebooks.

Nearest entries are found through memoised grid cells. A part's coarse cell is the box of ``2^bits`` wide steps that it lies
in. An entry is dominated in a box when its least distance to the box exceeds some entry's largest distance. A task hashes
cells and remembers, per cell, the entries that are not dominated; for a part of the cell only those are evaluated.
The memory holds ``CELLS`` cells; a full one is emptied and filled again.

Defined cases
    Vectors that are null or hold a null or a number that is not finite are dropped. Each other row is one vector, also with
    a null or repeated id. Vectors are filled with zeros to the length of the longest, rounded up to a multiple of the parts.
    Codebooks start from the rows of the smallest ids; nulls come last, of equal ids the smaller vector first. Fewer rows
    than entries make smaller codebooks. Ties between entries go to the lower index; unused entries stay.
    An empty table gives an empty table and codebooks without entries.
    Columns that are not kept do not matter; a kept one must not be named ``code`` or ``error`` (ValueError).
    Components too large for distances of 63 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.vectors import doubles, finite, matrix, whole, width
from wiretally.session import landed

SCALE = 4096
#: Cells remembered by a task for each codebook.
CELLS = 1 << 16
#: Width of a coarse cell as a power of two.
BITS = 8


class Memo:
    """Nearest entries of one codebook (entries x width) by coarse cells."""

    def __init__(self, book: np.ndarray, bits: int = BITS, limit: int = CELLS, seed: int = 13):
        self.book, self.bits, self.limit = book, bits, limit
        self.factors = np.random.default_rng(seed).integers(1, 1 << 62, book.shape[1]) | 1
        self.cells: dict[int, int] = {}
        self.corners = np.zeros((limit, book.shape[1]), np.int64)
        self.open = np.zeros((limit, len(book)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """cells x entries: whether an entry can be the nearest of some point of the cell's box."""
        low = cells << self.bits
        high = low + (1 << self.bits) - 1
        least = np.empty((len(cells), len(self.book)), np.int64)
        most = np.empty_like(least)
        for j, entry in enumerate(self.book):
            near = np.maximum(np.maximum(low - entry, entry - high), 0)
            far = np.maximum(np.abs(low - entry), np.abs(high - entry))
            least[:, j], most[:, j] = (near * near).sum(axis=1), (far * far).sum(axis=1)
        return least <= most.min(axis=1, keepdims=True)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """parts x entries: which entries to evaluate."""
        cells = parts >> self.bits
        with np.errstate(over="ignore"):
            hashes = (cells * self.factors).sum(axis=1) if cells.shape[1] else np.zeros(len(cells), np.int64)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        masks = np.ones((len(distinct), len(self.book)), bool)
        known = [self.cells.get(h, -1) for h in distinct.tolist()]
        place = np.array(known, np.int64)
        new = np.flatnonzero(place < 0)
        masks[place >= 0] = self.open[place[place >= 0]]
        corners = cells[first]
        corners[place >= 0] = self.corners[place[place >= 0]]
        masks[new] = self.undominated(corners[new])
        if len(new):
            if len(self.cells) + len(new) > self.limit:
                self.cells.clear()
            stored = new[:self.limit]
            at = len(self.cells) + np.arange(len(stored))
            self.corners[at], self.open[at] = corners[stored], masks[stored]
            self.cells.update(zip(distinct[stored].tolist(), at.tolist(), strict=True))
        found = masks[back]
        found[(corners[back] != cells).any(axis=1)] = True  # another cell of the same hash
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of every part."""
        index = np.zeros(len(parts), np.int64)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        wanted = self.candidates(parts)
        for j, entry in enumerate(self.book):
            rows = np.flatnonzero(wanted[:, j])
            off = parts[rows] - entry
            distance = np.einsum("ij,ij->i", off, off)
            closer = distance < best[rows]
            index[rows[closer]], best[rows[closer]] = j, distance[closer]
        return index, best


def steps(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    """rows x parts x width: floor(4096 x) of every component."""
    x = matrix(column, dim)
    limit = int((2.0 ** 62 / max(dim, 1)) ** 0.5) // 2
    return whole(np.floor(x * SCALE), limit).reshape(len(x), parts, dim // parts)


def encode(books: np.ndarray, vectors: np.ndarray, memos: list[Memo]) -> tuple[np.ndarray, np.ndarray]:
    """rows x parts: indexes and squared distances."""
    found = [memo.nearest(vectors[:, p]) for p, memo in enumerate(memos)]
    shape = (len(books), len(vectors))
    return (np.array([f[0] for f in found]).reshape(shape).T, np.array([f[1] for f in found]).reshape(shape).T)


def _round(vectors: DataFrame, books: np.ndarray, dim: int, bits: int) -> np.ndarray:
    """Codebooks after every part has moved its entry: one pass."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(book, bits) for book in books]
        total = np.zeros((parts, entries, size + 1), object)
        for batch in batches:
            x = steps(batch.column(0), dim, parts)
            index, _ = encode(books, x, memos)
            for p in range(parts):
                for j in np.unique(index[:, p]):
                    mine = x[index[:, p] == j, p]
                    total[p, j, 0] += len(mine)
                    total[p, j, 1:] += mine.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(total.size), pa.int32()), pa.array([int(v) for v in total.ravel()], pa.decimal128(38, 0))],
            names=["slot", "total"])

    partial = vectors.mapInArrow(run, "slot int, total decimal(38,0)").filter("total <> 0")
    found = {r["slot"]: int(r["total"]) for r in partial.groupBy("slot").agg(F.sum("total").alias("total")).collect()}
    total = np.array([found.get(i, 0) for i in range(parts * entries * (size + 1))], object)
    total = total.reshape(parts, entries, size + 1)
    moved = books.copy()
    for p, j in zip(*np.nonzero(total[:, :, 0]), strict=True):
        moved[p, j] = [v // total[p, j, 0] for v in total[p, j, 1:]]
    return moved


def train(table: DataFrame, *, by: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16,
          rounds: int = 6, bits: int = BITS) -> np.ndarray:
    """parts x entries x width: codebooks after ``rounds`` rounds over all rows."""
    usable = table.filter(finite(doubles(vector)))
    vectors = usable.select(doubles(vector).alias("vector"))
    dim = -(-width(vectors, "vector") // parts) * parts
    first = usable.select(F.col(by).alias("by"), doubles(vector).alias("vector")).orderBy(
        F.asc_nulls_last("by"), "vector").limit(entries).collect()
    start = steps(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), dim, parts)
    books = start.transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = _round(vectors, books, dim, bits)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, books: np.ndarray, keep: list[str], *, vector: str = "embedding",
             bits: int = BITS) -> DataFrame:
    """The kept columns, ``code`` (two hex digits per part) and ``error`` (squared distances, summed) of every usable row."""
    clash = set(keep) & {"code", "error"}
    if clash:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}")
    parts, entries, size = books.shape
    rows = table.filter(finite(doubles(vector))).select(*keep, doubles(vector).alias("compressed_vector"))
    schema = rows.select(*keep, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).schema
    if not entries:
        return table.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(book, bits) for book in books]
        for batch in batches:
            index, distance = encode(books, steps(batch.column(len(keep)), parts * size, parts), memos)
            codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(codes, pa.string()),
                 pa.array(distance.sum(axis=1), pa.int64())], names=[*keep, "code", "error"])

    return rows.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, group: str) -> DataFrame:
    """``coded`` with ``group_error``: the error summed over the rows of an equal group, nulls together."""
    coded = landed(coded, "codes")
    sums = landed(coded.groupBy(F.col(group).alias("summed_group")).agg(F.sum("error").alias("group_error")), "code-errors")
    return coded.join(sums, F.col(group).eqNullSafe(F.col("summed_group"))).drop("summed_group")
