"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees split the directions of a bounded sample by hyperplanes between two random points of a node. Every
distinct vector is filed under its leaf in every tree. A query walks all trees at once through one
priority queue, ordered by the smallest margin on the way, until the leaves reached hold ``search`` points of the
sample; the vectors filed there are ranked by the exact cosine in double precision.

Equal vectors are one entry with its smallest ids, as many as can appear in a result, so copies cost nothing.
A leaf is cut into blocks of about ``BLOCK`` vectors; a block meets its queries in a stream, in bounded memory.

Defined cases
    Vectors that are null or zero, hold a null or a number that is not finite, differ in length from the sample's
    most frequent length, or have no id take no part, neither as queries nor as candidates.
    Rows of the query's own id are no candidates for it. Of repeated rows each id is returned once.
    With fewer candidates than wanted all that were found are returned. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.session import landed

BLOCK = 4096


@dataclass
class Forest:
    """Nodes of all trees: ``normals``; ``children`` as node numbers, or minus one minus a leaf number;
    ``roots``; ``weights``: points of the sample in each leaf."""

    normals: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.empty((len(unit), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(unit), root)
            while (live := np.flatnonzero(at >= 0)).size:
                side = np.einsum("ij,ij->i", unit[live], self.normals[at[live]]) > 0
                at[live] = self.children[at[live], side.astype(int)]
            out[:, t] = -1 - at
        return out

    def probe(self, query: np.ndarray, search: int) -> list[int]:
        """Leaves for a query, best first, until they hold ``search`` points of the sample."""
        margins = self.normals @ query if len(self.normals) else np.zeros(0)
        queue = [(-np.inf, int(r)) for r in self.roots]
        heapq.heapify(queue)
        found, seen = [], 0
        while queue and seen < search:
            worst, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                seen += int(self.weights[-1 - node])
                continue
            m = float(margins[node])
            heapq.heappush(queue, (max(worst, -m), int(self.children[node, 1])))
            heapq.heappush(queue, (max(worst, m), int(self.children[node, 0])))
        return found


def grow(unit: np.ndarray, trees: int, leaf: int, seed: int = 11) -> Forest:
    """A forest over a sample of unit vectors; leaves hold at most ``leaf`` of them where they can be split."""
    rng = np.random.default_rng(seed)
    normals: list[np.ndarray] = []
    children: list[list[int]] = []
    weights: list[int] = []

    def split(points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        for _ in range(5):
            a, b = unit[rng.choice(points, 2, replace=False)].astype(np.float64)
            for _ in range(3):  # move both towards the points nearer to them
                side = unit[points] @ (a - b) > 0
                if side.any() and not side.all():
                    a, b = unit[points[side]].mean(axis=0), unit[points[~side]].mean(axis=0)
            normal = a - b
            size = np.linalg.norm(normal)
            if size < 1e-9:
                continue
            normal = (normal / size).astype(np.float32)
            side = np.einsum("ij,j->i", unit[points], normal) > 0
            if 0.02 < side.mean() < 0.98:
                return normal, side
        return None

    def build(points: np.ndarray) -> int:
        cut = split(points) if len(points) > leaf else None
        if cut is None:
            weights.append(len(points))
            return -len(weights)
        node = len(normals)
        normals.append(cut[0])
        children.append([0, 0])
        children[node] = [build(points[~cut[1]]), build(points[cut[1]])]
        return node

    roots = [build(np.arange(len(unit))) for _ in range(trees)]
    dim = unit.shape[1]
    return Forest(np.array(normals, np.float32).reshape(-1, dim), np.array(children, np.int64).reshape(-1, 2),
                  np.array(roots), np.array(weights))


def usable(vector: Column) -> Column:
    """Not null, not zero, only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Usable rows as ``vec_id, key`` and distinct vectors as ``key, vec, ids`` (the least ``wanted`` + 1)."""
    key = F.concat(F.hex(F.xxhash64("vec")), F.hex(F.hash("vec")))
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).filter(
        usable(F.col("vec")) & F.col("vec_id").isNotNull())
    rows = landed(rows.select("vec_id", key.alias("key"), "vec"), "vectors")
    # At most wanted + 1 rows of a key leave a task, however many copies there are.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.select("key", "vec_id").distinct().withColumn("nth", nth).filter(F.col("nth") <= wanted + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = rows.withColumn("one", F.row_number().over(
        Window.partitionBy("key").orderBy("vec_id"))).filter("one = 1").select("key", "vec")
    return rows.select("vec_id", "key"), landed(first.join(ids, "key"), "distinct-vectors")


def to_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def unit_rows(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # scaled first, so that squares neither overflow nor vanish
    y = x / np.where(top > 0, top, 1)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of a with the same row of b, always summed in the same order."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def nearest(table: DataFrame, is_query: Column, *, wanted: int = 5, trees: int = 10, leaf: int = 100,
            sample: int = 20_000, share: float = 1.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``wanted`` nearest found for the rows of ``table`` (``vec_id,
    embedding``) that ``is_query`` picks by id. The forest is grown on at most ``sample`` vectors, those of the
    least hash; ``share`` of so many sample points, counted in every tree, are reached per query."""
    spark = table.sparkSession
    rows, distinct = vectors(table, wanted)
    ordered = distinct.orderBy("key").limit(sample).select("vec").collect()
    lengths = Counter(len(r["vec"]) for r in ordered)
    schema = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                         F.lit(0.0).alias("score")).schema
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = max(lengths, key=lambda n: (lengths[n], -n))
    points = np.array([r["vec"] for r in ordered if len(r["vec"]) == dim])
    forest = spark.sparkContext.broadcast(grow(unit_rows(points), trees, leaf))
    search = max(1, int(share * len(points)))
    fitting = distinct.filter(F.size("vec") == dim).select("key", "vec")
    asked = rows.filter(is_query)

    def file(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = to_matrix(part.column("vec"), dim)
            found = forest.value.leaves(unit_rows(x))
            index = np.repeat(np.arange(len(x)), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.ravel()), part.column("key").take(pa.array(index)),
                 part.column("vec").take(pa.array(index))], names=["leaf", "key", "vec"])

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 500):
                some = part.slice(start, 500)
                probes = [forest.value.probe(q, search) for q in unit_rows(to_matrix(some.column("vec"), dim))]
                index = pa.array(np.repeat(np.arange(len(probes)), [len(p) for p in probes]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for p in probes for n in p], pa.int64()), some.column("key").take(index),
                     some.column("vec").take(index)], names=["leaf", "key", "vec"])

    kind = "leaf bigint, key string, vec array<double>"
    filed = landed(fitting.mapInArrow(file, kind), "forest")
    blocks = landed(filed.groupBy("leaf").agg(F.count("*").alias("n")).select(
        F.col("leaf").alias("in_leaf"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "leaves")
    questions = fitting.join(asked.select(F.col("key").alias("asked")).distinct(),
                             F.col("key") == F.col("asked"), "leftsemi")
    probes = questions.repartition("key").mapInArrow(ask, kind)

    def cut(side: DataFrame, block: Column, number: int) -> DataFrame:
        return side.join(blocks, F.col("leaf") == F.col("in_leaf")).select(
            "leaf", block.alias("block"), F.lit(number).alias("side"), "key", "vec")

    both = cut(filed, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), 0).unionByName(
        cut(probes, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), 1))
    dealt = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "side")

    def rank(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        keys: list[str] = []
        held: list[np.ndarray] = []
        for part in parts:
            leaf_, block, side = (part.column(c).to_numpy() for c in ("leaf", "block", "side"))
            x, names = to_matrix(part.column("vec"), dim), part.column("key").to_pylist()
            new = np.flatnonzero((leaf_[1:] != leaf_[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *new], [*new, len(leaf_)], strict=True):
                if (leaf_[a], block[a]) != place:
                    place, keys, held = (leaf_[a], block[a]), [], []
                if side[a] == 0:
                    keys += names[a:b]
                    held.append(x[a:b])
                elif keys:
                    held = [np.concatenate(held)]
                    yield from best(names[a:b], x[a:b], keys, held[0])

    def best(names: list[str], q: np.ndarray, keys: list[str], x: np.ndarray) -> Iterator[pa.RecordBatch]:
        ux = unit_rows(x).astype(np.float64)
        for start in range(0, len(q), 256):
            some = q[start:start + 256]
            near = unit_rows(some).astype(np.float64) @ ux.T
            if len(keys) > wanted + 1:  # also what single precision cannot tell from the last one
                last = np.partition(near, len(keys) - wanted - 1, axis=1)[:, len(keys) - wanted - 1]
                i, j = np.nonzero(near >= last[:, None] - 1e-5)
            else:
                i, j = (v.ravel() for v in np.indices(near.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[start + k] for k in i], pa.string()), pa.array([keys[k] for k in j], pa.string()),
                 pa.array(cosines(some[i], x[j]))], names=["asked", "found", "score"])

    ranked = dealt.mapInArrow(rank, "asked string, found string, score double").distinct()
    # The best wanted + 1 distinct vectors hold the answer: one of them may be the query's own.
    nth = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.col("ids")[0]))
    listed = ranked.join(distinct.select("key", "ids"), F.col("found") == F.col("key")).withColumn("nth", nth).filter(
        F.col("nth") <= wanted + 1)
    lists = listed.groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("lists"))
    answered = asked.distinct().join(lists, F.col("key") == F.col("asked")).select(
        F.col("vec_id").alias("query_id"), F.explode("lists").alias("one")).select(
        "query_id", F.col("one.score").alias("score"), F.explode("one.ids").alias("vec_id")).filter(
        "vec_id <> query_id")
    # Repeated ids keep their best vector; then the order of the result.
    once = answered.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted).select(
        "query_id", "rank", "vec_id", "score")
