"""Near-duplicate vectors by cosine: coarse inverted lists, residual product codes, table-lookup distances, exact rerank.

Directions of a bounded sample give coarse centroids and, for each subspace, a codebook of the residuals. Every distinct
vector is filed once, in the list of its nearest centroid, with its code and the length of what the code
misses. It probes every list whose bisecting plane to its own list lies within reach of the wanted cosine: two vectors that
near lie on different sides of that plane only if both are within reach of it, so no link is lost. In a list the
distance from a probe to a code, summed from tables, minus what the code misses, is a lower bound of the real distance; pairs within
reach by that bound are ranked by the exact cosine in double precision. Sample and codebooks decide the cost, not the result.

Equal vectors of a label are one node with a count. Vectors within half the reach of their centroid are linked to each other
without comparing them: they form a ball of the list, counted by one aggregate and held together by a star. So neither copies nor a
dense group of near copies are paired. Lists are cut into blocks of about ``BLOCK`` vectors. A block meets its probes in a
stream and gives back counts and, for each batch of probes, stars over what is linked, not the pairs.

Defined cases
    Rows with a null label and vectors that are null or zero, or hold a null or a number that is not finite, link with nothing:
    no links, a class of their own. Vectors of different lengths are compared as if filled with zeros.
    Each row is one vector, also with a repeated id; a null id is never a class's smallest one, and a class of null ids only
    has a null class id and keeps nothing. Ties need no rule. An empty table gives an empty table.
    Columns that are not kept do not matter; a kept one must not be named like a column of the result (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.components import components
from wiretally.llm.vectors import doubles, finite, matrix, numbers, width
from wiretally.session import landed

BLOCK = 4096
#: Probes that meet a block at once, and pairs whose cosine is computed at once.
CHUNK, PAIRS = 512, 1 << 15
#: Room for rounding in bounds, far above that of sums over unit vectors.
SLACK = 1e-6
RESULT = ("n_links", "component_id", "kept")


def directions(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that squares neither overflow nor vanish."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; rows are scaled by powers of two, which loses no bit."""
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (a, b))
    dot, aa, bb = (np.einsum("ij,ij->i", p, q) for p, q in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def means(x: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of x by Lloyd's rounds from random rows."""
    at = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, at).argmin(axis=1)
        n = np.bincount(near, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        at[n > 0] = total[n > 0] / n[n > 0, None]
    return at


@dataclass
class Index:
    """``coarse`` centroids; ``books``: subspaces x entries x width; ``reach``: distance of unit vectors at the cosine."""

    coarse: np.ndarray
    books: np.ndarray
    reach: float

    def lists(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of every row, its distance from that centroid, and which other lists it has to probe."""
        d = squared(unit, self.coarse)
        own = d.argmin(axis=1)
        mine = d[np.arange(len(unit)), own]
        apart = np.sqrt(squared(self.coarse, self.coarse))[own]
        # distance from the plane between two centroids: (|u - c|^2 - |u - own|^2) / (2 |c - own|)
        probe = d - mine[:, None] <= 2 * apart * (self.reach + SLACK) + SLACK
        probe[np.arange(len(unit)), own] = False
        return own, np.sqrt(mine), probe

    def codes(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they miss."""
        parts = (unit - self.coarse[own]).reshape(len(unit), len(self.books), -1)
        code = np.empty(parts.shape[:2], np.uint8)
        missed = np.zeros(len(unit))
        for s, book in enumerate(self.books):
            code[:, s] = squared(parts[:, s], book).argmin(axis=1)
            off = parts[:, s] - book[code[:, s]]
            missed += (off * off).sum(axis=1)
        return code, np.sqrt(missed)

    def bounds(self, probes: np.ndarray, own: int, code: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """probes x codes of one list: no pair's distance is smaller than this."""
        parts = (probes - self.coarse[own]).reshape(len(probes), len(self.books), -1)
        total = np.zeros((len(probes), len(code)))
        for s, book in enumerate(self.books):
            total += squared(parts[:, s], book)[:, code[:, s]]
        return np.sqrt(total) - missed


def build(sample: np.ndarray, cosine: float, lists: int, subspaces: int, entries: int = 256, seed: int = 17) -> Index:
    """An index trained on a sample of unit vectors. Centroids closer than the reach to an earlier one are left out, so that a
    dense group has one centroid, and a ball around it."""
    rng = np.random.default_rng(seed)
    reach = float(np.sqrt(2 - 2 * cosine))
    found = means(sample, lists, 8, rng)
    coarse = found[:1]
    for c in found[1:]:
        if squared(c[None], coarse).min() > reach * reach:
            coarse = np.concatenate([coarse, c[None]])
    own = squared(sample, coarse).argmin(axis=1)
    parts = (sample - coarse[own]).reshape(len(sample), subspaces, -1)
    books = np.zeros((subspaces, min(entries, len(sample)), parts.shape[2]))
    for s in range(subspaces):
        books[s] = means(parts[:, s], entries, 6, rng)
    return Index(coarse, books, reach)


def stars(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Least node of the component of each of ``size`` nodes that the links i - j connect."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def nodes_of(table: DataFrame, keep: list[str], by: str, vector: str, label: str) -> DataFrame:
    """``row, by, label, vec, node``: a digest of label and vector, null where the row links with nothing."""
    values = doubles(vector)
    usable = finite(values) & F.exists(values, lambda x: x != 0) & F.col(label).isNotNull()
    text = F.concat_ws("|", F.col(label).cast("string"), values.cast("string"))
    return table.select(F.struct(*keep).alias("row"), F.col(by).alias("by"), F.col(label).alias("label"),
                        numbers(table, vector).alias("vec"), F.when(usable, F.md5(text)).alias("node"))


def links(distinct: DataFrame, index: Index, dim: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (``node, label, vec, copies``): ``node, links`` to other vectors, in parts to be added,
    and ``a, b``, links that connect what is connected."""
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def file(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            unit = directions(matrix(part.column(2), dim))
            own, far, probe = shared.value.lists(unit)
            code, missed = shared.value.codes(unit, own)
            tight = far <= shared.value.reach / 2 - SLACK
            # Sublist 2 c + 1 is the ball of list c, 2 c what lies outside it. Of two lists the lower one's vectors probe
            # the other's, and a ball's vectors probe the rest of their list: each pair meets once.
            target = [[2 * o, *(x for c in np.flatnonzero(p) if c > o for x in (2 * c, 2 * c + 1))]
                      for o, p in zip(own.tolist(), probe, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(2 * own + tight, pa.int64()), pa.array([c.tobytes() for c in code], pa.binary()),
                 pa.array(missed), pa.array(target, pa.list_(pa.int64()))],
                names=["node", "label", "vec", "copies", "sublist", "code", "missed", "targets"])

    kind = distinct.select("node", "label", "vec", "copies").schema
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    filed = landed(distinct.select("node", "label", "vec", "copies").mapInArrow(
        file, columns + ", sublist bigint, code binary, missed double, targets array<bigint>"), "vector-lists")
    sizes = landed(filed.groupBy(F.col("label").alias("of_label"), F.col("sublist").alias("of_sublist")).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.sum("copies").alias("total"),
        F.min("node").alias("hub")), "vector-list-sizes")
    in_list = (F.col("label") == F.col("of_label")) & (F.col("sublist") == F.col("of_sublist"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    held = filed.join(sizes, in_list).select(
        "label", "sublist", block.alias("block"), F.lit(0).alias("side"), "node", "vec", "copies", "code", "missed")
    # A probe meets the later blocks of its own sublist and all blocks of the others; its own block it meets by lying in it.
    asked = filed.select("label", F.col("sublist").alias("home"), "node", "vec", "copies",
                         F.explode("targets").alias("sublist"))
    met = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = F.when(F.col("home") == F.col("sublist"), F.filter(met, lambda b: b > block)).otherwise(met)
    asked = asked.join(sizes, in_list).select(
        "label", "sublist", F.explode(met).alias("block"), F.lit(1).alias("side"), "node", "vec", "copies",
        F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("missed"))
    dealt = held.unionByName(asked).repartition("label", "sublist", "block").sortWithinPartitions(
        "label", "sublist", "block", "side")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block_ = None, None
        for part in parts:
            keys = list(zip(*(part.column(n).to_pylist() for n in range(4)), strict=True))
            edges = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                some = part.slice(a, b - a)
                if keys[a][:3] != place:
                    if block_ is not None:
                        yield from block_.close()
                    place, block_ = keys[a][:3], Block(shared.value, dim, cosine, keys[a][1])
                yield from block_.hold(some) if keys[a][3] == 0 else block_.ask(some)
        if block_ is not None:
            yield from block_.close()

    found = landed(dealt.mapInArrow(compare, "a string, b string, links bigint"), "vector-links")
    balls = filed.filter("sublist % 2 = 1").join(sizes, in_list)
    counts = found.filter("b is null").select(F.col("a").alias("node"), "links").unionByName(
        balls.select("node", (F.col("total") - F.col("copies")).alias("links")))
    pairs = found.filter("b is not null").select("a", "b").unionByName(
        balls.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    return counts, pairs


class Block:
    """Vectors of one block of a sublist, and the links that are found in it."""

    def __init__(self, index: Index, dim: int, cosine: float, sublist: int):
        self.index, self.dim, self.cosine, self.sublist = index, dim, cosine, sublist
        self.held: list[pa.RecordBatch] = []
        self.names: np.ndarray | None = None

    def hold(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.held.append(part)
        return iter(())

    def _ready(self) -> Iterator[pa.RecordBatch]:
        if self.names is not None:
            return
        whole = pa.Table.from_batches(self.held).combine_chunks()
        self.held = []
        self.names = np.array(whole["node"].to_pylist(), object)
        self.vectors = matrix(whole["vec"].combine_chunks(), self.dim)
        self.copies = np.asarray(whole["copies"])
        self.missed = np.asarray(whole["missed"])
        self.codes = np.frombuffer(b"".join(whole["code"].to_pylist()), np.uint8).reshape(len(self.names), -1)
        self.count = np.zeros(len(self.names), np.int64)
        if self.sublist % 2 == 0:  # a ball's own vectors are linked without comparing them
            for at in range(0, len(self.names), CHUNK):
                yield from self._meet(self.names[at:at + CHUNK], self.vectors[at:at + CHUNK],
                                      self.copies[at:at + CHUNK], at)

    def ask(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.names is None and not self.held:
            return
        yield from self._ready()
        names = np.array(part.column(4).to_pylist(), object)
        vectors, copies = matrix(part.column(5), self.dim), np.asarray(part.column(6))
        for at in range(0, len(names), CHUNK):
            yield from self._meet(names[at:at + CHUNK], vectors[at:at + CHUNK], copies[at:at + CHUNK], None)

    def _meet(self, names: np.ndarray, probes: np.ndarray, copies: np.ndarray,
              first: int | None) -> Iterator[pa.RecordBatch]:
        """``first``: place of the probes in the block itself; then each pair is met once."""
        near = self.index.bounds(directions(probes), self.sublist // 2, self.codes, self.missed) <= (
            self.index.reach + SLACK)
        if first is not None:
            near &= np.arange(len(self.names)) > first + np.arange(len(names))[:, None]
        i, j = np.nonzero(near)
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), PAIRS):
            to = slice(at, at + PAIRS)
            good[to] = cosines(probes[i[to]], self.vectors[j[to]]) >= self.cosine
        i, j = i[good], j[good]
        if not len(i):
            return
        mine = np.zeros(len(names), np.int64)
        np.add.at(mine, i, self.copies[j])
        np.add.at(self.count, j, copies[i])
        both = np.concatenate([names, self.names])
        root = stars(i, len(names) + j, len(both))
        linked = np.flatnonzero(root != np.arange(len(both)))
        yield self._rows(both[root[linked]], both[linked], np.zeros(len(linked), np.int64))
        some = np.flatnonzero(mine)
        yield self._rows(names[some], np.full(len(some), None), mine[some])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.names is None and self.held:
            yield from self._ready()
        if self.names is not None:
            some = np.flatnonzero(self.count)
            yield self._rows(self.names[some], np.full(len(some), None), self.count[some])

    @staticmethod
    def _rows(a: np.ndarray, b: np.ndarray, links_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(links_, pa.int64())], names=["a", "b", "links"])


def near_duplicates(table: DataFrame, keep: list[str], *, by: str = "vec_id", vector: str = "embedding",
                    label: str = "label", cosine: float = 0.98, sample: int = 16_384, per_list: int = 256,
                    most_lists: int = 1024, subspaces: int = 8) -> DataFrame:
    """The kept columns and ``n_links``, ``component_id`` (smallest ``by`` reachable) and ``kept`` of every row.

    The index is trained on at most ``sample`` distinct vectors, those of the least digest, with one list for
    ``per_list`` distinct vectors of the largest label, ``most_lists`` at most. ``cosine`` must be above 0."""
    clash = set(keep) & set(RESULT)
    if clash or not 0 < cosine <= 1:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}" if clash else "cosine not in (0, 1]")
    spark = table.sparkSession
    known = nodes_of(table, keep, by, vector, label)
    rows = landed(known.select("row", "by", "node"), "vector-rows")
    distinct = landed(known.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"),
        F.min("by").alias("first")), "distinct-vectors")
    dim = -(-max(width(distinct, "vec"), 1) // subspaces) * subspaces
    chosen = matrix(distinct.orderBy("node").limit(sample).select("vec").toArrow()["vec"].combine_chunks(), dim)
    own = F.coalesce("row_links", F.lit(0).cast("bigint"))
    if not len(chosen):
        linked = spark.createDataFrame([], distinct.select(
            F.col("node").alias("linked"), F.col("copies").alias("row_links"), F.col("first").alias("root_id")).schema)
    else:
        largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0]
        lists = min(most_lists, max(1, largest // per_list))
        index = build(directions(chosen), cosine, lists, subspaces)
        counts, pairs = links(distinct.select("node", "label", "vec", "copies"), index, dim, cosine)
        total = counts.groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))
        roots = landed(components(pairs).select(F.col("node").alias("rooted"), "root"), "vector-roots")
        known_nodes = distinct.select("node", "copies", "first")
        placed = landed(known_nodes.join(roots, F.col("node") == F.col("rooted"), "left").join(
            total, F.col("node") == F.col("counted"), "left").select(
            "node", F.coalesce("root", "node").alias("root"), "first",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("row_links")).filter(
            F.col("row_links") > 0), "linked-vectors")
        smallest = placed.groupBy(F.col("root").alias("class")).agg(F.min("first").alias("root_id"))
        linked = landed(placed.join(smallest, F.col("root") == F.col("class")).select(
            F.col("node").alias("linked"), "row_links", "root_id"), "vector-classes")
    least = F.when(F.col("linked").isNull(), F.col("by")).otherwise(F.col("root_id"))
    return rows.join(linked, F.col("node") == F.col("linked"), "left").select(
        "row.*", own.alias("n_links"), least.alias("component_id"),
        F.coalesce(F.col("by") == least, F.lit(False)).alias("kept"))
