"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The 3-bit fingerprints of ``simhash`` are all linked, as its postings guarantee. Of pairs that differ by a few
words most lie further apart, so each text also gets 400 minima of seeded permutations of its shingle hashes, eight to
a band. A pair of similarity s shares none of the 50 bands with probability (1 - s^8)^50: 1 in 10,000 at 0.8,
less above; at 0.5 it shares one with probability 0.18. Texts that share a band are candidates, and a candidate links by
its exact similarity only.

Each text of a band is compared with the band's least text first, its hub, unless both are in one class already. What is
still apart from the hub's class after that is compared with the texts of other classes in the band, in blocks: a task holds
the shingle sets of a block, streams the others past it and gives back no more links than join classes. A pair that shares
several bands is compared in one of them. So sets move, once for each hub or block, but pairs never do, and similar
texts are in one class at the end, the same as if every pair of a band were compared.

Defined cases
    Equal texts are one node, numbered by 64 bits of their MD5. A null text is an empty one. Texts without words have no
    shingles and link by their fingerprint only. Texts of under five words are one shingle of all their words.
    Of a class the row of the least id, then text hash, stays; a null id only where no other is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm import simhash
from wiretally.llm.common import row_digest, text_of
from wiretally.llm.components import components
from wiretally.session import landed

WIDTH = 5
BANDS, ROWS = 50, 8
#: Texts compared with one hub in one piece, and texts still apart that a task holds at once.
PIECE, HELD = 1024, 256
#: Odd factors and summands of the permutations x -> a * x + b of 64-bit numbers.
_SEEDED = np.random.default_rng(simhash.SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FACTORS, SUMMANDS = _SEEDED[0] | np.uint64(1), _SEEDED[1]
#: Shingles permuted at once.
CHUNK = 2048


def shingles(text: bytes) -> np.ndarray:
    """The set of a text's shingle hashes, sorted."""
    return np.unique(np.array(simhash.hashes(text, WIDTH), np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """One signed number for each band of a set of shingles; none for an empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        moved = FACTORS[:, None] * found[None, at:at + CHUNK] + SUMMANDS[:, None]
        least = np.minimum(least, moved.min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, not both empty, have a Jaccard similarity of at least 0.8."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def node_of() -> Column:
    """The number of a text."""
    half = [F.conv(F.substring(F.md5(text_of()), at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def with_bands(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, node, fp, size, bands`` of every document."""
    kept = docs.select("doc_id", row_digest().alias("digest"), node_of().alias("node"),
                       F.col("text").cast("binary").alias("shingled_text"))
    schema = kept.select("doc_id", "digest", "node", F.lit(0).cast("bigint").alias("fp"), F.lit(0).alias("size"),
                         F.array(F.lit(0).cast("bigint")).alias("bands")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(3).to_pylist()
            sizes, keys = [], []
            for text in texts:
                found = shingles(text or b"")
                sizes.append(len(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(simhash.fingerprints(texts)),
                 pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "node", "fp", "size", "bands"])

    return kept.mapInArrow(run, schema)


def with_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (``node, digest``: of one document with its text) with ``set``, the text's sorted shingle hashes."""
    texts = docs.select(row_digest().alias("of"), F.col("text").cast("binary").alias("text"))
    chosen = texts.join(wanted.select("node", "digest"), F.col("of") == F.col("digest")).select("node", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingles(t or b"").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    return chosen.mapInArrow(run, "node bigint, set binary").dropDuplicates(["node"])


class Held:
    """Texts that one group of others is compared with, and the classes joined so far."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.found: list[np.ndarray] = []
        self.roots: list[int] = []
        self.bands: list[list[int] | None] = []
        self.up: dict[int, int] = {}
        self.now: np.ndarray | None = None

    def add(self, node: int, root: int, found: bytes, bands_: list[int] | None) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.found.append(np.frombuffer(found, np.uint64))
        self.bands.append(bands_)

    def root(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def meet(self, key: int, node: int, root: int, apart: bool, found: bytes, bands_: list[int] | None) -> list[int]:
        """Held nodes similar to a text, one for each class that it joins to its own."""
        if self.now is None:
            self.now = np.array(self.roots)
            self.sizes = np.array([len(f) for f in self.found])
            self.names = np.array(self.nodes)
            self.keys = np.array(self.bands) if self.bands and self.bands[0] is not None else None
        mine = np.frombuffer(found, np.uint64)
        own = self.root(root)
        chosen = (self.now != own) & (5 * np.minimum(self.sizes, len(mine)) >= 4 * np.maximum(self.sizes, len(mine)))
        if apart:  # the other one is held as well, in this block or another, and meets this one there
            chosen &= self.names < node
        at = np.flatnonzero(chosen)
        if len(at) and self.keys is not None:  # of the bands that a pair shares, only the first compares it
            first = (self.keys[at] == np.array(bands_)).argmax(axis=1)
            at = at[self.keys[at, first] == key]
            at = at[(self.keys[at] == np.array(bands_)).any(axis=1)] if len(at) else at
        if not len(at):
            return []
        flat = np.concatenate([self.found[i] for i in at])
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        starts = np.concatenate([[0], np.cumsum(self.sizes[at])[:-1]])
        both = np.add.reduceat(mine[place] == flat, starts, dtype=np.int64)
        out = []
        for i in at[5 * both >= 4 * (self.sizes[at] + len(mine) - both)].tolist():
            other = int(self.now[i])
            if other != own:
                out.append(self.nodes[i])
                self.up[other] = own
                self.now[self.now == other] = own
        return out


def compared(dealt: DataFrame) -> DataFrame:
    """Links ``a, b`` between the held rows (``side`` 0) and the others of each ``key, block``."""
    ordered = dealt.select("key", "block", "side", "node", "root", "apart", "set", "bands").repartition(
        "key", "block").sortWithinPartitions("key", "block", "side")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, Held()
        for part in parts:
            links: list[tuple[int, int]] = []
            for key, block, side, node, root, apart, found, bands_ in zip(
                    *(c.to_pylist() for c in part.columns), strict=True):
                if (key, block) != place:
                    place, held = (key, block), Held()
                if side == 0:
                    held.add(node, root, found, bands_)
                elif held.nodes:
                    links += [(node, other) for other in held.meet(key, node, root, apart, found, bands_)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                names=["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def close_sizes(x: str, y: str) -> Column:
    """Sets of other sizes cannot be similar."""
    return F.least(x, y).cast("bigint") * 5 >= F.greatest(x, y).cast("bigint") * 4


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes."""
    roots = components(links).withColumnRenamed("node", "linked")
    return nodes.join(roots, F.col("node") == F.col("linked"), "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def blocks_of(groups: DataFrame, size: int) -> DataFrame:
    """``of_key, blocks`` of groups counted as ``key, n``."""
    return groups.select(F.col("key").alias("of_key"), F.ceil(F.col("n") / size).cast("int").alias("blocks"))


def spread_over(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of each ``key`` dealt to its blocks."""
    return rows.join(blocks, F.col("key") == F.col("of_key")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def repeated_over(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of each ``key`` in all of its blocks."""
    return rows.join(blocks, F.col("key") == F.col("of_key")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def star_links(members: DataFrame, sets: DataFrame, now: DataFrame) -> DataFrame:
    """Links of the texts of each band to its hub, where they are in different classes and similar."""
    pairs = members.filter("node <> hub").select("node", "hub").distinct()
    hub = now.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"), F.col("size").alias("hub_size"))
    stars = landed(pairs.join(hub, "hub").join(now, "node").filter(
        (F.col("root") != F.col("hub_root")) & close_sizes("size", "hub_size")).select(
        F.col("hub").alias("key"), "node", "root", "hub_root"), "stars")
    counted = landed(stars.groupBy("key").agg(F.count("*").alias("n"), F.min("hub_root").alias("root")), "hubs")
    blocks = blocks_of(counted, PIECE)
    held = repeated_over(counted.select("key", F.col("key").alias("node"), "root"), blocks)
    asked = spread_over(stars, blocks)
    same = F.lit(False).alias("apart"), F.lit(None).cast("array<bigint>").alias("bands")
    rows = held.select("key", "block", F.lit(0).alias("side"), "node", "root", *same).unionByName(
        asked.select("key", "block", F.lit(1).alias("side"), "node", "root", *same))
    return compared(rows.join(sets.select("node", "set"), "node"))


def other_links(members: DataFrame, sets: DataFrame, now: DataFrame) -> DataFrame:
    """Links of the texts of each band that are not in its hub's class to those in other classes."""
    hub = now.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    placed = landed(members.join(now.select("node", "root"), "node").join(hub, "hub").select(
        F.col("k").alias("key"), "node", "root", (F.col("root") != F.col("hub_root")).alias("apart")), "placed")
    counted = landed(placed.groupBy("key").agg(F.sum(F.col("apart").cast("int")).alias("n")).filter("n > 0"), "apart")
    blocks = blocks_of(counted, HELD)
    held = spread_over(placed.filter("apart"), blocks).withColumn("side", F.lit(0))
    rows = held.unionByName(repeated_over(placed, blocks).withColumn("side", F.lit(1)))
    return compared(rows.join(sets.select("node", "set", "bands"), "node"))


def classes(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``prints``, by its fingerprints and by the similarity of its texts."""
    nodes = landed(prints.groupBy("node").agg(
        F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("digest").alias("digest"),
        F.first("bands").alias("bands")), "nodes")
    by_print = simhash.classes(nodes.select(F.col("node").alias("doc_id"), "fp"))
    links = nodes.join(by_print.select(F.col("fp").alias("class_fp"), F.col("component_id").alias("a")),
                       F.col("fp") == F.col("class_fp")).select("a", F.col("node").alias("b")).filter("a <> b")
    links = landed(links, "print-links")
    narrow = nodes.select("node", "size")
    now = landed(narrow.join(rooted(narrow.select("node"), links), "node"), "print-classes")

    posted = nodes.select("node", F.explode("bands").alias("k"))
    shared = posted.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub < most")
    hubs = landed(shared.select(F.col("k").alias("shared_k"), "hub"), "shared-bands")
    members = landed(posted.join(hubs, F.col("k") == F.col("shared_k")).select("k", "node", "hub"), "members")
    wanted = nodes.select("node", "digest", "bands").join(members.select("node").distinct(), "node", "leftsemi")
    found = with_sets(wanted, docs).withColumnRenamed("node", "of_node")
    sets = landed(wanted.join(found, F.col("node") == F.col("of_node")).select("node", "set", "bands"), "sets")

    links = landed(links.unionByName(star_links(members, sets, now)), "star-links")
    now = landed(narrow.join(rooted(narrow.select("node"), links), "node"), "star-classes")
    links = links.unionByName(landed(other_links(members, sets, now), "other-links"))
    return landed(rooted(narrow.select("node"), links), "near-classes")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class of near copies. All columns stay."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), row_digest().alias("digest"))
    prints = landed(with_bands(docs), "prints")
    found = classes(prints, docs).withColumnRenamed("node", "class_node")
    best = prints.join(found, F.col("node") == F.col("class_node")).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("best"))
    winners = landed(best.select(F.col("best.digest").alias("kept_digest")), "kept")
    same = Window.partitionBy("digest").orderBy("digest")
    stay = packed.join(winners, F.col("digest") == F.col("kept_digest"), "leftsemi").withColumn(
        "nth", F.row_number().over(same)).filter("nth = 1")
    return stay.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
