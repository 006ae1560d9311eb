"""SimHash near-duplicates found through a byte-position inverted index with count filtering.

A fingerprint has 64 bits over XXH64 of the text's word shingles. Fingerprints that differ in at most 3 bits
differ in at most 3 of their 8 bytes, so they share at least 5 bytes at their positions. Postings of single
positional bytes would each hold 1/256 of all documents; the index therefore posts a fingerprint under
four positional bytes at once, for the 14 sets of four positions whose numbers have the exclusive or 0.
Any three positions lie in exactly one of these sets, and its complement is one of them too, so a pair
that shares five positional bytes meets in at least one posting list. Inside a list the shared positional
bytes of each pair are tallied, pairs with fewer than 5 are left, and the rest is verified by its bits.

Equal fingerprints are one entry of the index. A posting list gives only the links that join its own
fingerprints into groups, never all pairs. Long lists are cut into blocks whose pairs of blocks are
compared in different tasks. Components come from rounds over the links, landed in the shared folder each;
nothing of this is collected.

Defined cases
    A null text is an empty one. Texts without words have the fingerprint 0 and link like any other.
    Texts with fewer words than a shingle are one shingle of all their words. Repeats count.
    Rows alike, or of equal id, are one class each with what they link to; a null id is never the class's
    id unless its class has no other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import row_digest
from wiretally.llm.components import components
from wiretally.session import landed

SEED = 42
TOGETHER = 400_000
#: Sets of four byte positions with exclusive or 0: every three positions lie in exactly one.
POSTINGS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Fingerprints of one posting list that are compared in one piece.
BLOCK = 2048


def hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every word shingle of the text, A-Z in lower case."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if len(words) < width:
        return [digest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:len(ends) - width])]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:], strict=True)]


def fingerprints(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is 1 where it is set in over half of a text's hashes."""
    out = np.zeros(len(texts), np.uint64)
    found, sizes, rows = [], [], []
    total = 0

    def settle() -> None:
        nonlocal found, sizes, rows, total
        if sizes:
            bits = np.unpackbits(np.array(found, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            set_ = (sums * 2 > np.array(sizes)[:, None]).astype(np.uint8)
            out[rows] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
        found, sizes, rows, total = [], [], [], 0

    for i, text in enumerate(texts):
        got = hashes(text or b"", width)
        if got:
            found += got
            sizes.append(len(got))
            rows.append(i)
            if len(found) >= TOGETHER:
                settle()
    settle()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, columns: list[str], width: int = 3) -> DataFrame:
    """The named columns of ``docs`` and ``fp`` of the whole text."""
    kept = docs.select(*columns, F.col("text").cast("binary").alias("shingled_text"))
    schema = docs.select(*columns, F.lit(0).cast("bigint").alias("fp")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = fingerprints(part.column(len(columns)).to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(columns))), pa.array(got)], names=[*columns, "fp"])

    return kept.mapInArrow(run, schema)


def posting_keys(fp: Column) -> Column:
    """The 14 keys of a fingerprint: the number of the set, then the bytes at its positions."""
    def byte(at: int, to: int) -> Column:
        return F.shiftleft(F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255)), 8 * to)

    keys = []
    for n, places in enumerate(POSTINGS):
        key = F.lit(n << 32).cast("bigint")
        for to, at in enumerate(places):
            key = key.bitwiseOR(byte(at, to))
        keys.append(key)
    return F.array(*keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes into the same groups, fewer than the nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            kept.append(i)
    return a[kept], b[kept]


def near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Pairs (rows of two equally long arrays) that pass the count filter and then the bits."""
    differ = x ^ y
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    passed = shared >= 8 - distance
    passed[passed] = np.bitwise_count(differ[passed]) <= distance
    return passed


def list_links(fps: np.ndarray, sides: np.ndarray, across: bool, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links inside one list, or across the two sides of a pair of blocks."""
    left, right = (fps[~sides], fps[sides]) if across else (fps, fps)
    a, b = [], []
    for i, x in enumerate(left):
        others = right if across else right[i + 1:]
        hit = others[near(np.full(len(others), x), others, distance)]
        a.append(np.full(len(hit), x))
        b.append(hit)
    none = np.zeros(0, np.uint64)
    return forest(np.concatenate([none, *a]), np.concatenate([none, *b]))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b``: links that join all fingerprints of ``fps`` (distinct ``fp``) at ``distance`` or fewer bits into
    the same groups as all links would. ``distance`` is at most 3, what the posting lists guarantee."""
    if not 0 <= distance <= 3:
        raise ValueError("the posting lists guarantee up to 3 differing bits")
    posted = fps.select("fp", F.explode(posting_keys(F.col("fp"))).alias("k"))
    long = landed(posted.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(
        F.col("k").alias("long_k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "long-postings")
    cut = posted.join(long, F.col("k") == F.col("long_k"), "left").select(
        "k", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn(
        "mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = cut.select("k", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "k", "fp", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        (F.col("mine") > F.col("other")).alias("side"))
    lists = dealt.repartition("k", "low", "high").sortWithinPartitions("k", "low", "high", "fp")

    def compare(k: np.ndarray, fp: np.ndarray, side: np.ndarray, across: np.ndarray, first: np.ndarray
                ) -> pa.RecordBatch:
        sizes = np.diff(np.append(first, len(k)))
        a, b = [], []
        short = np.repeat((sizes <= 64) & ~across[first], sizes)
        group = np.repeat(np.arange(len(first)), sizes)
        for step in range(1, 64):  # short lists: every row against the one step further on
            both = short[:-step] & (group[:-step] == group[step:])
            if not both.any():
                break
            x, y = fp[:-step][both], fp[step:][both]
            hit = near(x, y, distance)
            a.append(x[hit])
            b.append(y[hit])
        for g in np.flatnonzero((sizes > 64) | across[first]):
            part = slice(first[g], first[g] + sizes[g])
            x, y = list_links(fp[part], side[part], bool(across[first[g]]), distance)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([none, *v]).view(np.int64)) for v in (a, b)], names=["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for part in parts:
            k, fp, low, high, side = (part.column(c).to_numpy(zero_copy_only=False)
                                      for c in ("k", "fp", "low", "high", "side"))
            now = [k, fp.view(np.uint64), low, high, side]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            first = starts(now)
            done = first[-1]  # the last list may go on in the next batch
            if done:
                cut_ = [x[:done] for x in now]
                yield compare(cut_[0], cut_[1], cut_[4], cut_[2] != cut_[3], first[:-1])
            held = [x[done:] for x in now]
        if held is not None and len(held[0]):
            yield compare(held[0], held[1], held[4], held[2] != held[3], starts(held))

    def starts(cols: list[np.ndarray]) -> np.ndarray:
        k, _, low, high, _ = cols
        new = (k[1:] != k[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    return lists.mapInArrow(run, "a bigint, b bigint")


def classes(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``fp, root, component_id`` of each fingerprint of ``prints`` (``doc_id, fp``): its class's least
    fingerprint and the least id it links to."""
    per_fp = landed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = landed(components(links(per_fp.select("fp"), distance)), "components")
    rooted = per_fp.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return landed(rooted.join(ids, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, *, width: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    prints = landed(with_fingerprint(docs, ["doc_id"], width), "prints")
    found = classes(prints, distance).withColumnRenamed("fp", "class_fp")
    return prints.join(found, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, *, width: int = 3, distance: int = 3) -> DataFrame:
    """One document of each near-duplicate class: that of the least id, then text hash. All columns stay."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), row_digest().alias("digest"))
    prints = landed(with_fingerprint(
        docs.select("doc_id", "text", row_digest().alias("digest")), ["doc_id", "digest"], width), "prints")
    found = classes(prints, distance).withColumnRenamed("fp", "class_fp")
    best = prints.join(found, F.col("fp") == F.col("class_fp")).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("best"))
    winners = landed(best.select(F.col("best.digest").alias("kept_digest")), "kept")
    same = Window.partitionBy("digest").orderBy("digest")
    stay = packed.join(winners, F.col("digest") == F.col("kept_digest"), "leftsemi").withColumn(
        "nth", F.row_number().over(same)).filter("nth = 1")
    return stay.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
