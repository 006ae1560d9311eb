"""Long repeated passages, found with run-length indexes.

Every byte covered by a string of ``length`` bytes that also starts at another place is marked.

Windows of ``length`` bytes are assigned to the place of their least gram hash (the leftmost of equal
ones), their anchor; equal windows have equal anchors at the same offset. Anchors whose gram occurs
once cannot hold a repeated window and are dropped after a count of hashes. The windows of one anchor in one
text form a context of at most ``2 * length`` bytes. Equal contexts are merged and counted before they
move, so a passage that very many texts share is one row with a count.

The differing contexts of the same grams meet in one index: their concatenation's Burrows-Wheeler
transform, of which only the runs are kept with the text places sampled at their ends. The common prefix
of a suffix with its neighbour in the sorted order is computed at the run ends only; between two samples it
shrinks by one per place, which streams the matching statistics of the whole text in one pass. A window
is repeated where that statistic reaches ``length`` or where its context occurs more than once.

A gram with more differing contexts than one index takes (``GROUP``) is settled without an index: its
windows are counted by a 128-bit hash, with the same result.

Defined cases
    A null text is empty. Texts shorter than ``length`` bytes have nothing to remove but take part.
    Rows alike in id and text are different places, so all their windows repeat. Overlapping places of
    one text count. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import row_digest
from wiretally.session import landed

#: Bytes of a gram. A longer gram is repeated more rarely where no window is, but gives more anchors.
GRAM = 128
#: Bytes of texts searched for anchors together, and bytes of contexts indexed together.
TOGETHER = 1 << 20
INDEXED = 1 << 20
#: Context bytes of one task that builds indexes.
PER_TASK = 4 << 20
#: Bytes of differing contexts of one gram that are indexed together.
GROUP = 1 << 21


def row_key() -> Column:
    return F.unhex(row_digest())


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _grams(buffer: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at every place of a buffer, by doubling from 8 bytes; ``size`` is
    a sum of two powers of two, or one, of at least 8."""
    n = len(buffer) - 7
    hashes, width = {8: np.ndarray((n,), "<u8", buffer, 0, (1,))}, 8
    while width * 2 <= size:
        h = hashes[width]
        hashes[width * 2] = _mix(h[:-width], h[width:])
        width *= 2
    rest = size - width
    return _mix(hashes[width][:-rest], hashes[rest][width:]) if rest else hashes[width]


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    shaped = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(shaped, axis=1).ravel()
    back = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of windows with one anchor: number of the text, first and last window, hash of the gram."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return none, none, none, none.view(np.uint64)
    buffer = np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8)
    h = _grams(buffer, GRAM)
    place = np.arange(len(h), dtype=np.uint64)
    least = _window_min((h & np.uint64(0xFFFFFFFF00000000)) | place, length - GRAM + 1)
    windows = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + starts[row]
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
    rows = row[first]
    return rows, at[first] - starts[rows], at[last] - starts[rows], h[anchor[first]]


def groups(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about TOGETHER bytes, each with the number of its first."""
    start, size, group = 0, 0, []
    for i, text in enumerate(texts):
        group.append(text or b"")
        size += len(group[-1])
        if size >= TOGETHER:
            yield start, group
            start, size, group = i + 1, 0, []
    if group:
        yield start, group


def anchor_table(keyed: DataFrame, length: int) -> DataFrame:
    """``row, gram, first, last`` of ``keyed`` (``row, body``)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, group in groups(part.column("body").to_pylist()):
                rows, first, last, h = anchors(group, length)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(rows + start)), pa.array(h.view(np.int64)),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    names=["row", "gram", "first", "last"])

    return keyed.mapInArrow(run, "row binary, gram bigint, first int, last int")


def context_table(keyed: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """``gram, context, row, first, last, body``: every context of a repeated gram; its bytes only where a
    task meets them for the first time."""
    import hashlib

    per_row = repeated.groupBy(F.col("row").alias("anchored")).agg(
        F.collect_set(F.struct("gram", "first", "last")).alias("found"))
    joined = keyed.join(per_row, F.col("row") == F.col("anchored")).select("row", "body", "found")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for part in parts:
            bodies, found = part.column("body").to_pylist(), part.column("found")
            out: list[tuple] = []
            keys = part.column("row").to_pylist()
            for i, body in enumerate(bodies):
                for a in found[i].as_py():
                    content = body[a["first"]:a["last"] + length]
                    digest = hashlib.md5(content).digest()
                    new = digest not in met
                    if new and len(met) < 500_000:
                        met.add(digest)
                    out.append((a["gram"], digest, keys[i], a["first"], a["last"], content if new else None))
                if len(out) >= 20_000 or i == len(bodies) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                            pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                        names=["gram", "context", "row", "first", "last", "body"]) if out else EMPTY
                    out = []

    return joined.mapInArrow(run, "gram bigint, context binary, row binary, first int, last int, body binary")


EMPTY = pa.RecordBatch.from_arrays(
    [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())],
    names=["gram", "context", "row", "first", "last", "body"])


class RunIndex:
    """The run-compressed transform of a text: the heads and tails of the runs of equal preceding bytes in the
    sorted order of suffixes, with the text places sampled there and the common prefixes across the borders."""

    def __init__(self, text: np.ndarray) -> None:
        self.n = n = len(text)
        order, levels = self._sorted(text)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # nothing precedes the begin of the text
        border = np.flatnonzero(before[1:] != before[:-1])
        above, below = order[border], order[border + 1]
        common = self._common(text, levels, above, below)
        # A tail is followed by another run, a head is preceded by one; the ends of the order have no neighbour.
        self.tails, self.tail_common = np.append(above, order[-1]), np.append(common, 0)
        self.heads, self.head_common = np.append(below, order[0]), np.append(common, 0)

    @staticmethod
    def _sorted(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by doubling; and for every width the ranks of all places by that many bytes."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        first = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
        order = np.argsort(first, kind="stable")
        keys, index, base = first[order], order, np.zeros(n, np.int64)
        rank = np.zeros(n + 1, np.int64)
        rank[n] = -1
        at = np.arange(n)
        levels, width = [], 8
        while True:
            head = np.concatenate([[True], (keys[1:] != keys[:-1]) | (base[1:] != base[:-1])])
            rank[index] = np.maximum.accumulate(np.where(head, at, 0))
            levels.append((width, rank.astype(np.int32)))
            tail = np.append(head[1:], True)
            open_ = ~(head & tail)
            if not open_.any():
                return order, levels
            index, at = index[open_], at[open_]
            base = rank[index]
            keys = rank[np.minimum(index + width, n)]
            turn = np.argsort(base * (n + 2) + keys + 1, kind="stable")
            index, base, keys = index[turn], base[turn], keys[turn]
            order[at] = index
            width *= 2

    def _common(self, text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray
                ) -> np.ndarray:
        """Length of the common prefix of the suffixes at places a and b."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for width, rank in reversed(levels):
            same = rank[np.minimum(a, self.n)] == rank[np.minimum(b, self.n)]
            total[same] += width
            a[same] += width
            b[same] += width
        live = np.ones(len(a), bool)
        for _ in range(7):
            live &= (a < self.n) & (b < self.n)
            live[live] = text[a[live]] == text[b[live]]
            total += live
            a += live
            b += live
        return total

    def statistics(self) -> np.ndarray:
        """For every place the longest string there that also starts elsewhere: streamed from the samples,
        one less per place since the last sample, for the neighbours before and after in the order."""
        best = np.zeros(self.n, np.int64)
        for places, common in ((self.heads, self.head_common), (self.tails, self.tail_common)):
            last = np.full(self.n, -1, np.int64)
            value = np.zeros(self.n, np.int64)
            last[places] = places
            value[places] = common
            last = np.maximum.accumulate(last)
            now = np.where(last >= 0, value[np.maximum(last, 0)] - (np.arange(self.n) - last), 0)
            best = np.maximum(best, now)
        return best


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Per context the ranges (from, to; to exclusive) of window starts that start elsewhere in ``contexts`` too."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    left = np.repeat(ends, sizes + 1) - np.arange(len(text))
    hit = (np.minimum(RunIndex(text).statistics(), left) >= length).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))).reshape(-1, 2)
    owner = np.searchsorted(ends, edges[:, 0])
    edges = edges - (ends - sizes)[owner][:, None]
    return [edges[owner == i] for i in range(len(contexts))] if len(edges) else [edges] * len(contexts)


def indexed(contexts: DataFrame, tasks: int, length: int) -> DataFrame:
    """``context, from, to``: repeated windows of the differing contexts (``gram, context, body``) of each gram."""
    dealt = contexts.repartition(tasks, "gram").sortWithinPartitions("gram", "context")

    def settle(keys: list[bytes], bodies: list[bytes]) -> pa.RecordBatch:
        found = repeated_windows(bodies, length)
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, f in zip(keys, found, strict=True) for _ in f], pa.binary()),
            pa.array([int(x[0]) for f in found for x in f], pa.int32()),
            pa.array([int(x[1]) for f in found for x in f], pa.int32())], names=["context", "from", "to"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        bodies: list[bytes] = []
        size, gram, last = 0, None, None
        for part in parts:
            for g, k, body in zip(*(part.column(c).to_pylist() for c in ("gram", "context", "body")), strict=True):
                if k == last:
                    continue  # the same context, met first by several tasks
                if g != gram and size >= INDEXED:
                    yield settle(keys, bodies)
                    keys, bodies, size = [], [], 0
                gram, last = g, k
                keys.append(k)
                bodies.append(body)
                size += len(body)
        if keys:
            yield settle(keys, bodies)

    return dealt.mapInArrow(run, "context binary, `from` int, `to` int")


def counted(contexts: DataFrame, length: int) -> DataFrame:
    """Like ``indexed``, by counting the windows of each context (distinct ones) by their hash."""
    import hashlib

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, body in zip(part.column("context").to_pylist(), part.column("body").to_pylist(), strict=True):
                n = len(body) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, pa.binary()), pa.array(range(n), pa.int32()),
                     pa.array([hashlib.md5(body[i:i + length]).digest() for i in range(n)], pa.binary())],
                    names=["context", "at", "window"])

    distinct = contexts.select("context", "body").dropDuplicates(["context"])
    windows = landed(distinct.mapInArrow(run, "context binary, at int, window binary"), "windows")
    often = windows.groupBy(F.col("window").alias("often")).agg(F.count("*").alias("n")).filter("n > 1")
    return windows.join(often, F.col("window") == F.col("often"), "leftsemi").select(
        "context", F.col("at").alias("from"), (F.col("at") + 1).alias("to"))


def marks(keyed: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """``marked`` (a row's key) and ``spans``: its byte ranges (from, to), which may overlap."""
    found = landed(anchor_table(keyed, length), "anchors")
    often = landed(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("gram").alias("often")), "grams")
    repeated = found.join(often, F.col("gram") == F.col("often"), "leftsemi")
    contexts = landed(context_table(keyed, repeated, length), "contexts")

    size = F.col("last") - F.col("first") + length
    counts = landed(contexts.groupBy("context", "gram").agg(
        F.count("*").alias("n"), F.max(size).cast("bigint").alias("size")), "context-counts")
    mixed = landed(counts.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("size").alias("size")).filter(
        "kinds > 1").select(F.col("gram").alias("mixed"), (F.col("size") > group).alias("large"), "size"), "mixed-grams")
    total = {r["large"]: r["size"] for r in mixed.groupBy("large").agg(F.sum("size").alias("size")).collect()}
    bodies = contexts.filter("body is not null").select("gram", "context", "body").join(
        mixed.select("mixed", "large"), F.col("gram") == F.col("mixed"))
    whole = counts.filter("n > 1").select(
        "context", F.lit(0).alias("from"), (F.col("size") - length + 1).cast("int").alias("to"))
    if total.get(False):
        whole = whole.unionByName(indexed(
            bodies.filter("not large"), max(1, -(-total[False] // PER_TASK)), length))
    if total.get(True):
        whole = whole.unionByName(counted(bodies.filter("large"), length))
    verdicts = landed(whole.withColumnRenamed("context", "judged"), "verdicts")
    spans = contexts.select("context", "row", "first").join(verdicts, F.col("context") == F.col("judged")).select(
        "row", F.struct((F.col("first") + F.col("from")).alias("from"),
                        (F.col("first") + F.col("to") - 1 + length).alias("to")).alias("span"))
    return spans.groupBy(F.col("row").alias("marked")).agg(F.collect_set("span").alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, *, length: int = 400, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, spans`` (removed runs) and ``kept`` (remaining bytes) of every document."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM} bytes")
    keyed = docs.select("doc_id", row_key().alias("row"), F.col("text").cast("binary").alias("body"))
    found = marks(keyed.select("row", "body"), length, group)
    joined = keyed.join(found, F.col("row") == F.col("marked"), "left").select("doc_id", "body", "spans")
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, spans, kept = [], [], []
            for body, found_ in zip(part.column("body").to_pylist(), part.column("spans"), strict=True):
                body = body or b""
                runs = merged([(s["from"], s["to"]) for s in found_.as_py() or []])
                at, rest = 0, []
                for a, b in runs:
                    rest.append(body[at:a])
                    at = b
                rest.append(body[at:])
                sizes.append(len(body))
                spans.append([{"from": a, "to": b} for a, b in runs])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        run, f"doc_id {id_type}, n_bytes bigint, spans array<struct<`from`: int, `to`: int>>, kept binary")
