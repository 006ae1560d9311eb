"""Packing token sequences into batches with little padding, by optimal length buckets.

Texts longer than ``max_len`` tokens are cut into pieces. Dynamic programming over the histogram of all
pieces' lengths chooses the bucket boundaries that minimise padding, every piece being padded to the
boundary of its bucket. Inside a bucket pieces stand in a hash-seeded order, and each ``budget //
boundary`` in a row form one batch.

A token is a run of characters other than ASCII white space. The histogram has at most ``max_len`` rows,
whatever the input's size. The place of a piece inside its bucket is counted in two steps, inside
slices of the hash order and over the slices' counts, so no task sees a whole bucket.

Defined cases
    An empty, blank or null text is one piece without tokens that takes the length 1.
    Rows alike in id and text are packed each. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import row_digest, text_of, unit
from wiretally.session import landed

WORD = r"[^\x20\x09-\x0D]+"
#: Pieces that one task numbers.
SLICE = 8192


def pieces(docs: DataFrame, max_len: int, texts: bool = False) -> DataFrame:
    """``doc_id, piece`` (from 0), ``n_tokens, length, u`` and, if asked for, the ``text`` of the piece."""
    many = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)).cast("int")
    if texts:
        words = F.regexp_extract_all(text_of(), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
        base = docs.select("doc_id", row_digest().alias("digest"), words.alias("words")).withColumn(
            "n", F.size("words"))
    else:
        base = docs.select("doc_id", row_digest().alias("digest"),
                           F.regexp_count(text_of(), F.lit(WORD)).alias("n"))
    cut = base.select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("piece"))
    n = F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).cast("int")
    out = ["doc_id", "piece", n.alias("n_tokens"), F.greatest(n, F.lit(1)).alias("length"),
           unit(F.col("digest"), "pack", F.col("piece").cast("string")).alias("u")]
    if texts:
        out.append(F.array_join(F.slice("words", F.col("piece") * max_len + 1, F.lit(max_len)), "").alias("text"))
    return cut.select(*out)


def boundaries(histogram: list[tuple[int, int]], n_buckets: int) -> list[int]:
    """The ``n_buckets`` upper lengths (fewer, if there are fewer lengths) that minimise padding.
    Of equal ways the one with the smaller previous boundary is taken, from the last bucket down."""
    if not histogram:
        return []
    lengths, counts = (np.array(x, dtype=np.int64) for x in zip(*sorted(histogram), strict=True))
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    n, k = len(lengths), min(n_buckets, len(lengths))
    best = lengths * rows[1:] - tokens[1:]
    came: list[np.ndarray] = []
    for _ in range(k - 1):
        now, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
        now[0], back[0] = np.iinfo(np.int64).max // 4, -1
        for i in range(1, n):
            padded = lengths[i] * (rows[i + 1] - rows[1:i + 1]) - (tokens[i + 1] - tokens[1:i + 1])
            cost = best[:i] + padded
            back[i] = int(np.argmin(cost))
            now[i] = cost[back[i]]
        best = now
        came.append(back)
    at, chosen = n - 1, [int(lengths[n - 1])]
    for back in reversed(came):
        at = int(back[at])
        chosen.append(int(lengths[at]))
    return chosen[::-1]


def pack(docs: DataFrame, *, max_len: int = 2048, budget: int = 16384, n_buckets: int = 8,
         texts: bool = False) -> DataFrame:
    """``doc_id, piece, n_tokens, bucket`` (from 1), ``boundary, batch`` and ``slot`` (from 0, inside the
    bucket and the batch) of every piece; with ``texts`` also its ``text``."""
    if not 1 <= max_len <= budget:
        raise ValueError("max_len must be at least 1 and at most the token budget of a batch")
    cut = landed(pieces(docs, max_len, texts), "pieces")
    histogram = [(r["length"], r["n"]) for r in
                 cut.groupBy("length").agg(F.count("*").alias("n")).collect()]
    edges = boundaries(histogram, n_buckets)
    sizes = [sum(n for length, n in histogram if low < length <= high)
             for low, high in zip([0, *edges], edges, strict=False)]
    slices = [max(1, -(-size // SLICE)) for size in sizes]

    def by_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket"))

    if not edges:
        edges, slices = [1], [1]
    bucket = F.lit(1)
    for edge in edges[:-1]:
        bucket = bucket + (F.col("length") > edge).cast("int")
    placed = cut.withColumn("bucket", bucket).withColumn(
        "slice", F.floor(F.col("u") * by_bucket(slices)).cast("int")).withColumn("boundary", by_bucket(edges))

    in_bucket = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("bucket", "slice").agg(F.count("*").alias("n")).select(
        "bucket", "slice", F.coalesce(F.sum("n").over(in_bucket), F.lit(0)).alias("before"))
    in_slice = Window.partitionBy("bucket", "slice").orderBy("u", "doc_id", "piece")
    place = F.col("before") + F.row_number().over(in_slice) - 1
    per_batch = F.floor(F.lit(budget) / F.col("boundary"))
    return placed.join(before, ["bucket", "slice"]).withColumn("place", place).select(
        "doc_id", "piece", "n_tokens", "bucket", "boundary",
        F.floor(F.col("place") / per_batch).cast("bigint").alias("batch"),
        (F.col("place") % per_batch).cast("int").alias("slot"),
        *(["text"] if texts else []),
    )
