"""Order MinHash: document fingerprints that are sensitive to edit distance.

A text's k-mers are its ``WIDTH`` words in a row, each numbered by its occurrence so that repeats differ.
Numbered k-mers are hashed into ``BINS`` bins; in each bin the two of least hash are selected, put in the order
they have in the text, and hashed as a pair. Moving a passage therefore changes entries even where the set
of k-mers stays. The likeness of two fingerprints is the share of equal entries among the bins that either fills.

Everything is built-in functions on arrays of longs that pack a 35-bit hash with a 28-bit place: two sorts and
a few passes per text, linear but for the sorts, and no row leaves its task for it.

Defined cases
    A null text is empty and has an empty fingerprint; two empty fingerprints are alike (1.0), an empty and another are
    not (0.0). Texts of fewer than ``WIDTH`` words are one k-mer. A bin with one k-mer hashes that alone.
    The next document: ascending id, null ids first, rows of equal id by their text's hash; after the last the first.
    An empty table gives an empty table. Places count up to 2**28 words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import text_of

WIDTH = 3
#: A power of two; the bin is the top bits of the hash.
BINS = 32
PLACE = 28
HASH = 63 - PLACE
#: Rows of a bucket of neighbouring ids.
ROWS = 2000


def _pack(hashed: Column, place: Column) -> Column:
    """The top bits of a hash, then a place; never null."""
    return F.coalesce(F.shiftleft(F.shiftrightunsigned(hashed, 64 - HASH), PLACE).bitwiseOR(place), F.lit(0))


def _hash(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE) - 1))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 63 - (BINS.bit_length() - 1))


def with_entries(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the fingerprint's entries (bin, then 32 bits of hash) as sorted longs, from a text column."""
    kept = df.columns
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    step = df.withColumn("omh_words", words)

    n = F.size("omh_words")
    count = F.greatest(n - (WIDTH - 1), F.least(n, F.lit(1)))
    mers = F.transform(F.slice("omh_words", 1, count), lambda w, i: _pack(
        F.xxhash64(w, *[F.get("omh_words", i + j) for j in range(1, WIDTH)]), i.cast("bigint")))
    step = step.select(*kept, F.sort_array(mers).alias("omh_mers"))

    # Places of first occurrences as they are, of others as minus one minus the place.
    marked = F.transform("omh_mers", lambda x, i: F.when(
        (i == 0) | (_hash(x) != _hash(F.get("omh_mers", i - 1))), i).otherwise(-1 - i))
    step = step.select(*kept, "omh_mers", marked.alias("omh_marked"))
    step = step.select(*kept, "omh_mers", F.filter("omh_marked", lambda v: v >= 0).alias("omh_first"),
                       F.filter("omh_marked", lambda v: v < 0).alias("omh_more"))

    def numbered(at: Column, occurrence: Column) -> Column:
        x = F.get("omh_mers", at)
        return _pack(F.xxhash64(_hash(x), occurrence.cast("bigint")), _place(x))

    # Of the r-th later occurrence, at place i, i - r occurrences up to there are first ones.
    first = F.transform("omh_first", lambda i: numbered(i, F.lit(0)))
    more = F.transform("omh_more", lambda v, r: numbered(-1 - v, -1 - v - F.get("omh_first", -2 - v - r)))
    step = step.select(*kept, F.sort_array(F.concat(first, more)).alias("omh_all"))

    least = F.filter("omh_all", lambda x, i: (i < 2) | (_bin(x) != _bin(F.get("omh_all", i - 2))))
    step = step.select(*kept, least.alias("omh_least"))

    def entry(x: Column, i: Column) -> Column:
        other = F.get("omh_least", i + 1)
        pair = F.when(_place(x) < _place(other), F.xxhash64(_hash(x), _hash(other))).otherwise(
            F.xxhash64(_hash(other), _hash(x)))
        hashed = F.when(_bin(other) == _bin(x), pair).otherwise(F.xxhash64(_hash(x)))
        begins = (i == 0) | (_bin(x) != _bin(F.get("omh_least", i - 1)))
        return F.when(begins, F.shiftleft(_bin(x), 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF))))

    return step.select(*kept, F.array_compact(F.transform("omh_least", entry)).alias(out))


def fingerprint(entries: Column) -> Column:
    """Ten hex digits per entry: two of the bin, eight of the hash."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins that either side fills; 1.0 where none is filled."""
    def bins(x: Column) -> Column:
        return F.transform(x, lambda e: F.shiftright(e, 32))

    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def bounds(docs: DataFrame, rows: int) -> tuple[list, bool, int]:
    """Ids that begin buckets of about ``rows`` rows (the least id first), and whether there are null ids."""
    total = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.min("doc_id").alias("least")).first()
    found = []
    if total["known"]:
        many = max(1, min(20_000, math.ceil(total["known"] / rows)))
        shares = [i / many for i in range(many)]
        # Approximate percentiles are ids of the table, so every bucket begins with a row.
        picked = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * many)).alias("p")).first()["p"]
        found = sorted({total["least"], *picked})
    return found, total["n"] > total["known"], total["n"]


def bucket_of(value: Column, edges: list) -> Column:
    """How many of the sorted edges are at most the value, in two steps of about the root of their number."""
    if not edges:
        return F.lit(0)
    step = max(1, math.isqrt(len(edges)))
    coarse = F.size(F.filter(F.lit(edges[::step]), lambda e: e <= value))
    fine = F.size(F.filter(F.slice(F.lit(edges), (coarse - 1) * step + 1, F.lit(step)), lambda e: e <= value))
    return F.when(value.isNull() | (value < edges[0]), 0).otherwise((coarse - 1) * step + fine)


def with_next(df: DataFrame, columns: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` (``doc_id, text`` and others) with ``next_<column>`` of the next document for the named columns.

    Rows are dealt to buckets of neighbouring ids. The first row of a bucket also goes, as a guest, to the
    bucket before, and the first of all to the last, so one shuffle brings every row together with its next one.
    """
    edges, unknown, _ = bounds(df.select("doc_id"), rows)
    bucket = bucket_of(F.col("doc_id"), edges)

    def seat(at: Column, guest: int, wrapped: int) -> Column:
        return F.struct(at.cast("int").alias("bucket"), F.lit(guest).alias("guest"), F.lit(wrapped).alias("wrapped"))

    first = F.col("doc_id").isNull() if unknown else F.col("doc_id") == (edges[0] if edges else None)
    begins = F.coalesce(F.array_contains(F.lit(edges), F.col("doc_id")), F.lit(False)) if edges else F.lit(False)
    seats = F.concat(
        F.array(seat(bucket, 0, 0)),
        F.when(begins, F.array(seat(bucket - 1, 1, 0))).otherwise(F.array().cast("array<struct<bucket:int,guest:int,wrapped:int>>")),
        F.when(F.coalesce(first, F.lit(False)), F.array(seat(F.lit(len(edges)), 1, 1))).otherwise(
            F.array().cast("array<struct<bucket:int,guest:int,wrapped:int>>")))
    seated = df.withColumn("tie", F.xxhash64("text")).withColumn("seat", F.explode(seats))
    order = Window.partitionBy("seat.bucket").orderBy("seat.wrapped", F.col("doc_id").asc_nulls_first(), "tie")
    return seated.select(*df.columns, "seat.guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter(
        "guest = 0").drop("guest")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited, entries, edited_entries, next_entries``: each text's fingerprint, that of the text with
    its last quarter replaced by as much of the next document's begin, and the next document's."""
    base = with_entries(docs.select("doc_id", text_of().alias("text")), "text", "entries")
    paired = with_next(base, ["text", "entries"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    changed = paired.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "entries",
                            F.col("next_entries"))
    return with_entries(changed, "edited", "edited_entries")
