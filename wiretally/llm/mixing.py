"""Mixing sources to target weights by Poisson replication.

A document's number of copies is a Poisson number whose mean is the repetition rate its source needs
to reach its share of the mixture. The number is the inverse of the Poisson distribution at a uniform
number hashed from the seed, the id and the text, so a run can be repeated and rows need no exchange
to agree on it. Every document is exploded by its count and dealt to a random place of a random partition.

Defined cases
    The size of a document is its code points plus one end mark, so empty and null texts count one.
    A null source is a source of its own. A source without a weight, or of weight zero, gets rate 0.
    Rows alike in id and text draw the same count. An empty table gives an empty table.
    Other columns are passed through; the added ones come in a struct of their own when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import row_digest, text_of, unit
from wiretally.session import landed

#: Means above this are drawn as a sum of several smaller Poisson numbers.
STEP = 16.0
#: Terms of the distribution; at a mean of STEP the rest is below 2**-53.
TERMS = 64


def rates(docs: DataFrame, weights: DataFrame | None = None, *, temperature: float = 0.7,
          total: float | None = None) -> DataFrame:
    """One row per source: ``source, n_docs, size, weight, rate``.

    ``weights`` has ``source, weight``, one row per source; without it a source weighs its size to the power
    ``temperature``. ``total`` is the wanted size of the mixture, by default that of the input.
    """
    sizes = docs.select("source", (F.length(text_of()) + 1).cast("bigint").alias("size")).groupBy(
        "source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("double"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select(
            "source", "n_docs", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = landed(weighed, "mix-sizes")
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("size").alias("n")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    rate = F.col("weight") / F.lit(sums["w"] or 1.0) * F.lit(wanted) / F.col("size")
    return weighed.select("source", "n_docs", "size", "weight", rate.alias("rate"))


def distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... TERMS."""
    first = F.exp(-mean)
    start = F.struct(F.array(first).alias("all"), first.alias("p"), first.alias("s"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(F.concat(acc["all"], F.array(acc["s"] + p)).alias("all"), p.alias("p"),
                        (acc["s"] + p).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["all"])


def mix(docs: DataFrame, weights: DataFrame | None = None, *, temperature: float = 0.7,
        total: float | None = None, seed: int = 7, details: bool = False) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled. With ``details`` a struct ``mixed`` of
    ``replica`` (from 1), ``copies``, ``rate`` and ``place`` (the random sort key) is added."""
    parts = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    plan = landed(
        rates(docs, weights, temperature=temperature, total=total)
        .withColumn("parts", parts)
        .select(F.col("source").alias("plan_source"), "rate", "parts",
                distribution(F.col("rate") / F.col("parts")).alias("cdf")),
        "mix-plan",
    )
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("doc_source"),
                         row_digest().alias("digest"))

    # The planner knows the bytes of the landed plan: it broadcasts a small one and otherwise joins by
    # sorting, where adaptive execution splits the partition of a hot source.
    joined = packed.join(plan, F.col("doc_source").eqNullSafe(F.col("plan_source")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")),
                          lambda j: unit(F.col("digest"), seed, j.cast("string")))
    copies = F.aggregate("numbers", F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda p: p <= u)))
    counted = joined.withColumn("numbers", numbers).withColumn("copies", copies)
    rows = counted.filter("copies > 0").select(
        "doc", "rate", "copies", "digest",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("replica"))
    placed = rows.withColumn(
        "place", F.md5(F.concat_ws("|", F.lit(f"{seed}|place"), F.col("replica").cast("string"), "digest")))
    dealt = placed.repartition("place").sortWithinPartitions("place")
    out = [F.col("doc")[c].alias(c) for c in docs.columns]
    if details:
        out.append(F.struct("replica", "copies", "rate", "place").alias("mixed"))
    return dealt.select(*out)
