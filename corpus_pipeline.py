"""The training-data pipeline: documents in, packed pieces out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame on what its predecessor kept; all but the last
return the columns of documents. ``run`` writes every stage as Parquet in the shared folder and reads it again; what a
stage landed for itself is removed then.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import mixing, nearcopies, packing, quality, secrets
from wiretally.llm.common import table
from wiretally.session import landed_alone

#: What stands in a text for a secret that was found in it.
MASK = "[SECRET]"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3, by the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out())
    model = quality.train(docs, labels)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    scored = quality.score(packed, model, ["doc"]).filter("score >= 0.3")
    return scored.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles with a similarity of at least 0.8, or
    fingerprints of three-word shingles with up to 3 differing bits."""
    return nearcopies.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret that is found replaced by a mark."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = secrets.scan(packed, secrets.train(docs), ["doc"], mark=MASK)
    changed = F.size("spans") > 0

    def column(name: str) -> Column:
        old = F.col("doc")[name]
        if name == "text":
            return F.when(changed, F.col("masked")).otherwise(old)
        if name == "n_chars":
            return F.when(changed, F.length("masked").cast("bigint")).otherwise(old)
        return old

    return found.select(*[column(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh their size to the power 0.7, in random order."""
    return mixing.mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens in batches of 16,384, with their texts."""
    return packing.pack(docs, texts=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Trained models decide in two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed_alone(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return docs
