"""Exchange and request-event tables: schemas, batch and streaming reads, size caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally import constants as K
from wiretally.functions.common import c

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

EXCHANGE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("session", T.LongType()),
        T.StructField("request_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("request_headers", _TEXT_MAP),
        T.StructField("request_body", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("response_headers", _TEXT_MAP),
        T.StructField("response_body", T.StringType()),
        T.StructField("body_missing", T.BooleanType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("request_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
    ]
)


def read_exchanges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed exchanges with a fixed schema; nothing is inferred."""
    return spark.read.schema(EXCHANGE_SCHEMA).format(fmt).load(path)


def stream_exchanges(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Landed exchanges as a stream of files; ``glob`` restricts their names."""
    reader = spark.readStream.schema(EXCHANGE_SCHEMA).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def request_events(exchanges: DataFrame) -> DataFrame:
    """Split exchanges into the three events of a request: sent, received 50 ms later, finished
    120 ms later. Used to replay landed exchanges through the pairing jobs."""
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(ms * 1000).alias("offset"))
            for k, ms in (("sent", 0), ("received", 50), ("finished", 120))
        ]
    )
    e = exchanges.withColumn("k", F.explode(kinds))
    shift = F.make_dt_interval(secs=F.col("k.offset") / 1_000_000)
    return e.select(
        "session",
        "request_id",
        F.col("k.kind").alias("kind"),
        (F.col("ts") + shift).alias("ts"),
        (F.col("ts_us") + F.col("k.offset")).alias("ts_us"),
        F.when(F.col("k.kind") == "sent", F.col("url")).alias("url"),
        F.when(F.col("k.kind") == "sent", F.col("method")).alias("method"),
        F.when(F.col("k.kind") == "received", F.col("status")).alias("status"),
        F.when(F.col("k.kind") == "received", F.col("content_type")).alias("content_type"),
    )


def cut_bytes(text: Column | str, limit: int = K.BODY_CUT_BYTES) -> Column:
    """The longest begin of a text that has at most ``limit`` bytes; a character is never cut in two."""
    raw = F.substring(c(text).cast("binary"), 1, limit)
    # the begin ends inside a character where bytes like 10xxxxxx follow a head that promises more of them
    hexed = F.hex(F.substring(raw, -4, 4))
    torn = F.regexp_extract(hexed, "(?:[CDEF][0-9A-F](?:[89AB][0-9A-F])*)$", 0)
    have = F.length(torn) / 2
    promised = F.when(torn >= "F0", 4).when(torn >= "E0", 3).otherwise(2)
    extra = F.when((torn != "") & (have < promised), have).otherwise(0).cast("int")
    cut = F.substring(raw, F.lit(1), F.lit(limit) - extra).cast("string")
    return F.when(F.octet_length(c(text)) > limit, cut).otherwise(c(text))


def split_by_size(df: DataFrame, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the size of a body; the side table keeps the size."""
    sized = df.withColumn("bytes", F.octet_length(text))
    small = F.coalesce(F.col("bytes") <= limit, F.lit(True))
    return sized.filter(small), sized.filter(~small)
