"""HTTP archives of any size: byte ranges of the entries array, read by many tasks per file.

An archive is one JSON document, so where an entry begins depends on everything before it. A first job passes over each
file once in blocks, follows strings and brackets with whole-array arithmetic, and notes where ranges of about
``split_bytes`` begin and how many entries lie before each. A second job reads the ranges and cuts them into
entries; what is inside an entry is parsed by Spark's own JSON reader. A task holds one range, never a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.session import landed

BLOCK = 1 << 20
SPLIT = 16 << 20
#: Bytes before a bracket in which its key is looked for.
TAIL = 256
#: Entries of a file are numbered below this, so that file and position make one number.
POSITIONS = 32

_QUOTE, _SLASH = ord('"'), ord("\\")
_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))
#: Depth inside ``{"log": {"entries": [``.
INSIDE = 3


@dataclass
class Scanner:
    """Brackets outside strings of a byte stream that comes in blocks, and the depth after each."""

    depth: int = 0
    in_string: bool = False
    slashes: int = 0

    def feed(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of brackets in the block, and the depth after them."""
        places = np.arange(len(block))
        slash = block == _SLASH
        quotes = np.flatnonzero(block == _QUOTE)
        if slash.any() or self.slashes:
            other = np.maximum.accumulate(np.where(slash, -1, places))  # the last place that is no backslash
            before = np.where(quotes > 0, other[np.maximum(quotes - 1, 0)], -1)
            run = quotes - 1 - before + np.where(before < 0, self.slashes, 0)
            quotes = quotes[run % 2 == 0]
            last = int(other[-1])
            self.slashes = len(block) - 1 - last + (self.slashes if last < 0 else 0)
        opening, closing = np.isin(block, _OPEN), np.isin(block, _CLOSE)
        found = np.flatnonzero(opening | closing)
        outside = (np.searchsorted(quotes, found) + self.in_string) % 2 == 0
        found = found[outside]
        depths = self.depth + np.cumsum(np.where(opening[found], 1, -1))
        self.in_string = bool((len(quotes) + self.in_string) % 2)
        if len(depths):
            self.depth = int(depths[-1])
        return found, depths


@dataclass
class Planner:
    """Ranges ``start, end, first``: begin of an entry, end after the last one, position of the first entry."""

    split_bytes: int
    scanner: Scanner = field(default_factory=Scanner)
    at: int = 0
    tail: bytes = b""
    inside: bool = False
    entries: int = 0
    starts: list[tuple[int, int]] = field(default_factory=list)
    ranges: list[tuple[int, int, int]] = field(default_factory=list)

    def feed(self, data: bytes) -> None:
        block = np.frombuffer(data, np.uint8)
        found, depths = self.scanner.feed(block)
        chars = block[found]
        # the few brackets that open or close an array of the log, and those that open its objects
        for i in np.flatnonzero((depths == INSIDE) & (chars == ord("["))
                                | (depths == INSIDE - 1) & (chars == ord("]"))
                                | (depths == INSIDE + 1) & (chars == ord("{"))).tolist():
            place, char = int(found[i]), int(chars[i])
            if char == ord("["):
                before = (self.tail + data[:place])[-TAIL:].rstrip()
                self.inside = before.endswith(b":") and before[:-1].rstrip().endswith(b'"entries"')
            elif char == ord("]"):
                if self.inside:
                    self._close(self.at + place)
                self.inside = False
            elif self.inside:
                if not self.starts or self.at + place - self.starts[-1][0] >= self.split_bytes:
                    self.starts.append((self.at + place, self.entries))
                self.entries += 1
        self.tail = (self.tail + data)[-TAIL:]
        self.at += len(data)

    def _close(self, end: int) -> None:
        if not self.starts:
            return
        ends = [s for s, _ in self.starts[1:]] + [end]
        self.ranges += [(s, e, n) for (s, n), e in zip(self.starts, ends, strict=True)]
        self.starts = []

    def done(self) -> list[tuple[int, int, int]]:
        """All ranges; entries of a document that is cut off end with the file."""
        self._close(self.at)
        return self.ranges


def entries_of(data: bytes) -> list[bytes]:
    """The objects of a range of the entries array."""
    block = np.frombuffer(data, np.uint8)
    found, depths = Scanner(INSIDE).feed(block)
    chars = block[found]
    starts = found[(depths == INSIDE + 1) & (chars == ord("{"))].tolist()
    ends = found[(depths == INSIDE) & (chars == ord("}"))].tolist()
    return [data[a:b + 1] for a, b in zip(starts, ends, strict=False)]


def _open(uri: str):
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, path = fs.FileSystem.from_uri(f"{scheme}:{rest if rest.startswith('//') else '//' + rest}")
    return system.open_input_file(path)


def ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """``file, uri, start, end, first`` of all archives at a path; files are numbered in the order of their names."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length").filter("length > 0")
    # as many rows as files, which the planner lists on the driver in any case
    names = sorted(r["path"] for r in listed.select("path").collect())
    if not names:
        return spark.createDataFrame([], "file bigint, uri string, start bigint, end bigint, first bigint")
    files = spark.createDataFrame(list(enumerate(names)), "file bigint, uri string").repartitionByRange(
        min(len(names), 10_000), "file")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, uri in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                planner = Planner(split_bytes)
                with _open(uri) as stream:
                    while data := stream.read(BLOCK):
                        planner.feed(data)
                got = planner.done()
                columns = list(zip(*got, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(got), pa.int64()), pa.array([uri] * len(got), pa.string()),
                     *(pa.array(c, pa.int64()) for c in columns)], names=["file", "uri", "start", "end", "first"])

    return landed(files.mapInArrow(run, "file bigint, uri string, start bigint, end bigint, first bigint"), "archive-ranges")


def raw_entries(spark: SparkSession, path: str, split_bytes: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """``file, pos, raw``: every entry of every archive as JSON text. ``tasks``: as many as ``SPLIT`` goes into their bytes by
    default, and no fewer than there are cores or, if these are fewer, ranges; a task reads its ranges one by one."""
    planned = ranges(spark, path, split_bytes)
    if not tasks:
        n, size = planned.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
        tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, size // SPLIT)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                with _open(r["uri"]) as stream:
                    stream.seek(r["start"])
                    raw = entries_of(stream.read(r["end"] - r["start"]))
                for at in range(0, len(raw), 1000):
                    some = raw[at:at + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["file"]] * len(some), pa.int64()),
                         pa.array(range(r["first"] + at, r["first"] + at + len(some)), pa.int64()),
                         pa.array([x.decode(errors="replace") for x in some], pa.string())], names=["file", "pos", "raw"])

    return planned.repartition(tasks, "file", "start").mapInArrow(run, "file bigint, pos bigint, raw string")


_NAMED = "array<struct<name:string,value:string>>"
ENTRY = ("startedDateTime string,"
         f"request struct<url:string,method:string,headers:{_NAMED},postData:struct<text:string>>,"
         f"response struct<status:int,headers:{_NAMED},content:struct<mimeType:string,text:string>>")


def header_map(headers: Column) -> Column:
    """Header rows as a map with lower-case names; of repeated names the last one counts."""
    return F.aggregate(
        F.coalesce(headers, F.array().cast(_NAMED)),
        F.create_map().cast("map<string,string>"),
        lambda acc, h: F.map_concat(
            F.map_filter(acc, lambda k, _v: k != F.lower(h["name"])),
            F.create_map(F.lower(h["name"]), h["value"]),
        ),
    )


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """HTTP archive files (one JSON document each) as exchanges. Each file is a session, numbered in the order of the files'
    names; ``seq`` is that number and the entry's position, so it is unique and follows the files."""
    e = raw_entries(spark, path, split_bytes).select("file", "pos", F.from_json("raw", ENTRY).alias("e"))
    ts = F.to_timestamp("e.startedDateTime")
    return e.select(
        (F.shiftleft("file", POSITIONS) + F.col("pos")).alias("seq"),
        # UTC whatever the session's time zone is
        (F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
         + F.make_dt_interval(secs=F.unix_micros(ts) / 1_000_000)).alias("ts"),
        F.unix_micros(ts).alias("ts_us"),
        F.col("file").alias("session"),
        F.col("pos").alias("request_id"),
        F.col("e.request.url").alias("url"),
        F.col("e.request.method").alias("method"),
        header_map(F.col("e.request.headers")).alias("request_headers"),
        F.col("e.request.postData.text").alias("request_body"),
        F.col("e.response.status").alias("status"),
        F.coalesce(F.col("e.response.content.mimeType"), F.lit("")).alias("content_type"),
        header_map(F.col("e.response.headers")).alias("response_headers"),
        F.col("e.response.content.text").alias("response_body"),
        F.col("e.response.content.text").isNull().alias("body_missing"),
    )


def write_archives(exchanges: DataFrame, folder: str) -> None:
    """Exchanges as HTTP archives, one file per partition, through Spark's text writer."""
    def named(headers: str) -> Column:
        return F.transform(F.map_entries(headers), lambda h: F.struct(h["key"].alias("name"), h["value"].alias("value")))

    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startedDateTime"),
        F.struct("url", "method", named("request_headers").alias("headers"),
                 F.when(F.col("request_body").isNotNull(), F.struct(F.col("request_body").alias("text"))).alias("postData"),
                 ).alias("request"),
        F.struct("status", named("response_headers").alias("headers"),
                 F.struct(F.col("content_type").alias("mimeType"),
                          F.when(~F.col("body_missing"), F.col("response_body")).alias("text")).alias("content"),
                 ).alias("response"))

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

        yield out(['{"log": {"version": "1.2", "pages": [], "entries": ['])
        comma = ""
        for part in parts:
            raw = part.column(0).to_pylist()
            if raw:
                yield out([comma + raw[0], *("," + r for r in raw[1:])])
                comma = ","
        yield out(["]}}"])

    exchanges.select(F.to_json(entry).alias("entry")).mapInArrow(lines, "value string").write.text(folder)
