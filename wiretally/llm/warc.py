"""WARC archives compressed record by record with Zstandard and a dictionary of their own.

An archive begins with a skippable frame that holds the dictionary; then one frame follows per record. Of
pages with equal payloads of at least ``least`` bytes the one with the largest id is written as a response, the
others as revisits that name it. The reader takes the dictionary from the skippable frame, decodes frame by
frame and validates what it reads: the frame's magic number, the record's version and headers, its lengths
and the payload's digest.

Tasks write their archives under names that depend on the partition alone, first hidden and then renamed, so a
repeated task replaces its own files and readers see whole archives only. Files hold about ``roll`` bytes.

Defined cases
    A null html is an empty payload. A null url is written as ``about:blank``.
    Rows of equal payload and equal, largest id are responses each. A page without an id is a revisit of
    one that has an id; if none has, all are responses. An empty table writes nothing and reads as an empty table.
    Damaged archives raise ``ValueError`` with the place in the file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.session import landed, state_folder

#: Fixed values of the formats: magic numbers of a dictionary's skippable frame and of a frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
#: Bytes of a frame that the reader takes first; twice as many each time that is not enough.
FIRST_SLICE = 4096
#: Names of one kind of file system here and in the tasks' library.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

READ_SCHEMA = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
               "refers_to bigint, payload binary")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    if not (record_id.startswith("<urn:page:") and record_id.endswith(">")):
        raise ValueError(f"record id {record_id[:80]!r}")
    number = record_id[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit's block has the HTTP headers only, whose Content-Length tells the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in url or "about:blank" if c not in "\r\n")
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes, first: str) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"begins with {lines[0][:40]!r}, not {first}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


@dataclass
class Page:
    page_id: int | None
    url: str
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    payload: bytes | None


def parse(raw: bytes) -> Page:
    """One decoded record, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("record without an end of its headers")
    h = _headers(head, VERSION)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-target-uri", "warc-payload-digest"):
        if name not in h:
            raise ValueError(f"record without {name}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size}, but {len(rest) - 4} bytes of block")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("HTTP headers without an end")
    full = int(_headers(http, "HTTP/1.")["content-length"])
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != full:
            raise ValueError(f"HTTP Content-Length {full}, but {len(payload)} bytes of payload")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("the payload does not have its digest")
        refers = None
    elif kind == "revisit":
        if payload or "warc-refers-to" not in h:
            raise ValueError("revisit with a payload or without what it refers to")
        refers = _page_of(h["warc-refers-to"])
    else:
        raise ValueError(f"record type {kind!r}")
    return Page(_page_of(h["warc-record-id"]), h["warc-target-uri"], full, digest, kind, refers,
                payload if kind == "response" else None)


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[Page]:
    """Records of an archive; ``ValueError`` where it is damaged."""
    import zstandard

    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ValueError("byte 0: no dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("byte 0: the dictionary frame is cut off")
    body = data[8:8 + size]
    if body[:4] == FRAME_MAGIC:  # the format lets the dictionary itself be compressed
        body = zstandard.ZstdDecompressor().decompress(body)
    known = zstandard.ZstdCompressionDict(body) if body else None
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        if data[at:at + 4] != FRAME_MAGIC:
            raise ValueError(f"byte {at}: no frame begins here")
        try:
            one, pieces, end, step = reader.decompressobj(), [], at, FIRST_SLICE
            while not one.eof and end < len(data):  # slices, so that a frame costs its own size and not the archive's
                pieces.append(one.decompress(view[end:end + step]))
                end, step = min(end + step, len(data)), 2 * step
            if not one.eof:
                raise ValueError("the frame is cut off")
            raw = b"".join(pieces)
            end -= len(one.unused_data)
            promised = zstandard.frame_content_size(data[at:at + 18])
            if promised >= 0 and promised != len(raw):
                raise ValueError(f"the frame promises {promised} bytes and has {len(raw)}")
            page = parse(raw)
        except (ValueError, UnicodeDecodeError, zstandard.ZstdError, KeyError) as e:
            raise ValueError(f"byte {at}: {e}") from e
        yield page
        at = end


def planned(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to`` of every page."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("payload_digest"),
                        F.length(body).alias("n"))
    last = landed(base.filter(F.col("n") >= least).groupBy("payload_digest", "n").agg(
        F.max("page_id").alias("last"), F.count("*").alias("times")).filter("times > 1").select(
        F.col("payload_digest").alias("twice"), F.col("n").alias("twice_n"), "last"), "equal-payloads")
    joined = base.join(last, (F.col("payload_digest") == F.col("twice")) & (F.col("n") == F.col("twice_n")), "left")
    return joined.select("page_id", "url", "payload", "payload_digest",
                         F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def dictionary(pages: DataFrame, *, sample: int = 256, cut: int = 16384, size: int = 16384) -> bytes:
    """A dictionary trained on at most ``sample`` pages (those of the least hash), each cut at ``cut``
    bytes; empty where there is too little to train on. It changes sizes only, never what is read back."""
    import zstandard

    text = F.substring(F.coalesce(F.col("html"), F.lit("")), 1, cut)
    hashed = F.xxhash64("page_id", "url")
    keys = landed(pages.select(hashed.alias("h")).distinct().orderBy("h").limit(sample), "dictionary-sample")
    rows = pages.select(hashed.alias("k"), text.alias("t")).join(F.broadcast(keys), F.col("k") == F.col("h"))
    texts = [r["t"].encode()[:cut] for r in rows.orderBy("k", "t").limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, [t for t in texts if t]).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme and host of its file system, as the tasks' library spells them."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = jvm.Path(folder)
    if path.toUri().getScheme() is None:
        path = path.makeQualified(jvm.FileSystem.getDefaultUri(conf), jvm.Path("/"))
    scheme, _, rest = path.toString().partition(":")
    rest = rest if rest.startswith("//") else f"//{rest}"
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def write_archives(pages: DataFrame, folder: str, *, least: int = 1000, roll: int = 32 << 20) -> DataFrame:
    """Writes every page as a record below ``folder`` (any file system that pyarrow opens) and returns the
    archives written: ``path, records, bytes``. The work is done when this returns. A folder without a scheme is in the
    cluster's default file system, where Spark's readers look for it too."""
    trained = dictionary(pages)
    target = qualified(pages.sparkSession, folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(target)
        context = TaskContext.get()
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        number, held, size, count = 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{number:04d}.warc.zst"
            hidden = f"{base}/.{name}-{context.taskAttemptId()}"
            with system.open_output_stream(hidden, compression=None) as out:
                out.write(dictionary_frame(trained))
                for frame in held:
                    out.write(frame)
            system.move(hidden, f"{base}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())],
                names=["path", "records", "bytes"])

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                frame = writer.compress(record(*row))
                held.append(frame)
                size += len(frame)
                count += 1
                if size >= roll:
                    yield flush()
                    number, held, size, count = number + 1, [], 0, 0
        if held:
            yield flush()

    rows = planned(pages, least).select("page_id", "url", "payload", "payload_digest", "refers_to")
    return landed(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def read_archives(source: DataFrame) -> DataFrame:
    """Records of archives given as ``path`` and ``content`` (Spark's ``binaryFile``)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def batch(rows: list[Page]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([getattr(r, n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                rows: list[Page] = []
                held = 0
                try:
                    for page in read_archive(content.as_py()):
                        rows.append(page)
                        held += len(page.payload or b"")
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield batch(rows)

    return source.select("path", "content").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, *, least: int = 1000) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = state_folder(spark, "warc")
    _make(spark, folder)
    write_archives(pages, folder, least=least)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return read_archives(files)


def _make(spark: SparkSession, folder: str) -> None:
    """Creates the folder in the file system it is in, so that an empty table reads as empty too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


