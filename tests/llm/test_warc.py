import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from wiretally.llm import warc

BIG = "<p>payload</p>" * 100
PAGES = [
    (1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (4, "http://c/", "short"), (5, "http://d/", "short"),
    (6, "http://e/", None), (7, "http://f/", ""), (None, "http://g/", BIG), (3, "http://h/", BIG),
    (None, "http://i/", "n" * 1000), (None, "http://j/", "n" * 1000), (8, "u\r\nX: y", "é" * 600), (9, "x", "é" * 600),
    (10, "http://l/", "long " * 100_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))


def test_round_trip(spark):
    rows = warc.round_trip(pages(spark)).collect()
    assert len(rows) == len(PAGES)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]))
                 for r in rows)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        last = max(same) if same and len(raw) >= 1000 and sum((h or "") == (html or "") for _, _, h in PAGES) > 1 else None
        revisit = last is not None and i != last
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                     str(last if revisit else None)))
    assert got == sorted(want)
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def archive(records, dictionary=b""):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    writer = zstandard.ZstdCompressor(dict_data=known, write_content_size=True)
    return warc.dictionary_frame(dictionary) + b"".join(writer.compress(r) for r in records)


def good(i=1, payload=b"hello"):
    return warc.record(i, "http://x/", payload, hashlib.sha1(payload).hexdigest(), None)


def test_reader_with_and_without_a_dictionary():
    records = [good(i, b"payload %d " % i * 50) for i in range(200)]
    trained = zstandard.train_dictionary(2048, records).as_bytes()
    packed = warc.dictionary_frame(zstandard.ZstdCompressor().compress(trained)) + archive(records, trained)[8 + len(trained):]
    for data in (archive(records), archive(records, trained), packed):
        assert [p.page_id for p in warc.read_archive(data)] == list(range(200))
    assert len(archive(records, trained)) < len(archive(records))
    assert list(warc.read_archive(archive([]))) == []


@pytest.mark.parametrize("damage", [
    lambda d: d[4:], lambda d: b"", lambda d: d[:-3], lambda d: d + b"junk", lambda d: d[:12] + b"\x00" + d[13:],
    lambda d: struct.pack("<II", warc.DICTIONARY_MAGIC, 10**6) + d[8:]])
def test_damaged_archives(damage):
    with pytest.raises(ValueError, match="byte"):
        list(warc.read_archive(damage(archive([good(), good(2)]))))


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"hello", b"jello"), lambda r: r.replace(b"WARC/1.1", b"WARD/1.1"),
    lambda r: r[:-4], lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: metadata"),
    lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 4"), lambda r: r.replace(b"WARC-Date", b"WARC-Dote"),
    lambda r: r.replace(b"urn:page", b"urn:page0"), lambda r: b"nothing"])
def test_bad_records(change):
    with pytest.raises(ValueError):
        list(warc.read_archive(archive([good(), change(good(2))])))


def test_archives_roll(spark):
    from wiretally.session import state_folder
    folder = state_folder(spark, "warc-test")
    warc._make(spark, folder)
    rows = [(i, "u", f"{i} " + "".join(chr(97 + (i * j) % 26) for j in range(3000))) for i in range(60)]
    made = warc.write_archives(pages(spark, rows).coalesce(1), folder, roll=4000)
    assert made.count() > 2 and made.agg(F.sum("records")).first()[0] == 60
    again = warc.read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder))
    assert sorted(r["page_id"] for r in again.collect()) == list(range(60))


def test_reading_grows_with_the_archive_only():
    """A frame is given to the decoder in slices: twice the archive takes about twice the time."""
    import os
    import time

    text = [os.urandom(900).hex().encode() for _ in range(400)]
    frames = [warc.record(i, "http://x/", text[i % 400], hashlib.sha1(text[i % 400]).hexdigest(), None) for i in range(400)]
    writer = zstandard.ZstdCompressor(write_content_size=True)
    one = [writer.compress(f) for f in frames]

    def seconds(times):
        data = warc.dictionary_frame(b"") + b"".join(one) * times
        start = time.process_time()
        assert sum(1 for _ in warc.read_archive(data)) == 400 * times
        return time.process_time() - start, len(data)

    (short, small), (long, large) = seconds(48), seconds(96)
    assert small > 16 << 20 and large > 32 << 20 and long < 3 * short


@pytest.mark.parametrize("step", [1, 7, 4096, 1 << 20])
def test_slices_of_any_size_read_the_same(monkeypatch, step):
    monkeypatch.setattr(warc, "FIRST_SLICE", step)
    records = [warc.record(i, "u", b"p" * (i * 997), hashlib.sha1(b"p" * (i * 997)).hexdigest(), None) for i in range(9)]
    data = warc.dictionary_frame(b"") + b"".join(zstandard.ZstdCompressor().compress(r) for r in records)
    assert [len(p.payload) for p in warc.read_archive(data)] == [i * 997 for i in range(9)]
    for cut in (len(data) - 1, len(data) - 9):
        with pytest.raises(ValueError):
            list(warc.read_archive(data[:cut]))


def test_folders_are_in_the_clusters_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://names:9000")
        assert warc.qualified(spark, "/data/warc") == "hdfs://names:9000/data/warc"
        assert warc.qualified(spark, "file:///data/warc") == "file:///data/warc"
        assert warc.qualified(spark, "s3a://bucket/warc") == "s3://bucket/warc"
    finally:
        conf.set("fs.defaultFS", before)
    assert warc.qualified(spark, "/data/warc") == "file:///data/warc"
