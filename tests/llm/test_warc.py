"""Archives: round trips, and a reader that tells what is wrong with an archive."""

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from causeway.llm import warc
from causeway.llm.common import table

SF = "/root/testdata/sf0.001"
BIG = "<p>" + "long page " * 200_000
PAGES = [(5, "http://a/x y?q=é", "<html>" + "same " * 40), (3, "http://b", "<html>" + "same " * 40), (9, None, "<html>" + "same " * 40),
         (1, "http://c", None), (2, "http://d", ""), (4, "http://e", "short"), (6, "http://f", "short"), (7, "http://g\r\nWARC-Type: x", BIG),
         (None, "http://h", "<html>" + "same " * 40), (8, "http://i", "é\r\n\r\n日本" * 30), (3, "http://b", "<html>" + "same " * 40),
         (9, None, "<html>" + "same " * 40), (10, "", "WARC/1.1\r\n\r\n" * 20)]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    for name in ("digest", "first", "payload", "copies", "archive", "error"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def wanted():
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = i is not None and h in first and first[h] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 1])
def test_round_trip(pages, size):
    assert sorted(map(tuple, warc.round_trip(pages, size).collect()), key=str) == wanted()
    assert warc.round_trip(pages.where("false"), size).collect() == []


def test_payloads_and_files(spark, pages, tmp_path):
    """What is read back is what was written, and the files are plain Zstandard with a leading dictionary."""
    source = table(spark, SF, "pages").select("page_id", "url", "html")
    warc.write_archives(source, str(tmp_path / "a"), archive_bytes=20_000)
    records = warc.read_archives(spark, str(tmp_path / "a"))
    assert records.where("error is not null").count() == 0 and warc.dangling(records).count() == 0
    got = {r.record_id: r.payload.decode() for r in records.where("record_type = 'response'").collect()}
    assert got == {warc.uri(r.page_id): r.html or "" for r in source.collect() if warc.uri(r.page_id) in got}
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-")]
    assert len(files) > 3
    for f in files:
        data = f.read_bytes()
        magic, length = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        words = zstandard.ZstdCompressionDict(data[8 : 8 + length])
        with zstandard.ZstdDecompressor(dict_data=words).stream_reader(data, read_across_frames=True) as reader:
            assert reader.read().count(b"WARC/1.1\r\n") >= 1


def archive(*records, words=b"", lead=True, compressed=False):
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    inside = zstandard.ZstdCompressor().compress(words) if compressed else words
    head = struct.pack("<II", 0x184D2A5D, len(inside)) + inside if lead else b""
    return head + b"".join(coder.compress(r) for r in records)


def good(payload=b"hello", **changes):
    data = warc.record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z")
    for old, new in changes.get("replace", {}).items():
        assert old in data
        data = data.replace(old, new)
    return data


def errors(data):
    return [r["error"] for r in warc.records_of(memoryview(data))]


@pytest.mark.parametrize("change, error", [
    ({b"WARC/1.1": b"WARC/9"}, "no WARC header"), ({b"WARC-Type": b"X-Type"}, "warc-type is missing"),
    ({b"WARC-Date: 2024": b"WARC-Type: response\r\nWARC-Date: 2024"}, "warc-type is repeated"),
    ({b"sha256:": b"sha256:00"}, "payload digest"), ({b"hello": b"hellO"}, "payload digest"), ({b"hello": b"hello!"}, "content-length does not fit"),
    ({b"HTTP/1.1": b"HTTPX1.1"}, "no HTTP head"), ({b"WARC-Date:": b"WARC Date:"}, "no header field"),
    ({b"Content-Length: 5\r\n": b"Content-Length: 6\r\n"}, "HTTP content-length"), ({b"html; charset=utf-8\r\nContent-Length: 5": b"html; charset=utf-8\r\nContent-Length: x"}, "no content-length"),
    ({b"hello\r\n\r\n": b"hello\r\n.."}, "content-length does not fit"), ({b"WARC-Type: response": b"WARC-Type: revisit"}, "revisit without")])
def test_faults_are_told_and_passed_over(change, error):
    found = errors(archive(good(), good(replace=change), good()))
    assert found[0] is None and found[2] is None and found[1].startswith(error)


def test_broken_frames():
    whole = archive(good(), good())
    assert errors(whole) == [None, None]
    assert errors(whole[:-3]) == [None, "frame is cut off"]
    assert errors(whole + b"junk of no frame") == [None, None, "bytes that are no frame"]
    assert errors(struct.pack("<II", 0x184D2A5D, 99) + b"x") == ["frame is cut off"]
    frame = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(good()))
    frame[-1] ^= 1
    assert len(errors(bytes(frame) + archive(good(), lead=False))) == 2 and errors(bytes(frame))[0]
    assert errors(b"") == []


def test_dictionaries():
    samples = [good(f"page {i} of many".encode() * 9) for i in range(400)]
    words = zstandard.train_dictionary(4096, samples).as_bytes()
    for given in (words, b"raw content that is no trained dictionary " * 9):
        for compressed in (False, True):
            assert errors(archive(*samples[:3], words=given, compressed=compressed)) == [None] * 3
    assert errors(archive(samples[0], words=words, lead=False))[0]  # its dictionary is missing
    skip = struct.pack("<II", 0x184D2A53, 4) + b"1234"
    assert errors(archive(good(), lead=False) + skip + archive(good(), lead=False)) == [None, None]


def test_other_records_and_digests():
    data = (b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: d\r\nNote: folded\r\n over lines\r\n"
            b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()) + b"\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    (row,) = warc.records_of(memoryview(archive(data)))
    assert (row["error"], row["record_type"], row["payload"], row["payload_bytes"]) == (None, "metadata", b"hello", 5)
    assert errors(archive(data.replace(b"hello", b"jello")))[0].startswith("payload digest")


def test_a_revisit_needs_its_response(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "b"))
    records = warc.read_archives(spark, str(tmp_path / "b"), payloads=False)
    assert warc.dangling(records).count() == 0
    lost = warc.dangling(records.where("record_id != '<urn:page:3>'")).collect()
    assert [(r.refers_to, r.revisits) for r in lost] == [("<urn:page:3>", 3)]
