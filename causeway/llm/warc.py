"""Web archives in Zstandard frames: one WARC record per frame, the dictionary in a leading skippable frame.

**Writing.** Pages with equal payloads of at least `LEAST_REVISIT` bytes share one `response`, that of the
smallest page_id; the others become `revisit` records that refer to it and carry the HTTP head alone, whose
Content-Length is that of the full payload. Digests of payloads are grouped, not payloads: a group costs one
row, and the groups meet the pages through `attach`, which serves the heaviest digests apart. Each task builds
archives of about `ARCHIVE_BYTES` (one record may be larger) and hands each on as one value; Spark's text
writer puts every value into a file of its own, bytes as they are, so archives are committed like any Spark
output, also where a task is repeated, on any file system that Spark reaches. The writer ends a file with its
line separator, which here is an empty skippable frame. Files bear the names Spark gives them.

**Reading.** Files are read whole (an archive is one row of at most 2 GB, the bound of Spark's binary files) and
walked frame by frame: block headers tell where a frame ends, so a frame is decoded alone and no more than one
record is held besides the file. A record is checked: version line, header syntax, fields that must be there
once, Content-Length against the bytes that follow, the two line ends behind the block, the HTTP head,
payload length and digest. A fault is text in `error`; other records of the archive are read on, unless the
frame structure itself is broken, which ends that archive with one fault.

Null html is an empty payload. Payloads shorter than `LEAST_REVISIT` are all responses, as are pages without
an id, which others cannot refer to either; rows that repeat the smallest id with the same payload are all
responses. Repeated rows give a record each. Null urls become `urn:page:unknown`; white space, control and
non-ASCII characters of urls are percent-encoded. Very long payloads are archived whole. An empty table gives
an empty folder of archives and no records; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import keep
from causeway.plans.scaling import attach, shared_dir

LEAST_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 1 << 16
SAMPLE_PAGES, SAMPLE_BYTES = 1000, 8192  # what the dictionary learns from: compression alone depends on it
OUT_BYTES = 4 << 20

# Fixed values of the formats.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable, of length 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ONCE = ("warc-type", "warc-record-id", "warc-date", "content-length")
END = b"\r\n\r\n"

RECORDS = ("archive string, offset long, record_type string, record_id string, target_uri string, date string, "
           "payload_digest string, payload_bytes long, refers_to string, payload binary, error string")


def with_first(pages: DataFrame) -> DataFrame:
    """`page_id, url, payload, digest, first`: the page of smallest id with the same payload, where others have it too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = (rows.where((F.octet_length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
              .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    found = attach(rows, keep(groups, "payloads"), ["digest"], "_group", spread=F.struct("page_id", "url"), weight="copies", how="left")
    return found.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNotNull(), F.col("_group.first")).alias("first"))


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the beginnings of a bounded number of pages; empty, if there is nothing to learn from."""
    sample = [bytes(r[0]) for r in pages.where("html != ''").select(F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too little text: its own bytes serve as such
        return b"".join(sample)[-DICTIONARY_BYTES:]


def uri(page_id: int | None) -> str:
    return f"<urn:page:{'unknown' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: memoryview | bytes, digest: str, first: int | None, date: str) -> bytes:
    revisit = first is not None and page_id != first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = len(http) + (0 if revisit else len(payload))
    target = urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))) if url else "urn:page:unknown"
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": uri(page_id), "WARC-Date": date,
              "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}"}
    if revisit:
        fields |= {"WARC-Refers-To": uri(first), "WARC-Profile": PROFILE}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return b"".join([head.encode(), http, b"" if revisit else payload, END])


def _archives(words: bytes, size: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = struct.pack("<II", DICTIONARY_FRAME, len(words)) + words if words else b""
        coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True)
        parts, held = [lead], 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

        for batch in batches:
            ids, urls, digests, firsts = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first"))
            for i, payload in enumerate(batch.column("payload")):
                parts.append(coder.compress(record(ids[i], urls[i], memoryview(payload.as_buffer()), digests[i], firsts[i], date)))
                held += len(parts[-1])
                if held >= size:
                    yield whole()
                    parts, held = [lead], 0
        if held:
            yield whole()

    return run


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per page below `path`. `date` is that of all records, as pages have none."""
    rows = with_first(pages).mapInArrow(_archives(dictionary(pages), archive_bytes, level, date), "archive binary")
    (rows.select(F.col("archive").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).option("compression", "none").text(path))


def frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame that begins at `start` ends, by its block headers."""
    head = zstandard.frame_header_size(data[start : start + 18])
    at = start + head
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * zstandard.get_frame_parameters(data[start : start + head]).has_checksum
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(offset, bytes) of each frame; bytes that are none raise ValueError."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("bytes that are no frame")
        magic, length = struct.unpack("<II", data[at : at + 8])
        if magic in SKIPPABLE:
            end = at + 8 + length
            if end > len(data):
                raise ValueError("frame is cut off")
        elif bytes(data[at : at + 4]) == FRAME:
            try:
                end = frame_end(data, at)
            except zstandard.ZstdError as e:
                raise ValueError(str(e)) from e
        else:
            raise ValueError("bytes that are no frame")
        yield at, data[at:end]
        at = end


def decoder(lead: memoryview | None) -> zstandard.ZstdDecompressor:
    """For the frames of an archive; the dictionary may be compressed itself."""
    if lead is None or len(lead) == 8:
        return zstandard.ZstdDecompressor()
    words = bytes(lead[8:])
    if words[:4] == FRAME:
        words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined, a name that must be there once may not be repeated."""
    out: dict[str, str] = {}
    name = ""
    for line in filter(None, head.split(b"\r\n")):
        text = line.decode("utf-8", "strict")
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.lower()
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9a-z-]+", name):
            raise ValueError(f"no header field: {text[:80]}")
        if name in ONCE and name in out:
            raise ValueError(f"{name} is repeated")
        out[name] = value.strip()
    return out


def length_of(fields: dict[str, str]) -> int:
    text = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", text):
        raise ValueError(f"no content-length: {text[:40]!r}")
    return int(text)


def digest_fits(stated: str, payload: memoryview) -> bool:
    kind, _, value = stated.partition(":")
    if kind.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return True  # nothing to compare with
    real = hashlib.new(kind.lower(), payload)
    return value.lower() == real.hexdigest() or value.upper().rstrip("=") == base64.b32encode(real.digest()).decode().rstrip("=")


def parse(data: bytes) -> dict:
    """The fields of RECORDS of one record; ValueError says what is wrong with it."""
    head, gap, _ = data.partition(END)
    version, _, rest = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC header")
    fields = fields_of(rest)
    for name in ONCE:
        if not fields.get(name):
            raise ValueError(f"{name} is missing")
    block = memoryview(data)[len(head) + len(gap) :]
    if len(block) != length_of(fields) + len(END) or bytes(block[-len(END) :]) != END:
        raise ValueError("content-length does not fit the record")
    block, kind = block[: -len(END)], fields["warc-type"].lower()
    payload, size, stated = block, len(block), fields.get("warc-payload-digest")
    if kind in ("response", "revisit") and fields.get("content-type", "").lower().startswith("application/http"):
        http, gap, _ = bytes(block).partition(END)
        status, _, lines = http.partition(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
        inner = fields_of(lines)
        payload = block[len(http) + len(gap) :]
        size = length_of(inner) if kind == "revisit" or "content-length" in inner else len(payload)
        if kind == "response" and size != len(payload):
            raise ValueError("HTTP content-length does not fit the payload")
    if kind == "revisit":
        if not stated or not fields.get("warc-refers-to"):
            raise ValueError("revisit without digest or reference")
        if len(payload) and len(block) != len(payload):
            raise ValueError("revisit with a payload")
    elif stated and not digest_fits(stated, payload):
        raise ValueError("payload digest does not fit the payload")
    return {"record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
            "payload_digest": stated, "payload_bytes": size, "refers_to": fields.get("warc-refers-to"),
            "payload": None if kind == "revisit" else bytes(payload)}


def records_of(data: memoryview) -> Iterator[dict]:
    """All records of one archive, faulty ones with `error` in place of their fields."""
    coder, last, walk = None, 0, frames(data)
    while True:
        try:
            at, frame = next(walk)
        except StopIteration:
            return
        except ValueError as e:
            yield {"offset": last, "error": str(e)}
            return
        last = at + len(frame)
        leading = at == 0 and int.from_bytes(frame[:4], "little") == DICTIONARY_FRAME
        try:
            if coder is None:
                coder = decoder(frame if leading else None)
            if int.from_bytes(frame[:4], "little") in SKIPPABLE:
                continue
            one = coder.decompressobj()
            yield {"offset": at, "error": None} | parse(one.decompress(frame))
        except (ValueError, zstandard.ZstdError) as e:
            yield {"offset": at, "error": str(e)}


def _records(payloads: bool):
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds.get(f.split()[1], pa.string())) for n, f in zip(names, RECORDS.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for row in records_of(memoryview(content.as_buffer())):
                    if not payloads:
                        row.pop("payload", None)
                    rows.append(row | {"archive": path})
                    size += 500 + len(row.get("payload") or b"")
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row of RECORDS per record of the archives below `path`; without `payloads` that column is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_records(payloads), RECORDS)


def dangling(records: DataFrame) -> DataFrame:
    """References of revisits to no response of the same digest and length: `refers_to, payload_digest, payload_bytes, revisits`."""
    asked = (records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes")
             .agg(F.count("*").alias("revisits")))
    given = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return asked.join(given, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of each page, as read back from archives just written.

    The archives lie in a new folder below spark.checkpoint.dir. A faulty record or a revisit that refers to nothing
    fails the query.
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession, "llm/archives")
    write_archives(pages, path, archive_bytes)
    records = keep(read_archives(spark, path, payloads=False).drop("payload"), "records")
    lost = dangling(records).limit(5).collect()
    if lost:
        raise ValueError(f"revisits without their response: {lost}")

    def page(column: str):
        return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("archive"), F.lit(": "), F.col("error"))).cast("string")).otherwise(F.col("record_type"))
    return records.select(page("record_id").alias("page_id"), "payload_bytes",
                          F.substring_index("payload_digest", ":", -1).alias("payload_digest"), sound.alias("record_type"),
                          page("refers_to").alias("refers_to"))
