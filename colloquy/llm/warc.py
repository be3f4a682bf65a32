"""WARC archives with segmented records: written, read back and reassembled.

A page's payload goes into an HTTP response with chunked framing. A block over the segment size is cut:
the first record is of the page's own type, the rest are continuation records that name its identifier,
their number and, in the last, the total length. Reading groups continuation records by that identifier,
orders them by number, checks the total and removes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, new_path, small_batches

SEGMENT, CHUNK = 32_768, 8_192
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Records in a file: with the segment size, the bound of a file.
FILE_RECORDS = 1000
_END = "\r\n\r\n"
_HEX, _OWN = re.compile(rb"[0-9A-Fa-f]{1,16}"), re.compile(r"<urn:page:(-?[0-9]{1,19})>")
#: Bytes that a part of a decompressed file, a record's header and the blocks of a batch have at most.
PART_BYTES, HEAD_BYTES, BATCH_BYTES = 65_536, 1 << 20, 8 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f-￿]")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without end")
        digits = framed[at:end].split(b";")[0].strip()
        if not _HEX.fullmatch(digits):
            raise ValueError("chunk size that is no number")
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if framed[at : at + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(framed[end + 2 : at])
        at += 2


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, record_id: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page, without the blank lines after each."""
    payload = (html or "").encode("utf-8", "replace")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head if refers_to is not None else head + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    uri = _UNSAFE.sub(lambda m: "".join(f"%{x:02X}" for x in m[0].encode("utf-8", "replace")), url or "")
    for n, part in enumerate(parts, 1):
        fields = [("WARC-Type", "continuation" if n > 1 else "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{record_id}:{n}>"), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")]
        if n == 1:
            fields += [("X-Page-Id", "" if page_id is None else page_id), ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest())]
            if refers_to is not None:
                fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        else:
            fields.append(("WARC-Segment-Origin-ID", f"<urn:page:{record_id}:1>"))
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", n))
            if n == len(parts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        fields.append(("Content-Length", len(part)))
        yield ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + part


def members(raw: bytes) -> Iterator[bytes | str]:
    """What an archive's file holds, part by part: all gzip members one after the other, or the bytes as they are; as text, what is wrong with it."""
    view = memoryview(raw)
    if not raw.startswith(b"\x1f\x8b"):
        yield from (bytes(view[at : at + PART_BYTES]) for at in range(0, len(raw), PART_BYTES))
        return
    at = 0
    while at < len(raw):
        one = zlib.decompressobj(31)
        while at < len(raw) and not one.eof:
            part = view[at : at + PART_BYTES]
            try:
                got = one.decompress(part, 16 * PART_BYTES)
                at += len(part) - len(one.unused_data) - len(one.unconsumed_tail)
                if got:
                    yield got
            except zlib.error as e:
                yield f"broken gzip member: {e}"
                return
        if not one.eof:
            yield "gzip member without end"
            return
        while at < len(raw) and raw[at] == 0:  # padding
            at += 1


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive; no fields for bytes that are no record, and their number as text.

    One record is held at a time, and what follows it in its last part.
    """
    coming, held = iter(parts), bytearray()

    def more() -> bool:
        part = next(coming, None)
        held.extend(part or b"")
        return part is not None

    def until(mark: bytes, start: int, most: int) -> int:
        """Where the mark is, with what must be read for it; -1 if it isn't within so many bytes."""
        while (at := held.find(mark, start)) < 0 and len(held) < most and more():
            start = max(start, len(held) - len(mark) - PART_BYTES * 16)
        return at

    while True:
        while len(held) < 5 and more():
            pass
        if not held:
            return
        if held.startswith(_END.encode()):
            del held[:4]
            continue
        end = until(b"\r\n\r\n", 0, HEAD_BYTES) if held.startswith(b"WARC/") else -1
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:] if end >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = _number(fields.get("content-length"))
        if length is not None and length >= 0 and "warc-type" in fields:
            while len(held) < end + 4 + length and more():
                pass
            if len(held) >= end + 4 + length:
                yield fields, bytes(held[end + 4 : end + 4 + length])
                del held[: end + 4 + length]
                continue
        # what isn't a record goes on to where the next one seems to begin
        gone, mark = 0, b"\r\n\r\nWARC/"
        while (at := held.find(mark, 0 if gone else 1)) < 0:
            drop = max(0, len(held) - len(mark))
            if drop and gone == 0:
                drop -= 1
            gone += drop
            del held[:drop]
            if not more():
                gone, at = gone + len(held), None
                held.clear()
                break
        if at is not None:
            gone += at + 4
            del held[: at + 4]
        yield {}, str(gone).encode()


def _number(text: str | None) -> int | None:
    """A whole number of 64 bits in plain digits; null for anything else."""
    plain = re.fullmatch("-?[0-9]{1,19}", text or "")
    return value if plain and -(2**63) <= (value := int(plain[0])) < 2**63 else None


def write(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) at path, gzip-compressed; null html counts as empty.

    Of equal payloads of at least REVISIT_BYTES bytes, the page with the largest page_id is stored and others
    refer to it. Repeated rows of that page are each stored; a null page_id never refers to another. An empty table
    gives archives without records.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1(F.col("html").cast("binary"))))
    # what refers to what is found without the payloads; these are dealt by page, so no payload's copies meet in one task
    large = rows.where("digest is not null")
    keys = large.select("page_id", "digest")
    stored = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    refers = keys.join(stored, "digest").where("page_id <> refers_to").distinct()
    large = large.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    rows = large.unionByName(rows.where("digest is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += records(*page, f"{task}-{n}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the text writer ends each record with the blank lines it needs; bytes pass through it as they are
    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, error for each page in archives at path.

    payload_* are of the payload as reassembled; null in a revisit, whose record has the digest it names.
    error tells what failed: a missing segment, a wrong total, broken framing, a wrong digest, a number that is none,
    bytes that are no record or a broken gzip member; else null. Nothing in a file makes reading stop or fail. refers_to
    is the page of the record that a revisit names, null if that isn't in these archives. Files are plain or of any number of
    gzip members; a file's own bytes are held, and of what is in it one record and a batch of bounded bytes. Records of other
    kinds than pages (requests, metadata) are left out.
    """
    small_batches(spark, 1)  # a row is a file
    arrow = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers", pa.string()), ("record_id", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])
    failed = lambda why: (*[None] * 12, why)

    def row(f: dict[str, str], block: bytes) -> tuple | None:
        kind = f["warc-type"]
        if kind not in ("response", "revisit", "resource", "continuation"):
            return None
        numbers = {name: _number(f[name]) for name in ("x-page-id", "warc-segment-number", "warc-segment-total-length") if f.get(name)}
        bad = next((name for name, value in numbers.items() if value is None), None)
        if bad:
            return failed(f"{bad} that is no number of 64 bits")
        kind, digest, refers = None if kind == "continuation" else kind, _hex(f.get("warc-payload-digest")), f.get("warc-refers-to")
        own = _number(m[1]) if (m := _OWN.fullmatch(refers or "")) else None
        page, segment, total = (numbers.get(n) for n in ("x-page-id", "warc-segment-number", "warc-segment-total-length"))
        # a whole record is decoded here; a segment's block moves on
        found = (None, None, None) if segment is not None else _payload(block, kind, digest)
        origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
        return (page, kind, own, refers if own is None else None, f.get("warc-record-id") if kind else None, digest, origin, segment, total, block if segment is not None else None, *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(arrow), arrow.types, strict=True)], schema=arrow)

        for b in batches:
            for raw in b.column(0).to_pylist():
                out, size, wrong = [], 0, []
                parts = (p for p in members(raw) if isinstance(p, bytes) or wrong.append(p))
                for f, block in parse(parts):
                    got = row(f, block) if f else failed(f"{block.decode()} bytes that are no record")
                    if got:
                        out.append(got)
                        size += len(block) if got[9] is not None else 0
                    if size > BATCH_BYTES or len(out) > 10_000:
                        yield batch(out)
                        out, size = [], 0
                yield batch([*out, *map(failed, wrong)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    names = ["page_id", "record_type", "refers_to", "digest", "payload_bytes", "payload_digest", "error"]
    read_once = materialize(files.mapInArrow(run, "page_id long, record_type string, refers_to long, refers string, record_id string, digest string, origin string, segment long, total long, block binary, payload_bytes long, payload_digest string, error string"), "records")
    small_batches(spark)
    # only segmented pages are shuffled with their blocks
    segments = read_once.where("segment is not null").groupBy("origin").agg(
        *(F.max(c).alias(c) for c in ("page_id", "record_type", "refers_to", "refers", "digest", "total")), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    joined = segments.mapInArrow(_decode_parts, "page_id long, record_type string, refers_to long, refers string, digest string, payload_bytes long, payload_digest string, error string")
    told = read_once.where("segment is null").select(*names, "refers").unionByName(joined.select(*names, "refers"))
    # another writer's revisit names a record: its page is looked up; one that isn't in these archives stays null
    pages = read_once.where("record_id is not null and page_id is not null").groupBy(F.col("record_id").alias("refers")).agg(F.max("page_id").alias("named"))
    other = told.where("refers is not null").join(pages, "refers", "left").withColumn("refers_to", F.col("named")).select(names)
    return told.where("refers is null").select(names).unionByName(other)


def _hex(digest: str | None) -> str | None:
    """A SHA-1 header as lower-case hex, whether it is in hex or base 32; null for none and for other digests."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else value.lower() or None


def _payload(block: bytes, kind: str | None, digest: str | None) -> tuple[int | None, str | None, str | None]:
    """Bytes and digest of a block's payload, and what is wrong with it."""
    if kind == "revisit":
        return None, digest, None
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        if not head.startswith(b"HTTP/"):
            payload = block  # a resource
        else:
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return None, None, str(e)
    got = hashlib.sha1(payload).hexdigest()
    return len(payload), got, None if digest in (None, got) else "wrong digest"


_DECODED = (pa.int64(), pa.string(), pa.string())


def _decode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = b.to_pydict()
        got = []
        for parts, total, kind, digest in zip(t["parts"], t["total"], t["record_type"], t["digest"], strict=True):
            block = b"".join(p["block"] for p in parts)
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or kind is None:
                got.append((None, None, "missing segment"))
            elif len(block) != total:
                got.append((None, None, "wrong total length"))
            else:
                got.append(_payload(block, kind, digest))
        cols = list(zip(*got, strict=True)) or [()] * 3
        keep = ["page_id", "record_type", "refers_to", "refers", "digest"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, k) for c, k in zip(cols, _DECODED, strict=True))], [*keep, "payload_bytes", "payload_digest", "error"])


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives written and read back.

    A revisit's size is that of the stored payload it refers to. A record that can't be read back raises. Other
    columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    got = materialize(read(spark, path), "pages")
    bad = got.where("error is not null").select("page_id", "error").first()
    if bad:
        raise ValueError(f"page {bad.page_id}: {bad.error}")
    stored = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stored_digest")).agg(F.max("payload_bytes").alias("stored_bytes"))
    revisits = got.where("record_type = 'revisit'").alias("r").join(stored.alias("s"), (F.col("r.refers_to") == F.col("s.refers_to")) & (F.col("r.payload_digest") == F.col("s.stored_digest")), "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = revisits.select(F.col("r.page_id").alias("page_id"), F.col("s.stored_bytes").alias("payload_bytes"), F.col("r.payload_digest").alias("payload_digest"), F.col("r.record_type").alias("record_type"), F.col("r.refers_to").alias("refers_to"))
    return got.where("record_type = 'response'").select(names).unionByName(revisits)
