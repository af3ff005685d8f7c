"""Legacy ARC archives and their conversion to WARC, written to and read from the shared folder."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, passes, small, text_column, written

#: Payloads below this size are never revisits.
LEAST_BYTES = 0
#: Bytes of an archive file from which on the next one begins.
FILE_BYTES = 32 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: The field lines that the two versions of the ARC format declare.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\r\n\r\n"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    body: bytes


def write_arc(name: str, records: list[ArcRecord], version: int = 1) -> bytes:
    """An ARC file: a version block, then a header line and the declared number of bytes for each record."""
    about = f"{version} 0 strandlake\n{FIELDS[version]}\n\n".encode()

    def line(r: ArcRecord, body: bytes) -> bytes:
        url = re.sub(r"\s", lambda m: f"%{ord(m[0]) & 0xFF:02X}", r.url) or "-"
        more = "" if version == 1 else f" 200 - - 0 {name}"
        return f"{url} {r.ip} {r.date} {r.kind}{more} {len(body)}\n".encode()

    parts = []
    for r in [ArcRecord(f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", about), *records]:
        parts += [line(r, r.body), r.body, b"\n"]
    return b"".join(parts)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file without its version block. Lengths are those declared; the version tells the header's fields."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is not None and len(parts) != len(fields):
            raise ValueError(f"an ARC header line of {len(parts)} fields at {at}; {len(fields)} are declared")
        if not parts[-1].isdigit() or end < 0 or end + 1 + int(parts[-1]) > len(data):
            raise ValueError(f"no valid length in the ARC header line at {at}")
        body = data[end + 1 : end + 1 + int(parts[-1])]
        at = end + 1 + len(body)
        if fields is None:
            version = int(body.split(b" ", 1)[0])
            if not parts[0].startswith("filedesc://") or version not in FIELDS:
                raise ValueError("no ARC version block of version 1 or 2")
            fields = FIELDS[version].split(" ")
            continue
        named = dict(zip(fields, parts))
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], body)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload) of an HTTP message; all payload if there is no head."""
    end = body.find(b"\r\n\r\n") if body.startswith(b"HTTP/") else -4
    return body[: end + 4], body[end + 4 :]


def converted(record: ArcRecord) -> dict[str, str | bytes]:
    """The parts of an equivalent WARC record: identifier, timestamp, target, address, digests, HTTP head and payload.

    The identifier is made from the record's own content, so converting twice gives the same one.
    """
    head, payload = split_http(record.body)
    d = (record.date + "19700101000000"[len(record.date) :])[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    block = digest_of(record.body)
    return {"id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record.url} {d} {block}')}>", "date": date, "uri": record.url, "ip": record.ip, "block_digest": block, "payload_digest": digest_of(payload), "head": head, "payload": payload}


def unzipped(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds; the data themselves if they aren't gzip."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + (1 << 16)]
            parts.append(unpack.decompress(piece))
            at += len(piece)
        at -= len(unpack.unused_data)
        yield b"".join(parts)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by declared lengths. gzip members are unpacked one by one; each holds whole records."""
    for content in unzipped(data):
        at = 0
        while at < len(content):
            end = content.index(b"\r\n\r\n", at)
            lines = content[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError(f"no WARC record at {at}")
            headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
            begin = end + 4
            at = begin + int(headers["content-length"])
            yield headers, content[begin:at]
            if content[at : at + 4] != b"\r\n\r\n":
                raise ValueError(f"no end of a WARC record at {at}")
            at += 4


def warc_record(headers: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    """A record; headers without a value are left out."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + END.encode()


def record_id(key: int | None, payload: bytes) -> str:
    """An identifier made from the page's key and payload: writing twice gives the same one. _record_id is the same as a column."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{"" if key is None else key} {hashlib.sha1(payload).hexdigest()}')}>"


def _record_id(key: Column, sha: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), sha).cast("binary")))
    part = lambda begin, length: F.substr(digest, F.lit(begin), F.lit(length))
    variant = F.substr(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


_PARTS = "page_id bigint, n bigint, payload_digest string, block_digest string, id string, date string, uri string, ip string, head string, payload string"


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write a WARC record per row of pages, by way of ARC records of both versions, as files in the shared folder; its path.

    A file begins with a warcinfo record, has a gzip member for each record, and ends with the record that brings it to
    file_bytes; so files can be read apart, and a lost executor costs a bounded part of the work.

    Of records with equal payloads of at least least_bytes bytes, the one with the smallest key is a response and the
    others are revisits that name it; rows that share this key and payload are all responses. A null key orders behind all
    others and is written as no key; payloads met under null keys only are all responses. A null page has an empty payload;
    an empty table gives no records.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), text_column(f"`{source}`").alias("html"))

    def convert(batches):
        for batch in small(batches):
            keys, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, group in passes(batch.column(2).cast(pa.binary()).to_pylist(), 4 << 20):
                records = []
                for k, payload in enumerate(group, start):
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                    records.append(ArcRecord(urls[k] or f"urn:page:{keys[k]}", "0.0.0.0", "20240101000000", "text/html", head.encode() + payload))
                found: list = [None] * len(group)
                for version in FIELDS:  # rows in turn go by archives of either version
                    found[version - 1 :: 2] = [converted(r) for r in read_arc(write_arc(f"part-{start}.arc", records[version - 1 :: 2], version))]
                own = keys[start : start + len(group)]
                column = lambda name: pa.array([f[name] for f in found], pa.string())
                text = lambda name: pa.array([f[name] for f in found], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(group)), pa.array([len(f["payload"]) for f in found], pa.int64()), column("payload_digest"), column("block_digest"), pa.array([record_id(k, f["payload"]) for k, f in zip(own, found)]), column("date"), column("uri"), column("ip"), text("head"), text("payload")],
                    [x.split()[0] for x in _PARTS.split(", ")],
                )

    def pack(batches):
        date, held, size = None, [], 0
        zipped = lambda record: zlib.compress(record, wbits=31)
        # The text writer ends each file with a zero byte: the last one of an empty gzip member, which has no length.
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join([*held, zipped(b"")[:-1]])], pa.binary())], ["value"])
        for batch in small(batches, 200):
            for r in batch.to_pylist():
                if not held:
                    about = b"software: strandlake\r\nformat: WARC File Format 1.1\r\n"
                    date = r["date"]
                    held.append(zipped(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, r['id'])}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)))
                again = r["first"] is not None
                block = (r["head"] + ("" if again else r["payload"])).encode()
                revisit = [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", r["first_id"]), ("WARC-Refers-To-Target-URI", re.sub(r"\s", "%20", r["first_url"] or f"urn:page:{r['first']}")), ("WARC-Refers-To-Date", r["date"]), ("X-Refers-To-Page-Id", r["first"]),
                ] if again else [("WARC-Block-Digest", f"sha1:{r['block_digest']}")]
                headers = [
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", r["id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]), *revisit,
                    ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("X-Page-Id", r["page_id"]), ("Content-Type", "application/http; msgtype=response"),
                ]
                held.append(zipped(warc_record(headers, block)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    parts = rows.mapInArrow(convert, _PARTS)
    sha = F.sha1(F.col("html").cast("binary"))
    firsts = rows.groupBy(sha.alias("sha"), F.octet_length("html").cast("bigint").alias("size")).agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("times"))
    # A table of its own, so that the join below shuffles both sides and a payload that very many pages have can be split.
    firsts = written(firsts.filter((F.col("times") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull()).select("sha", "size", "first", "first_url", _record_id(F.col("first"), F.col("sha")).alias("first_id")), "firsts")
    parts = parts.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    joined = parts.join(firsts, (parts.sha == firsts.sha) & (parts.n == firsts["size"]), "left")
    own = F.col("first").eqNullSafe(F.col("page_id"))
    shown = joined.select("page_id", "payload_digest", "block_digest", "id", "date", "uri", "ip", "head", F.when(F.col("first").isNull() | own, F.col("payload")).alias("payload"), F.when(~own, F.col("first")).alias("first"), F.when(~own, F.col("first_url")).alias("first_url"), F.when(~own, F.col("first_id")).alias("first_id"))
    path = fresh_path(spark, "warc")
    # Spark's text writer takes the bytes as they are; each row, the whole of an archive, is a file.
    shown.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def read_archive(spark, path: str) -> DataFrame:
    """One row per response and revisit of the WARC files at path: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from its payload and must equal the declared one. A record without a key has a null
    page_id; other kinds of records are passed over; an archive without records gives no rows.
    """

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_warc(content.as_py()):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    http = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:] if x)}
                    declared = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    if kind == "response" and digest_of(payload) != declared:
                        raise ValueError(f"a payload's digest isn't {declared}")
                    rows.append((number(headers.get("x-page-id")), size, declared, kind, number(headers.get("x-refers-to-page-id"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
