"""Legacy archive converter: ARC records to WARC records.

An ARC file starts with a version block, whose third line names the fields of the record header
lines; version 1 lines hold five fields, version 2 lines ten. A record is its header line and as
many bytes as the line's last field declares. Each becomes a WARC record: an identifier made from key, url, date and
payload digest; the 14-digit timestamp as an ISO date; a type (warcinfo for the version block,
response for HTTP messages, else resource; revisit where an equal payload is kept elsewhere); and SHA-1
digests in base32.

Cases: a null body is an empty one; payloads may be empty, hold any bytes and be of any length that
fits a row. A short timestamp is filled up (month and day 01, rest 0); one that is no date
becomes 1970-01-01T00:00:00Z. A header line with the wrong number of fields or
a length that is no number raises ValueError, but files give an error row for it and go on at the next line that can be a header; a body that the end of a file cuts off is kept as
far as it goes, with WARC-Truncated: disconnect. Equal records get
equal identifiers. An empty table gives an empty archive and an empty result.

Page ids may repeat with other payloads; rows with a null id never are what others refer to. Other columns of the pages are left out, whatever their names.

Archives are written by Spark's own writer to any file system it knows: a gzip member a record, in packs of ``PACK_BYTES`` or one larger record, at most
``PACKS_PER_FILE`` to a file. (An empty gzip member follows each pack: the writer needs something between its rows.) They are read back member by member, so that a
file's inflated records never stand in memory together.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import among, cut, discard, slices

# Fixed values of the format: header fields of both versions, in order.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
PACK_BYTES, PACKS_PER_FILE = 4 << 20, 16
#: Bytes that are inflated at a time.
CHUNK = 1 << 14
#: Fixed value: a gzip member of no bytes.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = "\r\n\r\n"


@dataclass
class ArcRecord:
    """One ARC record; ``fields`` by the names of its version."""

    version: int
    fields: dict[str, str]
    body: bytes
    cut: bool = False
    first: bool = False  # the version block of its file
    error: str | None = None  # why a line between records is no header


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        """Without the two line ends that follow each record in a file."""
        lines = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + self.block


def parse_header(line: str, version: int) -> dict[str, str]:
    """The fields of a record header line. A url may hold spaces; no other field does."""
    names = FIELDS[version]
    values = line.rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdigit():
        raise ValueError(f"not an ARC version {version} header: {line[:200]!r}")
    return dict(zip(names, values, strict=True))


#: A line that begins a record: a url, an address, a date and a length.
BEGINS = re.compile(rb"^[a-zA-Z][a-zA-Z0-9+.-]*:[^\n]* [^ \n]+ \d{4,14} [^\n]* \d+\r?$", re.M)


def read_arc(data: bytes, strict: bool = True) -> Iterator[tuple[int, ArcRecord]]:
    """(offset, record) of an ARC file's bytes, the version block first; gzip is undone.

    A line that is no header raises; unless strict, it gives a record with an error whose body is all up to the next line that can be one."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":  # between records
            at += 1
            continue
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        first = not version
        try:
            # the version block's own line has five fields in both versions
            fields = parse_header(line, version or 1)
            body = data[stop + 1 : stop + 1 + int(fields["Archive-length"])]
            if first:
                number = body.split(None, 1)[:1]
                version = int(number[0]) if number and number[0].isdigit() else 1
                if version not in FIELDS:
                    raise ValueError(f"ARC version {version}")
        except ValueError as e:
            if strict:
                raise
            version = version if version in FIELDS else 1
            after = BEGINS.search(data, stop + 1)
            stop = after.start() if after else len(data)
            yield at, ArcRecord(version, {}, data[at:stop], error=str(e))
            at = stop
            continue
        yield at, ArcRecord(version, fields, body, len(body) < int(fields["Archive-length"]), first)
        at = stop + 1 + len(body)


def digest(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(stamp: str) -> str:
    """ARC's timestamp of up to 14 digits as WARC writes it."""
    full = stamp[:14] + "00000101000000"[len(stamp) :] if stamp.isdigit() else ""
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def http_payload(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; a body that is none is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    found = re.search(rb"\r?\n\r?\n", body)
    return (body[: found.end()], body[found.end() :]) if found else (body, b"")


def record_id(key: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {payload_digest}')}>"


def to_warc(arc: ArcRecord, key: str, refers_to: tuple[str, str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record. refers_to: key, url and ARC date of the record that keeps an
    equal payload."""
    head, payload = http_payload(arc.body)
    payload_digest, date = digest(payload), iso_date(arc.fields["Archive-date"])
    first, http = arc.first, bool(head)
    headers = {
        "WARC-Type": "warcinfo" if first else "revisit" if refers_to and http else "response" if http else "resource",
        "WARC-Record-ID": record_id(key, payload_digest),
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\r\n]", "", arc.fields["URL"]),
        "WARC-IP-Address": arc.fields["IP-address"],
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Source-Key": key,
    }
    block = arc.body
    if first:
        headers["WARC-Filename"] = headers.pop("WARC-Target-URI").removeprefix("filedesc:").lstrip("/")
        headers["Content-Type"] = "application/warc-fields" if arc.fields["Content-type"] == "application/warc-fields" else arc.fields["Content-type"]
    elif http:
        headers["Content-Type"] = "application/http; msgtype=response"
        if refers_to:
            to_key, to_url, to_date = refers_to
            headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(to_key, payload_digest), "WARC-Refers-To-Target-URI": re.sub(r"[\r\n]", "", to_url), "WARC-Refers-To-Date": iso_date(to_date), "WARC-Refers-To-Key": to_key, "WARC-Payload-Length": str(len(payload))}
            block = head
    else:
        headers["Content-Type"] = arc.fields["Content-type"]
    if arc.cut:
        headers["WARC-Truncated"] = "disconnect"
    if arc.fields["IP-address"] in ("0.0.0.0", "-"):
        del headers["WARC-IP-Address"]
    headers |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    return WarcRecord(headers, block)


def members(data: bytes) -> Iterator[bytes]:
    """The inflated gzip members of a file, in time proportional to its size."""
    view, at = memoryview(data), 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            part = view[at : at + CHUNK]
            parts.append(member.decompress(part))
            at += len(part)
        at -= len(member.unused_data)  # a part of the last chunk at most
        yield b"".join(parts)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of a WARC file's bytes, by their declared lengths; gzip is undone, member by member."""
    if data[:2] == b"\x1f\x8b":
        for plain in members(data):
            yield from read_warc(plain)
        return
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        at = stop + 4 + int(headers["Content-Length"])
        yield WarcRecord(headers, data[stop + 4 : at])


def arc_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, version, header, body, first, error) of every record of the ARC files at a path; header is the
    record's line, first marks version blocks. Keys are path#offset. A line that is no header gives a row with an error and the bytes up to the next record, and no header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            name = b.column("path")[0].as_py()
            for offset, r in read_arc(b.column("content")[0].as_py(), strict=False):
                row = [f"{name}#{offset}", 1 if r.first else r.version, " ".join(r.fields.values()) if r.fields else None, r.body, r.first, r.error]
                types = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["key", "version", "header", "body", "first", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "key string, version int, header string, body binary, first boolean, error string")


def convert(arcs: DataFrame) -> DataFrame:
    """(key, warc) of ARC records (key, version, header, body), and optionally first, for version blocks, and refers_key, refers_url and
    refers_date of the record that keeps an equal payload. warc is the record's bytes. Rows without a header (errors) have none."""
    if "first" not in arcs.columns:
        arcs = arcs.withColumn("first", F.lit(False))
    for c in ("refers_key", "refers_url", "refers_date"):
        if c not in arcs.columns:
            arcs = arcs.withColumn(c, F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            made = []
            for r in b.to_pylist():
                fields = parse_header(r["header"], r["version"])
                body = (r["body"] or b"")[: int(fields["Archive-length"])]
                arc = ArcRecord(r["version"], fields, body, len(body) < int(fields["Archive-length"]), bool(r["first"]))
                to = (r["refers_key"], r["refers_url"] or "", r["refers_date"] or "") if r["refers_key"] is not None else None
                made.append(to_warc(arc, r["key"], to).to_bytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(made, pa.binary())], names=["key", "warc"])

    columns = ["key", "version", "header", "body", "first", "refers_key", "refers_url", "refers_date"]
    return arcs.filter("header IS NOT NULL").select(*columns).mapInArrow(run, "key string, warc binary")


def convert_files(files: DataFrame) -> DataFrame:
    """(key, warc) of the records in the bytes of ARC files (key, arc), without their version blocks; refers_key, refers_url and refers_date of a file hold for its record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            keys, made = [], []
            for r in b.to_pylist():
                to = (r["refers_key"], r["refers_url"] or "", r["refers_date"] or "") if r["refers_key"] is not None else None
                for k, (_, arc) in enumerate(read_arc(r["arc"])):
                    if k:
                        keys.append(r["key"])
                        made.append(to_warc(arc, r["key"], to).to_bytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(made, pa.binary())], names=["key", "warc"])

    return files.select("key", "arc", "refers_key", "refers_url", "refers_date").mapInArrow(run, "key string, warc binary")


def write_warc(warcs: DataFrame, path: str) -> None:
    """Write records (warc) as WARC files of gzip members, each record followed by two line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, size = [], 0
        for b in slices(batches, 16):
            for record in b.column("warc").to_pylist():
                pack.append(gzip.compress(record + END.encode(), 6, mtime=0))
                size += len(pack[-1])
                if size >= PACK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(pack)], pa.binary())], names=["value"])
                    pack, size = [], 0
        if pack:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(pack)], pa.binary())], names=["value"])

    rows = warcs.select("warc").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", PACKS_PER_FILE).text(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, date, record_type, payload_bytes, payload_digest, refers_to) of the archives at a path.

    The digest of a kept payload is computed anew and compared with the one declared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = []
            for r in read_warc(b.column("content")[0].as_py()):
                h = r.headers
                _, payload = http_payload(r.block)
                declared, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), h.get("WARC-Payload-Length")
                if n is None and digest(payload) != declared:
                    raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
                size = len(payload) if n is None else int(n)
                rows.append((h["WARC-Source-Key"], h.get("WARC-Target-URI"), h["WARC-Date"], h["WARC-Type"], size, declared, h.get("WARC-Refers-To-Key"), h["WARC-Record-ID"]))
            if rows:
                names = ["key", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id"]
                types = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "key string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to string, record_id string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def revisits(keyed: DataFrame) -> DataFrame:
    """(id, sha1, refers_id, refers_url) of rows (id, url, payload) whose payload a row with a smaller id has too.

    Only ids, urls and digests are shuffled, after a partial aggregation by digest."""
    small = keyed.select("id", F.sha1("payload").alias("sha1"), "url")
    first = small.groupBy("sha1").agg(F.min("id").alias("refers_id"), F.min_by("url", "id").alias("refers_url"), F.count(F.lit(1)).alias("_n"))
    first = first.filter("_n > 1").drop("_n")
    again = small.select("id", "sha1").distinct().join(first, "sha1")
    return again.filter(~F.col("id").eqNullSafe(F.col("refers_id")) & F.col("refers_id").isNotNull())


def version_block(version: int) -> bytes:
    """An ARC file's first record."""
    body = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n"
    return f"filedesc://pages.arc 0.0.0.0 20200101000000 text/plain {len(body)}\n{body}\n".encode()


def pages_to_arc(pages: DataFrame, date: str = "20200101000000") -> DataFrame:
    """ARC records (key, version, header, body) of pages (id, url, payload): version 1 and 2 by turns of the id; arc holds each as the bytes of an ARC file."""
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    head = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END)), "UTF-8")
    body = F.concat(head, payload)
    url = F.coalesce(F.translate("url", "\r\n", ""), F.lit("-"))
    length = F.octet_length(body).cast("string")
    two = F.coalesce(F.pmod(F.col("id"), F.lit(2)) == 1, F.lit(False))
    common = F.concat(url, F.lit(f" 0.0.0.0 {date} text/html "))
    header = F.when(two, F.concat(common, F.lit("200 - - 0 pages.arc "), length)).otherwise(F.concat(common, length))
    return pages.withColumns({"key": F.coalesce(F.col("id").cast("string"), F.lit("-")), "version": F.when(two, 2).otherwise(1).cast("int"), "header": header, "body": body}).withColumn(
        "arc", F.concat(F.when(two, F.lit(version_block(2))).otherwise(F.lit(version_block(1))), F.encode("header", "UTF-8"), F.lit(b"\n"), F.col("body"), F.lit(b"\n"))
    )


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write pages (id, url, payload binary) as WARC archives through ARC records, and read them back."""
    pages = pages.select("id", "url", "payload")
    again = cut(revisits(pages).withColumnRenamed("id", "_id").withColumnRenamed("sha1", "_sha1"), "revisits")
    # payloads that occur once are not shuffled; the others are dealt by id and digest
    maybe = among(F.col("id"), again.select(F.col("_id").alias("id")))
    none = [F.lit(None).cast(again.schema[c].dataType).alias(c) for c in ("refers_id", "refers_url")]
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.sha1("payload") == F.col("_sha1"))
    rest = pages.filter(maybe).join(again.hint("shuffle_hash"), match, "left").select("id", "url", "payload", "refers_id", "refers_url")
    arcs = pages_to_arc(pages.filter(~maybe).select("id", "url", "payload", *none).unionByName(rest))
    write_warc(convert_files(arcs.withColumns({"refers_key": F.col("refers_id").cast("string"), "refers_date": F.lit("20200101000000")})), path)
    discard(again)
    return read_back(pages.sparkSession, path)
