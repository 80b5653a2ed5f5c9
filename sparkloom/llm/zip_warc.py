"""WARC records in ZIP-packaged archives: writing them, and reading single records by byte range.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member per WARC
record) and ``indexes/index.cdxj`` (one line per record with its offset and length).  A reader parses the end of
central directory record and its ZIP64 form, finds the stored members, reads the index, and fetches records by
ranges of the file; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import pick, shared_dir, slices, written

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
#: Bytes of an archive that one range read takes, about, and of the gzip-compressed data of one archive.
RANGE, ARCHIVE = 8 << 20, 256 << 20
#: Up to so many revisits, their table is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_REVISITS = 200_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# ZIP -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def central_directory(read_at, size: int) -> list[Member]:
    """The members of a ZIP file of ``size`` bytes; ``read_at(offset, n)`` reads a range of it.

    Understands ZIP64 and comments; a file without an end record, or split over disks, is a ValueError.
    """
    tail_at = max(0, size - (22 + 65535 + 20))
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    disk, start_disk, _, count, length, offset, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end = read_at(where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where the locator says")
        disk, start_disk, _, count, length, offset = struct.unpack_from("<IIQQQQ", end, 16)
    if disk or start_disk:
        raise ValueError("archives of several disks are not understood")
    data, at, out = read_at(offset, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, i)
            if tag == 1:  # ZIP64: those of the fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            i += 4 + n
        out.append(Member(name, method, plain, stored, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(read_at, member: Member) -> int:
    """Where the bytes of a member begin."""
    local = read_at(member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


# WARC ------------------------------------------------------------------------------------------------------------


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC 1.1 record, as a gzip member: a response with the payload, or a revisit without it."""
    revisit = refers_to is not None
    kind = "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, Content-Length of the HTTP message) of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return headers, payload, length


# writing ---------------------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, same: the pages whose payload a page with a larger page_id has too.

    ``same`` lists (payload, keep): the payload's SHA-256 and the largest page_id with it; more than one only where
    rows with different payloads share a page_id.
    """

    def digests(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            big = [i for i, x in enumerate(data) if len(x) >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(big, pa.int64())), pa.array([hashlib.sha256(data[i]).digest() for i in big], pa.binary())], schema=schema)

    each = written(pick(pages, "page_id", "html").mapInArrow(digests, "page_id long, payload binary"), "payloads")
    groups = each.groupBy("payload").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    return each.join(groups, "payload").where("page_id is null or page_id < keep").where("keep is not null").groupBy("page_id").agg(F.collect_set(F.struct("payload", "keep")).alias("same"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the WARC record of every row of ``pages`` (page_id, url, html) into archives below ``folder``.

    Returns the archives' table: path, n_records.  Each task writes files of its own, whose names no other attempt
    shares, and only those of finished tasks are in the table; so lost executors do no harm.  Of rows with equal
    payloads of at least ``least`` bytes that with the largest page_id is a response, the others are revisits of
    it; rows that share this largest page_id too are all responses.  Null html is an empty payload, a null url
    becomes a urn, a null page_id is smaller than any other.
    """
    again = written(revisits(pages, least), "revisits")
    rows = pick(pages, "page_id", "url", "html")
    small = again.withColumnsRenamed({"page_id": "_p"})
    if again.count() <= BROADCAST_REVISITS:
        small = F.broadcast(small)
    rows = rows.join(small, F.col("page_id").eqNullSafe(F.col("_p")), "left").select("page_id", "url", "html", "same")

    def write(batches):
        out = Archive(folder)
        schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
        done = []
        for whole in batches:
            for batch in slices(whole, "html"):
                for page, url, html, same in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    found = {x["payload"]: x["keep"] for x in same or ()}
                    keep = found.get(hashlib.sha256(payload).digest()) if found and len(payload) >= least else None
                    digest = hashlib.sha1(payload).hexdigest()
                    out.add(page, url, payload, digest, keep)
                    if out.size >= ARCHIVE:
                        done.append(out.close())
                        out = Archive(folder)
        if out.records:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], schema=schema)

    return written(rows.mapInArrow(write, "path string, n_records long"), "archives")


class Archive:
    """One archive being written, from front to back."""

    def __init__(self, folder: str):
        self.folder, self.records, self.size, self.lines = folder, 0, 0, []

    def _open(self) -> None:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.wacz"
        self.path = f"{self.folder}/{name}"
        self.file = fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
        self.zip = zipfile.ZipFile(_Forward(self.file), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id, url, payload: bytes, digest: str, keep) -> None:
        """Appends a record and notes where it is."""
        if not self.records:
            self._open()
        member = warc_record(page_id, url, payload, digest, keep)
        self.data.write(member)
        self.lines.append(json.dumps({"page": page_id, "offset": self.size, "length": len(member), "mime": "text/html" if keep is None else "warc/revisit"}))
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple[str, int]:
        """Writes the index and the central directory."""
        self.data.close()
        info = zipfile.ZipInfo(INDEX)
        info.compress_type = zipfile.ZIP_STORED
        self.zip.writestr(info, "\n".join(self.lines) + "\n")
        self.zip.close()
        self.file.close()
        return self.path, self.records


class _Forward:
    """A file that can only be written forward; zipfile then uses data descriptors."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


# reading ---------------------------------------------------------------------------------------------------------


def index_of(path: str) -> tuple[int, list[dict]]:
    """(where the WARC data begins in the file, index lines) of an archive."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        read_at = lambda at, n: f.read_at(n, at)
        members = {m.name: m for m in central_directory(read_at, f.size())}
        for m in (members[DATA], members[INDEX]):
            if m.method:
                raise ValueError(f"{m.name} is not stored")
        lines = read_at(data_offset(read_at, members[INDEX]), members[INDEX].stored)
        return data_offset(read_at, members[DATA]), [json.loads(x) for x in lines.decode().splitlines()]


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives (path): page_id, payload, payload_bytes, payload_digest, record_type, refers_to.

    A first pass reads directories and indexes and cuts each archive into ranges of neighbouring records; a second
    reads the ranges.  The payload of a revisit is null; its digest and length are those that its headers tell.
    A payload whose digest differs from its header is an error.
    """

    def ranges(batches):
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                base, lines = index_of(path)
                begin, lengths, out = 0, [], []
                for line in lines:
                    if lengths and sum(lengths) + line["length"] > RANGE:
                        out.append((base + begin, lengths))
                        lengths = []
                    if not lengths:
                        begin = line["offset"]
                    lengths.append(line["length"])
                if lengths:
                    out.append((base + begin, lengths))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], schema=schema)

    def records(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path, at, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    data = f.read_at(sum(lengths), at)
                rows, pos = [], 0
                for n in lengths:
                    rows.append(_row(*parse_record(data[pos : pos + n])))
                    pos += n
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    todo = archives.select("path").mapInArrow(ranges, "path string, at long, lengths array<long>")
    todo = todo.repartition(F.xxhash64("path", "at"))
    return todo.mapInArrow(records, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _row(headers: dict[str, str], payload: bytes, length: int) -> tuple:
    number = lambda k: int(headers[k]) if headers.get(k) else None
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = headers["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"record {headers['warc-record-id']} is damaged")
    return number("warc-page-id"), payload if kind == "response" else None, length, digest, kind, number("warc-refers-to-page-id") if kind == "revisit" else None


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC records into ZIP archives and read back."""
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_dir(spark)}/wacz")
    return read_archives(archives).drop("payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN NULL ELSE g.keep END::BIGINT AS refers_to
FROM p LEFT JOIN g ON p.n >= 1000 AND p.html = g.html
"""
