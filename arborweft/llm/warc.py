"""Legacy web archives to WARC, and WARC files read back.

``parse_arc`` reads ARC containers: the version block names the version, version 1 records have five header fields and
version 2 records ten, and a record's content is as long as its last field declares. Each becomes a record with what WARC wants
and ARC lacks: a record id (a hash of address, date and, without a page number, payload, then the page's number), an ISO date, a type
(response where the content is HTTP, else resource), and a base-32 SHA-1 of the payload, which is the content after the HTTP head.
Records with equal payloads become revisits of the one with the largest page_id. ``write_warc`` writes WARC/1.1 files, a gzip member
for each record, with Spark's writer into any file system, and ``read_warc`` reads them by declared length and checks digests.

Archives are cut by bytes: a container or file holds ``file_bytes`` or one record. Payloads are bytes, whatever their encoding.

Defined cases: null html is an empty payload, null url is empty; a header is split from its right end, so an address may hold blanks; what
cannot be read is a row with an error (a cut-off record with what there is of it) and the rows before it stay; error rows are not written;
a payload whose digest is not the declared one is read with an error; very long payloads are records of their own file; of a tie (equal
payloads of one page_id) the largest record id is the response; repeated rows of one page are equal records, all of the type of that page;
an empty table gives no archives and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.llm.common import bound_arrow

#: Fixed values of the ARC format: the header fields of the two versions.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "page_id long, url string, ip string, date string, mime string, status int, kind string, http_head binary, payload binary, payload_bytes long, payload_digest string, record_id string, error string"
READ = "page_id long, record_type string, url string, date string, payload_bytes long, payload_digest string, record_id string, refers_to_id string, payload binary, error string"
FILE_BYTES = 16 << 20
#: A gzip member holds less than this, so that its last byte, the highest of its size, is 0.
MEMBER = 1 << 24


def _arc(version: str, name: str, rows: list[tuple]) -> bytes:
    """One ARC container of (page_id, url, html, date) rows."""
    block = f"{version} 0 example\n{ARC_FIELDS[version]}\n\n".encode()
    head = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain"
    head += f" 200 - - 0 {name} {len(block)}" if version == "2" else f" {len(block)}"
    out = [head.encode(), b"\n", block]
    size = sum(map(len, out))
    for page, url, html, date in rows:
        body = html.encode() if html else b""
        number = b"" if page is None else b"X-Page-Id: %d\r\n" % page
        content = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + number + b"\r\n" + body
        address = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "") or "-"
        line = f"{address} 0.0.0.0 {date} text/html"
        if version == "2":
            line += f" 200 {hashlib.md5(content).hexdigest()} - {size} {name}"
        piece = f"{line} {len(content)}\n".encode() + content + b"\n"
        size += len(piece)
        out.append(piece)
    return b"".join(out)


def _by_bytes(rows, size, most: int):
    """Runs of rows of so many bytes together, or of one row that has more."""
    held, total = [], 0
    for r in rows:
        if held and total + size(r) > most:
            yield held
            held, total = [], 0
        held.append(r)
        total += size(r)
    if held:
        yield held


def pages_to_arc(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Legacy containers (name, content) of pages: version 1 for even numbers, version 2 for odd ones."""

    bound_arrow(pages.sparkSession)

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
            for version in "12":
                mine = [(p, u, h, f"20240101{(p or 0) % 24:02d}{(p or 0) // 24 % 60:02d}{(p or 0) // 1440 % 60:02d}") for p, u, h in rows if (p or 0) % 2 == int(version) - 1]
                for own in _by_bytes(mine, lambda r: 4 * len(r[2] or ""), file_bytes):
                    name = f"pages-{own[0][0]}-{len(own)}.arc"
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_arc(version, name, own)], pa.binary())], names=["name", "content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "name string, content binary")


def arc_records(content: bytes):
    """(fields, block, error) of each record after the version block. Reading ends with the first record that cannot be followed."""
    try:
        end = content.index(b"\n")
        size = int(content[:end].rsplit(b" ", 1)[1])
        block = content[end + 1 : end + 1 + size]
        names = block.split(b"\n")[1].decode("latin-1").strip().split(" ")
        if block[:1].decode("latin-1") not in ARC_FIELDS:
            raise ValueError("unknown ARC version")
    except (ValueError, IndexError) as e:
        yield {}, b"", f"version block: {e}"
        return
    at = end + 1 + size
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        head = content[at : end if end >= 0 else len(content)]
        # addresses may hold blanks, so fields are taken from the right
        fields = dict(zip(names, head.decode("utf-8", "replace").strip().rsplit(" ", len(names) - 1), strict=False))
        size = fields.get("Archive-length", "")
        if end < 0 or len(fields) < len(names) or not size.isdecimal():
            yield fields, b"", f"record header at byte {at}"
            return
        at = end + 1 + int(size)
        block = content[end + 1 : at]
        yield fields, block, None if len(block) == int(size) else f"truncated: {len(block)} of {size} bytes"


def _header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.decode("latin-1").lower() == name:
            return value.strip().decode("latin-1")
    return None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _convert(content: bytes):
    for fields, block, error in arc_records(content):
        is_http = block[:5] == b"HTTP/"
        head, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
        page = _header(head, "x-page-id") or ""
        page = int(page) if page.lstrip("-").isdecimal() and -(1 << 63) <= int(page) < 1 << 63 else None
        stamp = fields.get("Archive-date", "")
        date = None
        if stamp.isascii() and stamp.isdecimal() and 8 <= len(stamp) <= 14:
            d = stamp + "000000"[: 14 - len(stamp)]
            date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        elif error is None:
            error = f"date: {stamp}"
        digest, url = _digest(payload), fields.get("URL")
        own = hashlib.sha1(f"{url} {date}{'' if page is not None else ' ' + digest}".encode()).hexdigest()[:16] + f"{(page or 0) & (1 << 64) - 1:016x}"
        record_id = f"<urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:]}>"
        code = head[9:12] if is_http else fields.get("Result-code", "").encode()
        status = int(code) if code.isdigit() and len(code) == 3 else None
        yield page, url, fields.get("IP-address"), date, fields.get("Content-type"), status, "response" if is_http else "resource", head, payload, len(payload), digest, record_id, error


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    columns = [x.split() for x in ddl.split(", ")]
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def parse_arc(archives: DataFrame) -> DataFrame:
    """Records of ARC containers (column content), each with the identifiers, date and digest WARC wants; error is null where all is well."""

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                for rows in _by_bytes(_convert(content.as_py() or b""), lambda r: r[9], FILE_BYTES):
                    yield _batch(rows, RECORD)

    return archives.select("content").mapInArrow(run, RECORD)


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """records with record_type and refers_to_id: of equal payloads of min_bytes or more the largest page_id is kept."""
    narrow = records.where("error IS NULL").select("page_id", "payload_digest", "payload_bytes", "record_id").where(F.col("payload_bytes") >= min_bytes)
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), "record_id")).alias("best")
    groups = narrow.groupBy("payload_digest").agg(best, F.count("*").alias("n")).where("n > 1")
    refs = narrow.join(groups, "payload_digest").where(F.col("record_id") != F.col("best.record_id"))
    refs = refs.select("record_id", "payload_digest", F.col("best.record_id").alias("refers_to_id")).distinct()
    out = records.join(refs, ["record_id", "payload_digest"], "left")
    return out.withColumn("record_type", F.when(F.col("refers_to_id").isNull(), F.col("kind")).otherwise("revisit"))


def _record(r: dict) -> bytes:
    revisit, http = r["record_type"] == "revisit", r["kind"] == "response"
    block = (r["http_head"] + b"\r\n\r\n" if http else b"") + (b"" if revisit else r["payload"])
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}")]
    if revisit:
        fields += [("WARC-Refers-To", r["refers_to_id"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    # extension fields, which readers that do not know them pass over
    fields += [("X-Page-Id", r["page_id"]), ("X-Payload-Bytes", r["payload_bytes"])]
    fields += [("Content-Type", "application/http; msgtype=response" if http else r["mime"] or "application/octet-stream"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _members(record: bytes) -> bytes:
    return b"".join(gzip.compress(record[k : k + MEMBER - 1], 1, mtime=0) for k in range(0, len(record), MEMBER - 1))


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """WARC files of marked records without errors. A row of what is written is a whole file, less its last byte: that is 0, and the writer
    puts it after each row as separator."""
    bound_arrow(records.sparkSession)

    def run(batches):
        def rows():
            for b in batches:
                for values in zip(*(b.column(c) for c in b.schema.names), strict=True):
                    yield _members(_record({c: v.as_py() for c, v in zip(b.schema.names, values, strict=True)}))

        for own in _by_bytes(rows(), len, file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)[:-1]], pa.binary())], names=["value"])

    wanted = records.where("error IS NULL").select("page_id", "url", "ip", "date", "mime", "kind", "http_head", "payload", "payload_bytes", "payload_digest", "record_id", "record_type", "refers_to_id")
    files = wanted.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _plain(content: bytes, step: int = 1 << 14):
    """The bytes of gzip members one after the other, or of a file that is not compressed."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        member, out = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            out.append(member.decompress(view[at : at + step]))
            at += len(view[at : at + step])
        yield b"".join(out)
        if not member.eof:
            raise zlib.error("cut off")
        at -= len(member.unused_data)


def warc_records(content: bytes):
    """(headers, block, error) of each record, by declared length."""
    held, at, pieces = b"", 0, _plain(content)
    while True:
        try:
            while (end := held.find(b"\r\n\r\n", at)) < 0:
                held, at = held[at:] + next(pieces), 0
        except (StopIteration, zlib.error) as e:
            if held[at:].strip(b"\r\n") or isinstance(e, zlib.error):
                yield {}, b"", "truncated"
            return
        first, *lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("Content-Length", "")
        if not first.startswith("WARC/") or not size.isdecimal():
            yield headers, b"", "not a WARC record"
            return
        error, begin, stop = None, end + 4, end + 4 + int(size)
        parts, have = [held], len(held)
        try:
            while have < stop + 4:
                parts.append(next(pieces))
                have += len(parts[-1])
        except (StopIteration, zlib.error):
            error = None if have >= stop else f"truncated: {have - begin} of {size} bytes"
        held = b"".join(parts) if len(parts) > 1 else held
        yield headers, held[begin:stop], error
        at = stop + 4


def _read(content: bytes):
    for h, block, error in warc_records(content):
        http = h.get("Content-Type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        declared, page, size = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, h.get("X-Page-Id"), h.get("X-Payload-Bytes")
        if h.get("WARC-Type") != "revisit":
            size, found = len(payload), _digest(payload)
            if error is None and declared not in (None, found):
                error = f"digest: {found} is not {declared}"
            declared = declared or found
        yield (
            int(page) if page else None,
            h.get("WARC-Type"),
            h.get("WARC-Target-URI"),
            h.get("WARC-Date"),
            int(size) if size is not None else None,
            declared,
            h.get("WARC-Record-ID"),
            h.get("WARC-Refers-To"),
            payload,
            error,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path; error is null where all is well."""

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                for rows in _by_bytes(_read(content.as_py()), lambda r: len(r[8]), FILE_BYTES):
                    yield _batch(rows, READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def page_number(record_id: Column) -> Column:
    """The page number inside a record id; null stays null."""
    digits = F.regexp_replace(F.regexp_extract(record_id, "uuid:([0-9a-f-]+)", 1), "-", "")
    return F.conv(F.substring(digits, 17, 16), 16, -10).cast("long")
