"""Legacy archive converter: ARC files to WARC files.

ARC records are parsed by their version's header line and declared length.  Each becomes a
WARC record with a synthesised identifier, timestamp, type and digests; of records with
equal payloads one keeps the payload and the others become revisits of it.

Archives are written by Spark's text writer, one row for a run of records of bounded size,
gzip-compressed and with a bounded number of rows per file, and read as binary files, so
both sides work on any file system that Spark knows and on none that it doesn't.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masswright.session import ship_package

from .common import shared_path

#: The two versions' header fields.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a row, and rows in a file.
RUN_BYTES, RUNS_PER_FILE = 4 << 20, 8
SALTS = 32
CRLF = b"\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: URLs
_SCHEMA = "page_id long, url string, ip string, date string, mime string, http_head binary, payload binary, payload_digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 masswright\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = ["0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return f"filedesc://{name} {' '.join(tail)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, content: bytes, name: str, offset: int) -> bytes:
    more = ["200", payload_digest(content), "-", str(offset), name] if version == 2 else []
    return " ".join([url, ip, date, mime, *more, str(len(content))]).encode() + b"\n" + content + b"\n"


def _decoded(line: bytes) -> str:
    """Header lines are UTF-8, or Latin-1 in archives that never encoded their URLs."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, content) of every record; a version block sets the version of what follows."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header without an end at byte {at}")
        line = _decoded(data[at:end]).rstrip("\r")
        described = line.startswith("filedesc://")
        if described:
            version = int(data[end + 1 : end + 2])
        fields = ARC_FIELDS[version]
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"no version {version} ARC header at byte {at}: {line[:200]!r}")
        head = dict(zip(fields, values, strict=True))
        begin, at = end + 1, end + 1 + int(head["Archive-length"])
        if at > len(data):
            raise ValueError(f"ARC record cut short at byte {begin}")
        yield head, data[begin:at]


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line; empty if there is none) and payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    cut = content.find(CRLF * 2)
    return (content, b"") if cut < 0 else (content[: cut + 4], content[cut + 4 :])


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def warc_date(arc_date: str) -> str:
    """A 14-digit date, or a shorter one filled up, in the WARC form."""
    d = arc_date[:14] + "00000101000000"[len(arc_date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(url: str, http_head: bytes) -> str:
    if url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if http_head else "resource"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + CRLF * 2 + block + CRLF * 2


def record_id(url: str, date: str, digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {digest} {page_id}')}>"


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(CRLF * 2, at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, at = end + 4, end + 4 + int(head["content-length"])
        yield head, data[begin:at]


def _runs(records: Iterator[bytes], first: Callable[[int], bytes]) -> Iterator:
    """Rows of consecutive records; ``first`` gives the beginning of the k-th."""
    import pyarrow as pa

    held: list[bytes] = []
    size, number = 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([first(number) + b"".join(held)], pa.binary())], names=["run"])

    for record in records:
        held.append(record)
        size += len(record)
        if size >= RUN_BYTES:
            yield row()
            held, size, number = [], 0, number + 1
    if held:
        yield row()


def _write(runs: DataFrame, path: str) -> None:
    runs.select(F.col("run").cast("string").alias("value")).write.option("maxRecordsPerFile", RUNS_PER_FILE).option("compression", "gzip").text(path)


def _inflated(content: bytes) -> bytes:
    """A file's bytes; a compressed one may have one gzip member or, as archives usually do, one a record."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts, at = [], 0
    while content[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            chunk = content[at : at + (1 << 16)]
            if not chunk:
                raise ValueError("a gzip member is cut short")
            parts.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
    if content[at:].strip(b"\0"):
        raise ValueError("bytes after the last gzip member")
    return b"".join(parts)


def write_arc(pages: DataFrame, version: int, path: str, date: str = "20240101000000") -> None:
    """Write pages (page_id, url, html) as HTTP responses in ARC files.

    White space in a URL is percent-encoded, a null URL is written as ``unknown:``, a null
    page has an empty payload.
    """
    ship_package(pages.sparkSession)
    name = f"pages-v{version}.arc"

    def encode(batches: Iterator) -> Iterator:
        def records() -> Iterator[bytes]:
            offset = 0
            for batch in batches:
                for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    payload = (html or "").encode()
                    mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:")
                    record = arc_record(version, url, "0.0.0.0", date, "text/html", head.encode() + payload, name, offset)
                    offset += len(record)
                    yield record

        return _runs(records(), lambda _: arc_version_block(version, name, date))

    _write(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(encode, "run binary"), path)


def read_arc(spark: SparkSession, paths: list[str], with_payload: bool = True) -> DataFrame:
    """Parsed ARC records, without version blocks: page_id (null without its mark), url, ip, date, mime, http_head, payload, payload_digest."""
    ship_package(spark)

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for head, body in parse_arc(_inflated(content.as_py())):
                    if head["URL"].startswith("filedesc:"):
                        continue
                    http, payload = split_http(body)
                    page = http_field(http, "X-Page-Id")
                    rows.append((int(page) if page else None, head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], http, payload if with_payload else None, payload_digest(payload)))
                    size += len(body)
                    if size >= RUN_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(parse, _SCHEMA)


def convert_arc(spark: SparkSession, arc_paths: list[str], path: str | None = None, least_revisit_bytes: int = 0) -> str:
    """Convert ARC files to WARC files and return their path.

    Of records with equal payloads of at least ``least_revisit_bytes`` bytes those with
    the smallest page id stay responses, the others revisit it.  The table of repeated
    payloads is aggregated before it is shuffled and salted, so that a payload shared by
    many pages meets no single task.
    """
    path = path or shared_path(spark, "warc")
    groups = (
        read_arc(spark, arc_paths, with_payload=False)
        .where("page_id is not null")
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "url", "date")).alias("first"))
        .where("n > 1")
        .select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    rows = read_arc(spark, arc_paths).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(groups, ["payload_digest", "salt"], "left")
    revisit = (F.length("payload") >= least_revisit_bytes) & (F.col("first.page_id") < F.col("page_id"))
    rows = rows.select("page_id", "url", "ip", "date", "http_head", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"), "payload_digest", *[F.when(revisit, F.col(f"first.{c}")).alias(f"first_{c}") for c in ("page_id", "url", "date")], "mime")
    made = datetime.now(UTC).strftime("%Y%m%d%H%M%S")

    def encode(batches: Iterator) -> Iterator:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, ip, date, http, payload, digest, first, first_url, first_date, mime in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                    kind = "revisit" if first is not None else warc_type(url, http)
                    block = http + (payload or b"")
                    yield warc_record(
                        {
                            "WARC-Type": kind,
                            "WARC-Record-ID": record_id(url, date, digest, page),
                            "WARC-Date": warc_date(date),
                            "WARC-Target-URI": url,
                            "WARC-IP-Address": ip,
                            "WARC-Payload-Digest": f"sha1:{digest}",
                            "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
                            "WARC-Profile": REVISIT_PROFILE if first is not None else None,
                            "WARC-Refers-To": record_id(first_url, first_date, digest, first) if first is not None else None,
                            "WARC-Refers-To-Target-URI": first_url,
                            "WARC-Refers-To-Date": warc_date(first_date) if first_date else None,
                            "X-Refers-To-Page-Id": first,
                            "Content-Type": "application/http; msgtype=response" if http else mime,
                        },
                        block,
                    )

        part = TaskContext.get().partitionId()

        def info(run: int) -> bytes:
            head = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f"{path}#{part}", made, "warcinfo", run), "WARC-Date": warc_date(made), "Content-Type": "application/warc-fields"}
            return warc_record(head, b"software: masswright\r\nformat: WARC File Format 1.1\r\n")

        return _runs(records(), info)

    _write(rows.mapInArrow(encode, "run binary"), path)
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC records but warcinfo: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url.

    Digests of blocks and of payloads that are there are checked; a mismatch raises.  A
    revisit's payload size is that of its HTTP head.
    """
    ship_package(spark)

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_warc(_inflated(content.as_py())):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-block-digest"] != f"sha1:{payload_digest(block)}" or kind != "revisit" and payload_digest(payload) != digest:
                        raise ValueError(f"digest mismatch in {head['warc-record-id']}")
                    page = http_field(http, "X-Page-Id")
                    size = len(payload) if kind != "revisit" else int(http_field(http, "Content-Length") or 0)
                    first = head.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, size, digest, kind, int(first) if first else None, head["warc-record-id"], head["warc-target-uri"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def archive_pages(pages: DataFrame, least_revisit_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) to ARC files of both versions, to WARC files, and back.

    Pages with an even id go through version 1, all others through version 2.  Null html
    is an empty payload; pages with null ids are responses; rows with equal ids and equal
    payloads are alike (responses if the id is the payload's smallest).  An empty table
    gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    base = shared_path(spark, "arc")
    even = F.coalesce(F.pmod(F.col("page_id"), F.lit(2)) == 0, F.lit(False))
    for version, part in ((1, pages.where(even)), (2, pages.where(~even))):
        write_arc(part, version, f"{base}/v{version}")
    path = convert_arc(spark, [f"{base}/v1", f"{base}/v2"], least_revisit_bytes=least_revisit_bytes)
    return read_warc(spark, path)
