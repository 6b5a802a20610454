"""WARC archives: a writer, and a reader that salvages damaged files.

The writer makes one record per page: a ``response`` with the payload, or a
``revisit`` that names the response with the same payload (of at least
``MIN_REVISIT`` bytes) and the smallest page id. Records are gzip members of
their own (or plain), written through Spark's text sink, so any file system
Spark knows will do; archives hold about ``ARCHIVE_BYTES`` of payload.

The reader takes whole archive files. Each record is checked: member
checksum, header, lengths, block and payload digests. After a failed check
it searches for the next gzip member that decodes to a record, or the next
version line that begins a valid one, goes on there, and logs the bytes in
between as a quarantined gap.

Defined results: null html is an empty payload; a null url is left out; a
null page id is kept as null (such a page is never the one others refer to
while its group has an id). Repeated rows are separate records; rows with
the smallest id are all responses. An empty table gives no record. Extra
columns are ignored. Pages are dealt to archives by a hash; equal payloads
meet only as partial minima of their digests, and Spark splits a large
digest in the join.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ticksmith.llm.common import lean, small_batches, stored
from ticksmith.session import scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 32_000_000
VERSION = b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_PRINTABLE = re.compile(r"[^\x21-\x7e]")


# --- writing --------------------------------------------------------------

def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, record_type, refers_to``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), F.sha2(html, 256).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))
    same = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest") \
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    same = stored(same.select("payload_digest", "first"), "shared-payloads")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(same, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _sha(b: bytes) -> str:
    return "sha256:" + hashlib.sha256(b).hexdigest()


def _headers(pairs: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in pairs if v is not None]
    lines += [f"WARC-Block-Digest: {_sha(block)}\r\n", f"Content-Length: {len(block)}\r\n"]
    return VERSION + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """One record, plain. Bytes of a url that are not printable ASCII are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = None if url is None else _PRINTABLE.sub(
        lambda m: "".join(f"%{b:02X}" for b in m.group().encode("utf-8", "replace")), url)
    revisit = record_type == "revisit"
    return _headers([
        ("WARC-Type", record_type), ("WARC-Record-ID", f"<{_ID}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Refers-To", f"<{_ID}{refers_to}>" if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)


def write_archives(pages: DataFrame, path: str, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, **cols) -> None:
    """Write the pages' records as archive files in the folder ``path``.

    The text sink ends every row with one separator. Plain records end in a
    line feed; a gzip member below 16 MiB ends in the zero byte that tops its
    length field. That last byte is left to the separator; a larger member
    is followed by one zero byte of padding, which gzip readers skip.
    """
    small_batches(pages.sparkSession)
    total = pages.agg(F.sum(F.octet_length(cols.get("html_col", "html")))).first()[0] or 0
    planned = plan_records(pages, **cols)
    dealt = planned.repartition(max(1, -(-total // archive_bytes)), F.xxhash64("page_id", "url", "payload_digest"))
    info = _headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page:info>"), ("WARC-Date", DATE),
                     ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def packed(raw: bytes) -> bytes:
        if not compress:
            return raw[:-1]
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        return member if member[-1] else member[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for b in batches:
            out = [] if started or not b.num_rows else [packed(info)]
            started |= bool(b.num_rows)
            ids, urls, kinds, digests, refs = (b.column(n).to_pylist() for n in
                                               ("page_id", "url", "record_type", "payload_digest", "refers_to"))
            for i, html in enumerate(b.column("html").cast(pa.binary())):
                out.append(packed(record(ids[i], urls[i], html.as_py(), digests[i], kinds[i], refs[i])))
                if sum(map(len, out[-64:])) > 1 << 22 or len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = dealt.mapInArrow(lean(run), StructType([StructField("value", BinaryType())]))
    # the cast keeps the bytes as they are
    members.select(F.col("value").cast("string").alias("value")).write \
        .option("lineSep", "\x00" if compress else "\n").text(path)


# --- reading --------------------------------------------------------------

def _parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at ``at``; ValueError says what is wrong."""
    if raw[at:at + 6] != b"WARC/1":
        raise ValueError("no version line")
    cut = raw.find(b"\r\n\r\n", at, at + 65536)
    if cut < 0:
        raise ValueError("header without end")
    headers = {}
    for line in raw[at:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("broken header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise ValueError("mandatory header missing")
    size = headers.get("content-length", "")
    if not size.isdecimal():
        raise ValueError("no content length")
    start, end = cut + 4, cut + 4 + int(size)
    if raw[end:end + 4] != b"\r\n\r\n":
        raise ValueError("block length")
    block = bytes(raw[start:end])
    if headers.get("warc-block-digest", _sha(block)) != _sha(block):
        raise ValueError("block digest")
    return headers, block, end + 4


def _member(data: bytes, at: int, whole: bool = True) -> tuple[bytes, int]:
    """The gzip member at ``at`` and its end; only its first bytes unless ``whole``."""
    z = zlib.decompressobj(31)
    out = []
    pos = at
    try:
        while not z.eof and pos < len(data):
            step = 65536 if whole else 256
            out.append(z.decompress(data[pos:pos + step]))
            pos += step
            if not whole and out[-1]:
                break
    except zlib.error as e:
        raise ValueError("member checksum or data") from e
    if whole and not z.eof:
        raise ValueError("member cut short")
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def _payload(headers: dict[str, str], block: bytes) -> bytes | None:
    kind = headers.get("warc-type")
    if kind != "response":
        return None
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4:] if block[:5] == b"HTTP/" and cut >= 0 else block
    if headers.get("warc-payload-digest", _sha(payload)) != _sha(payload):
        raise ValueError("payload digest")
    return payload


def _one(data: bytes, at: int) -> tuple[dict[str, str], bytes | None, int]:
    if data[at:at + 2] == b"\x1f\x8b":
        raw, end = _member(data, at)
        headers, block, used = _parse(raw)
        if used != len(raw):
            raise ValueError("member holds more than a record")
    else:
        headers, block, end = _parse(data, at)
    return headers, _payload(headers, block), end


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def _next_start(data: bytes, at: int) -> int:
    """The next place from ``at`` where a member decodes to a record or a version line stands; else the end."""
    for m in _START.finditer(data, at):
        if m.group()[:1] == b"W":
            if m.start() == 0 or data[m.start() - 1:m.start()] in (b"\n", b"\x00"):
                return m.start()
        else:
            try:
                head, _ = _member(data, m.start(), whole=False)
            except ValueError:
                continue
            if head[:6] == b"WARC/1"[:len(head[:6])] and head:
                return m.start()
    return len(data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | None, bytes | None]]:
    """("record", offset, length, headers, payload) or ("gap", offset, length, {"reason": ...}, None), in order."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        if gap < 0 and data[at] == 0:
            at += 1  # padding between members
            continue
        try:
            headers, payload, end = _one(data, at)
        except ValueError as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if gap >= 0:
            yield "gap", gap, at - gap, {"reason": reason}, None
            gap = -1
        yield "record", at, end - at, headers, payload
        at = end
    if gap >= 0:
        yield "gap", gap, len(data) - gap, {"reason": reason}, None


READ_SCHEMA = StructType([
    StructField("path", StringType()), StructField("entry", StringType()), StructField("at", LongType()),
    StructField("length", LongType()), StructField("reason", StringType()), StructField("record_type", StringType()),
    StructField("page_id", LongType()), StructField("refers_to", LongType()), StructField("url", StringType()),
    StructField("payload_digest", StringType()), StructField("payload_bytes", LongType()),
    StructField("payload", BinaryType())])


def _page(urn: str | None) -> int | None:
    got = re.fullmatch(rf"<{_ID}(-?\d+)>", urn or "")
    return int(got[1]) if got else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records and quarantined gaps (``entry`` is ``record`` or ``gap``) of the archive files in ``path``.

    Of a response, digest and size are those of the payload as read; of a
    revisit, those its header gives for the payload it repeats.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = READ_SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows: list[dict] = []
                size = 0
                for entry, at, length, h, payload in salvage(content.as_py()):
                    row = dict.fromkeys(names) | {"path": name.as_py(), "entry": entry, "at": at, "length": length}
                    if entry == "gap":
                        row["reason"] = h["reason"]
                    else:
                        row |= {"record_type": h.get("warc-type"), "page_id": _page(h.get("warc-record-id")),
                                "refers_to": _page(h.get("warc-refers-to")), "url": h.get("warc-target-uri")}
                        if payload is not None:
                            row |= {"payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload),
                                    "payload": payload if with_payload else None}
                        else:
                            told = h.get("warc-payload-length", "")
                            row |= {"payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                                    "payload_bytes": int(told) if told.isdecimal() else None}
                    rows.append(row)
                    size += length
                    if len(rows) >= 1024 or size > 1 << 23:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"at": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(),
                 "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return files.mapInArrow(lean(run), READ_SCHEMA)


def archive_round_trip(pages: DataFrame, compress: bool = True, **cols) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and read the page records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, compress, **cols)
    read = read_archives(spark, path, with_payload=False)
    return read.where("entry = 'record' and record_type <> 'warcinfo'") \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
