"""WARC archives: writing captures, reading records and assembling transactions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import whole_text

# Payloads from this size on are stored once.
LEAST_SHARED = 100
# Records of one archive file, and bytes of records handed over at once by the reader.
RECORDS_PER_FILE = 12_000
BATCH_BYTES = 8 << 20
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "declared_digest string, http_length long, fields map<string,string>, payload binary, payload_bytes long, payload_digest string"
)


def _urn(*parts: Column) -> Column:
    """A record id that follows from what it names."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record up to its closing line ends; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(EOL)) for name, value in headers]
    head = F.concat(F.lit("WARC/1.1" + EOL), *[F.coalesce(line, F.lit("")) for line in lines])
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL), block)


def captures_of(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Pages with digest and, for a repeated payload, the page that holds it.

    Of equal payloads of at least ``least`` bytes the smallest id is the holder. Only (digest, id)
    pairs are grouped, combined before the shuffle; the pages then meet the repeated digests alone,
    in a join that may be split where one digest has very many pages.
    """
    html = whole_text(html_column)
    read = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    first = F.min(F.struct("page_id", "url"))
    held = read.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(first.alias("holder"), F.count(F.lit(1)).alias("n"))
    repeated = held.where("n > 1").select("digest", "holder")
    return read.join(repeated, "digest", "left").withColumn("revisit", F.col("holder").isNotNull() & (F.col("page_id") > F.col("holder.page_id")))


def write_archives(captures: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", records: int = RECORDS_PER_FILE) -> None:
    """Request, response or revisit, and metadata record of every capture, as gzip-compressed WARC files.

    Spark's writer commits whole files only, so a task that runs again leaves no halves. The line
    ends that close a record are the writer's separator.
    """
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    main = _urn(F.lit("main"), F.col("page_id"), F.col("url"), F.col("digest"))
    asked = _urn(F.lit("request"), F.col("page_id"), F.col("url"), F.col("digest"))
    about = _urn(F.lit("metadata"), F.col("page_id"), F.col("url"), F.col("digest"))
    holder = F.when(F.col("revisit"), _urn(F.lit("main"), F.col("holder.page_id"), F.col("holder.url"), F.col("digest")))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL)
    )
    answer = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", main), ("WARC-Date", date),
            ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", holder),
            ("WARC-Profile", F.when(F.col("revisit"), PROFILE)), ("Content-Type", "application/http;msgtype=response"),
        ],
        F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
    )
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.coalesce(uri, F.lit("/")), r"^[a-z]+://[^/?#]*", "")
    request = _record(
        [
            ("WARC-Type", "request"), ("WARC-Record-ID", asked), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request"),
        ],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)),
    )
    fields = F.concat_ws(
        EOL, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.when(F.col("revisit"), F.concat(F.lit("refers-to-page: "), F.col("holder.page_id").cast("string"))), F.lit("")
    )
    metadata = _record(
        [
            ("WARC-Type", "metadata"), ("WARC-Record-ID", about), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields"),
        ],
        fields,
    )
    lines = captures.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    lines.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of a file of one or many gzip members, or of a plain one, part by part."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            part = view[at : at + (1 << 20)]
            at += len(part)
            yield member.decompress(part)
            at -= len(member.unused_data)


def _parsed(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record, found by their Content-Length; one record in memory at a time."""
    parts, buffer, at = _inflated(data), bytearray(), 0

    def fill(size: int) -> bool:
        """Whether ``size`` bytes lie behind ``at``; what lies before it goes only when more is needed."""
        nonlocal at
        if len(buffer) - at < size:
            del buffer[:at]
            at = 0
        while len(buffer) - at < size:
            part = next(parts, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    def cut(first: int, last: int) -> bytes:
        with memoryview(buffer) as view, view[first:last] as own:
            return bytes(own)

    while True:
        while fill(1) and buffer[at] in b"\r\n":
            at += 1
        if not fill(1):
            return
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", at + max(0, seen - 3))) < 0:
            seen = len(buffer) - at
            if not fill(seen + 1):
                raise ValueError("an archive ends inside a record's headers")
        lines = cut(at, end).decode("utf-8", "replace").split(EOL)
        headers = [(name.strip().lower(), value.strip()) for name, _, value in (line.partition(":") for line in lines[1:])]
        length, head = int(dict(headers)["content-length"]), end + 4 - at
        if not fill(head + length):
            raise ValueError("an archive ends inside a record")
        yield headers, cut(at + head, at + head + length)
        at += head + length


def _row(headers: list[tuple[str, str]], block: bytes) -> dict:
    """A record as a row of ``RECORD``."""
    named = dict(headers)
    row: dict = {
        "record_id": named.get("warc-record-id"), "type": named.get("warc-type"), "target_uri": named.get("warc-target-uri"),
        "date": named.get("warc-date"), "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
        "refers_to": named.get("warc-refers-to"), "declared_digest": named.get("warc-payload-digest"), "http_length": None, "fields": None,
    }
    kind, payload = named.get("content-type", ""), block
    if kind.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                row["http_length"] = int(value)
    elif kind.startswith("application/warc-fields"):
        lines = (line.partition(":") for line in block.decode("utf-8", "replace").split(EOL) if ":" in line)
        row["fields"] = [(name.strip().lower(), value.strip()) for name, _, value in lines]
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files in ``folder``, compressed per file, per record or not at all."""
    schema = pa.schema(
        [
            ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
            ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("http_length", pa.int64()),
            ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for headers, block in _parsed(data.as_py()):
                    row = _row(headers, block)
                    if not keep_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(block) + 1_000
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    Requests and metadata name the capture's main record in a concurrent-to header, or are named by
    it, or name one another; metadata that names a request goes where the request goes. Of several
    requests or metadata records of a capture the one with the smallest id is nested and all are
    counted, so that no capture gathers an unbounded list. Records without a capture are left out;
    ``records`` still has them. A capture without partners has nulls there. Repeated records are
    counted each; an empty table gives no rows.
    """
    main = F.col("type").isin("response", "revisit", "resource", "conversion")
    links = records.select("record_id", "type", F.explode("concurrent_to").alias("other")).where("record_id is not null").distinct()
    own = records.where(main).select(F.col("record_id").alias("main_id")).where("main_id is not null").distinct()
    side = links.where(~main)
    direct = side.join(own, side["other"] == own["main_id"]).select(F.col("record_id").alias("id"), "main_id")
    named = links.where(main).select(F.col("other").alias("id"), F.col("record_id").alias("main_id"))
    placed = direct.unionByName(named).distinct()
    # Metadata of a request, or the other way round: one more step.
    loose = side.join(placed, side["record_id"] == placed["id"], "left_anti")
    further = loose.join(placed, loose["other"] == placed["id"]).select(loose["record_id"].alias("id"), "main_id")
    placed = placed.unionByName(further).distinct()
    partners = records.where(F.col("type").isin("request", "metadata")).join(placed, F.col("record_id") == F.col("id"))
    nested = F.struct("record_id", "target_uri", "date", F.to_json("fields").alias("fields"), "payload")

    def least(kind: str) -> list[Column]:
        mine = F.col("type") == kind
        return [F.min(F.when(mine, nested)).alias(kind), F.count(F.when(mine, 1)).alias(f"n_{kind}")]

    sides = partners.groupBy("main_id").agg(*least("request"), *least("metadata"))
    response = F.struct("record_id", "target_uri", "date", "refers_to", "declared_digest", "http_length", "payload", "payload_bytes", "payload_digest")
    mains = records.where(main).select(F.col("record_id").alias("main_id"), "type", response.alias("response"))
    return mains.join(sides, "main_id", "left").select(
        F.col("main_id").alias("capture_id"), F.col("type").alias("record_type"), "response", "request", "metadata",
        F.coalesce("n_request", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def page_summary(captures: DataFrame) -> DataFrame:
    """Per capture: page, size and digest of the full payload, type, and the page a revisit refers to."""
    field = lambda name: F.get_json_object("metadata.fields", f"$['{name}']").cast("long")
    revisit = F.col("record_type") == "revisit"
    return captures.select(
        field("page-id").alias("page_id"),
        F.when(revisit, F.col("response.http_length")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("response.declared_digest", "^sha256:", "")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        "record_type", F.when(revisit, field("refers-to-page")).alias("refers_to"),
    )
