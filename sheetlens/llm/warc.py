"""WARC archives: write captures as request, response or revisit, and metadata records; read them back and assemble each
capture through the records' concurrent-to identifiers.

Archives are WARC 1.1 in gzip, several files per run, each with a bounded number of bytes. Writing is a plain text sink
whose line separator is the blank line that ends a record. Reading is framed by Content-Length alone, so a payload may
hold anything, other records included.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.llm.common import gives_back, materialize
from sheetlens.llm.graph import components

MIN_REVISIT_BYTES = 1000
#: Bytes of one archive file before it's compressed, at most, unless a single capture is larger.
FILE_BYTES = 64 << 20
#: Captures are written apart by size, so that the number of records bounds a file's bytes: up to each of these, and above.
SIZE_CLASSES = (16 << 10, 256 << 10, 4 << 20)
#: What a capture's three records have besides payload and url, at most.
_HEAD_BYTES = 2000
#: Payload bytes that a reader hands on at once.
PART_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

_RECORD = (
    "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "payload_digest string, http_length long, payload_bytes long, payload_sha1 string, block string, payload binary"
)


def _uuid(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), row.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """A record without the blank line that ends it; a header whose value is null is left out."""
    parts: list[Column] = [F.lit("WARC/1.1\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind), F.lit(CRLF)]
    for name, value in headers:
        col = value if isinstance(value, Column) else F.lit(value)
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), col, F.lit(CRLF)), F.lit("")))
    return F.concat(*parts, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = MIN_REVISIT_BYTES
) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``.

    Of payloads that are equal and have at least ``min_revisit_bytes``, the one with the largest page_id (of repeated rows
    the one last read) becomes the response, the others revisit it. Smaller payloads are always responses. A null html is
    an empty payload, a null url leaves the header out, line breaks in a url are percent-encoded. Rows get a number that is
    written with them before anything depends on it, so repeated and null page_ids give a capture each. More columns are
    ignored; an empty table gives archives without records.
    """
    text = F.coalesce("html", F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", text.alias("html"))
    rows = materialize(rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html")))
    groups = (
        rows.where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "row")).alias("keep"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.col("keep.row").alias("keep_row"))
    )
    groups = materialize(groups)
    marked = rows.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("keep_row") != F.col("row"), F.lit(False))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    rid, digest = _uuid("response", F.col("row")), F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    request = _record(
        "request",
        [
            ("WARC-Record-ID", _uuid("request", F.col("row"))),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", rid),
            ("Content-Type", "application/http; msgtype=request"),
        ],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("*")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", rid),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, _uuid("response", F.col("keep_row")))),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
    )
    metadata = _record(
        "metadata",
        [
            ("WARC-Record-ID", _uuid("metadata", F.col("row"))),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", rid),
            ("Content-Type", "application/warc-fields"),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    records = F.explode(F.array(request, response, metadata)).alias("value")
    whole = F.col("size") + 6 * F.coalesce(F.octet_length(uri), F.lit(0)) + _HEAD_BYTES
    kind = sum((F.when(whole > c, 1).otherwise(0) for c in SIZE_CLASSES), F.lit(0))
    there = {r["kind"] for r in rows.select(kind.alias("kind")).distinct().collect()}  # a row for each class
    for k in sorted(there | {0}):
        most = max(1, FILE_BYTES // SIZE_CLASSES[k]) if k < len(SIZE_CLASSES) else 1
        some = marked.where(kind == k).select(records)
        some = some.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip")
        some.option("maxRecordsPerFile", 3 * most).text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """Headers, identifiers named as concurrent (a header that may be repeated) and block of each record of one archive
    file, plain or gzip, read bit by bit."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    with source as f:
        while True:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record starts at {line[:40]!r}")
            headers: dict[str, str] = {}
            named: list[str] = []
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
                if name.strip().lower() == "warc-concurrent-to":
                    named.append(value.strip())
            size = int(headers["content-length"])
            block = f.read(size)
            if len(block) != size:
                raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
            yield headers, named, block


def _row(h: dict[str, str], named: list[str], block: bytes, payloads: bool) -> tuple:
    payload = length = None
    text = block
    if "msgtype=response" in h.get("content-type", ""):
        text, _, payload = block.partition(b"\r\n\r\n")
        for line in text.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                length = int(line[15:])
        if h["warc-type"] == "revisit":
            payload = None
    return (
        h["warc-type"],
        h["warc-record-id"],
        named,
        h.get("warc-refers-to"),
        h.get("warc-target-uri"),
        h.get("warc-date"),
        h.get("warc-payload-digest"),
        length,
        None if payload is None else len(payload),
        None if payload is None else hashlib.sha1(payload).hexdigest(),
        text.decode("utf-8", "replace"),
        payload if payloads else None,
    )


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; without ``payloads`` the bytes stay behind in the reader.

    Files are read whole, one at a time; records inside are read in turn and handed on in bounded parts. Null where a
    header is missing, concurrent_to has all identifiers that a record names; a file that breaks off inside a record is an
    error.
    """
    names = [x.split()[0] for x in _RECORD.split(", ")]

    @gives_back
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                rows: list[tuple] = []
                size = 0
                for h, named, block in _records(data):
                    rows.append(_row(h, named, block, payloads))
                    size += len(block) + 500
                    if size > PART_BYTES:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, _RECORD)


def _groups(ids: DataFrame) -> DataFrame | None:
    """Which records belong together where names lead further than one step: key (hash of a record_id), group. None if every
    record names one other at most, and none that names another itself."""
    own = ids.where(F.col("record_id").isNotNull())
    links = own.select("record_id", F.explode("concurrent_to").alias("to")).where("to is not null and to <> record_id").distinct()
    links = materialize(links)
    chained = links.join(links.select(F.col("record_id").alias("to")), "to", "left_semi")
    several = links.groupBy("record_id").count().where("count > 1")
    if chained.isEmpty() and several.isEmpty():
        return None
    found = components(links.select(F.xxhash64("record_id").alias("a"), F.xxhash64("to").alias("b")))
    return found.withColumnsRenamed({"node": "key", "component": "group"})


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id (the response's record_id), response, request, metadata.

    Records belong together that name one another as concurrent, directly or through others, whichever of them does the
    naming. A capture may lack a request or metadata (null struct); records whose response is missing give no row. Of
    several requests of a capture the one with the greatest record_id stays, as a whole; the same goes for metadata and for
    responses that share their identifier. Different responses that belong together give a row each, with the same request
    and metadata. Records without an identifier are left out; more columns are ignored; an empty table gives an empty
    result. ``records`` is read twice: identifiers first.
    """
    own = ["record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "http_length"]
    own += ["payload_bytes", "payload_sha1", "payload"]
    is_response = F.col("type").isin("response", "revisit")
    sound = records.where(F.col("record_id").isNotNull()).select(*[c.split()[0] for c in _RECORD.split(", ")])
    ids = materialize(sound.select("record_id", "concurrent_to", is_response.alias("response")))
    groups = _groups(ids)
    named = F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id"))

    def grouped(df: DataFrame) -> DataFrame:
        if groups is None:
            return df.withColumn("group", F.xxhash64(named))
        found = df.withColumn("key", F.xxhash64("record_id")).join(groups, "key", "left")
        return found.withColumn("group", F.coalesce("group", "key")).drop("key")

    rows = grouped(sound)
    kinds = {n: (F.col("type") == n, ["record_id", "block"]) for n in ("request", "metadata")}
    parts = [F.max(F.when(is_it, F.struct(*names))).alias(n) for n, (is_it, names) in kinds.items()]
    one = F.max(F.when(is_response, F.struct(*own))).alias("response")
    crowded = grouped(ids).where("response").groupBy("group").agg(F.countDistinct("record_id").alias("n")).where("n > 1")
    if crowded.isEmpty():
        met = rows.groupBy("group").agg(one, *parts).where("response is not null")
    else:
        others = rows.where(~is_response).groupBy("group").agg(*parts)
        met = rows.where(is_response).groupBy("group", "record_id").agg(one).join(others, "group", "left")
    return met.select(F.col("response.record_id").alias("capture_id"), "response", "request", "metadata")


def page_digests(caps: DataFrame) -> DataFrame:
    """Per capture: page_id, url, payload_bytes, payload_digest, record_type, refers_to (the page_id that it revisits).

    A capture without metadata has a null page_id; one whose response isn't there refers to null. An empty table gives an
    empty result.
    """
    page_id = F.nullif(F.trim(F.regexp_extract("metadata.block", r"page-id: ?([^\r]*)", 1)), F.lit("")).cast("long")
    flat = materialize(
        caps.select(
            F.col("response.record_id").alias("record_id"),
            F.col("response.refers_to").alias("refers_id"),
            page_id.alias("page_id"),
            F.col("response.target_uri").alias("url"),
            F.coalesce("response.payload_bytes", "response.http_length").alias("payload_bytes"),
            F.coalesce(
                "response.payload_sha1", F.regexp_replace("response.payload_digest", "^sha1:", "")
            ).alias("payload_digest"),
            F.col("response.type").alias("record_type"),
        )
    )
    # Only revisits look for their response: most captures have nothing to refer to and stay where they are.
    target = flat.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type"]
    again = flat.where("refers_id is not null").join(target, "refers_id", "left").select(*names, "refers_to")
    return flat.where("refers_id is null").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(again)
