"""WARC archives: writing, reading, and transaction assembly.

Every page gives three records: the request, its response (or a revisit of an equal payload's response) and metadata; the first
and last name the second in WARC-Concurrent-To. Archives are gzip files of whole records, written and read by Spark's own
sources, so any store that Spark reaches will do; the end of a record (two line ends) is the writer's row separator, so a file
holds the records and nothing else. assemble() brings the records of a transaction together by those identifiers and gives one
nested row per capture.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Payloads of at least so many bytes are stored once.
LEAST = 1000
RECORDS_PER_FILE = 12_000
END = "\r\n"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, digest string, http_length bigint, payload binary"


def revisits(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest (SHA-1, hex) and refers_to: the page that a revisit stands for.

    Of equal payloads of at least `least` bytes the largest page_id is the response, the others revisit it. Only digests that two
    pages share are joined. Those of a thousandth of the pages or more, of which there are at most 1,000, are broadcast, so
    that no task gets all pages of one payload.
    """
    html = F.coalesce("html", F.lit(""))
    size, digest = F.octet_length(html).cast("long"), F.sha1(html.cast("binary"))
    light = pages.select(size.alias("b"), digest.alias("r_digest"), "page_id").filter(F.col("b") >= least)
    shared = scratch.table(light.groupBy("r_digest").agg(F.max("page_id").alias("r_page"), F.count("*").alias("r_n")).filter("r_n > 1"), "shared")
    floor = max(100, pages.count() // 1000)
    frequent = F.broadcast(shared.filter(F.col("r_n") >= floor).select("r_digest", "r_page"))
    rare = shared.filter(F.col("r_n") < floor).select(F.col("r_digest").alias("s_digest"), F.col("r_page").alias("s_page"))
    own = pages.select("page_id", "url", html.alias("html"), size.alias("payload_bytes"), digest.alias("payload_digest"))
    found = own.join(frequent, F.col("payload_digest") == F.col("r_digest"), "left").join(rare, F.when(F.col("r_page").isNull(), F.col("payload_digest")) == F.col("s_digest"), "left")
    to = F.coalesce("r_page", "s_page")
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when((F.col("payload_bytes") >= least) & (to != F.col("page_id")), to).alias("refers_to"))


def _urn(page: Column, digest: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(f":{kind}>"))


def _record(kind: Column, fields: dict[str, Column], block: Column) -> Column:
    """A record without its end. Fields that are null are left out."""
    lines = [F.concat(F.lit("WARC-Type: "), kind), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines), F.lit(END + END), block)


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of pages as revisits() gives them, under path: request, response or revisit, and metadata of each."""
    page, digest = F.col("page_id"), F.col("payload_digest")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")
    main = _urn(page, digest, "main")
    again = F.col("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": url}
    request = _record(F.lit("request"), {"WARC-Record-ID": _urn(page, digest, "request"), **common, "WARC-Concurrent-To": main, "Content-Type": F.lit("application/http;msgtype=request")}, F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{END}{END}")))
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        {
            "WARC-Record-ID": main,
            **common,
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), digest),
            "WARC-Refers-To": F.when(again, _urn(F.col("refers_to"), digest, "main")),
            "WARC-Profile": F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "Content-Type": F.lit("application/http;msgtype=response"),
        },
        F.concat(head, F.when(again, "").otherwise(F.col("html"))),
    )
    metadata = _record(F.lit("metadata"), {"WARC-Record-ID": _urn(page, digest, "metadata"), **common, "WARC-Concurrent-To": main, "Content-Type": F.lit("application/warc-fields")}, F.concat(F.lit("page_id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(END)))
    rows = pages.select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.mode("overwrite").option("compression", "gzip").option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).text(path)


def records(content: bytes) -> Iterator[dict]:
    """The records of an archive, compressed (by file or by record) or not."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        http, payload = {}, block
        if fields.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:])}
        yield {
            "record_id": fields.get("warc-record-id"),
            "type": fields.get("warc-type"),
            "concurrent_to": fields.get("warc-concurrent-to"),
            "refers_to": fields.get("warc-refers-to"),
            "target_uri": fields.get("warc-target-uri"),
            "digest": fields.get("warc-payload-digest"),
            "http_length": int(http["content-length"]) if http.get("content-length", "").isdigit() else None,
            "payload": payload,
        }


KINDS = pa.schema([*((c, pa.string()) for c in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "digest")), ("http_length", pa.int64()), ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for row in records(content.as_py()):
                rows.append(row)
                size += len(row["payload"])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, KINDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, KINDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: RECORD. payload is the HTTP body, or the block of a record that isn't HTTP."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_read, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture_id, copies, and the structs request, response and metadata of the records' other columns.

    A record without WARC-Concurrent-To is a capture's main record, response or revisit; requests and metadata belong to the record
    they name. What is missing from a transaction is null. Records repeated as a whole are one; copies counts the main records.
    """
    rest = F.struct(*(c for c in found.columns if c != "concurrent_to"))
    part = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), rest), ignorenulls=True)
    return found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.sum(F.col("type").isin("response", "revisit").cast("int")).alias("copies"), part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata")
    )


def page_of(urn: Column) -> Column:
    """The page_id in an identifier that write() made."""
    return F.regexp_extract(urn, "^<urn:capture:(-?[0-9]*):", 1).try_cast("bigint")
