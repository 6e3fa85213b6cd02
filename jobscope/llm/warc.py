"""WARC: write captures as archives, read them back, and assemble each capture's records through their concurrent-to identifiers."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import maybe_broadcast, slices, staged
from jobscope.sources.scratch import scratch_path

#: Payloads under so many bytes are never written as revisits.
LEAST = 100
END = "\r\n\r\n"
#: Fixed value: a gzip member without content, whose comment is this. It stands between the members of records, so that archives
#: are plain files of gzip members, and yet Spark's text reader can cut them between records. It can't be part of UTF-8 text.
BETWEEN = b"\x1f\x8b\x08\x10\x00\x00\x00\x00\x00\xff" + b"next record\x00" + b"\x03\x00" + bytes(8)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri() -> Column:
    """The url without blanks and control characters, which would end the header line."""
    return F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")


def _record(kind: Column, identifier: Column, headers: Column, block: Column) -> Column:
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), identifier, headers)
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _urn(kind: str) -> Column:
    x = F.md5(F.concat(F.lit(kind), F.col("row").cast("string"), F.lit(":"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest")).cast("binary"))
    cut = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member."""
    for batch in batches:
        for part in slices(pc.binary_length(batch["record"]).to_pylist()):
            out = []
            for x in batch["record"].slice(part.start, part.stop - part.start):
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(c.compress(x.as_buffer()) + c.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _text(reader_or_writer):
    return reader_or_writer.option("lineSep", BETWEEN.decode("iso-8859-1")).option("encoding", "iso-8859-1")


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of pages, as files of WARC records, each a gzip member of its own.

    Of rows whose payloads are equal and of at least LEAST bytes those with the smallest page_id (null last) are responses
    and the others revisits; all smaller payloads are responses. A null html is an empty payload, a null url an empty target.
    Only payloads that repeat are looked up while writing, so the html isn't shuffled unless very many do.
    """
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", _uri().alias("uri"))
    seen = p.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = staged(seen.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.uri").alias("first_uri"), F.lit(True).alias("repeated")), "payloads")
    p = p.join(maybe_broadcast(seen), "digest", "left").withColumn("row", F.monotonically_increasing_id())
    revisit = F.coalesce("repeated", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    own, about = _urn("capture"), F.concat(F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), _uri())
    beside = F.concat(about, F.lit("\r\nWARC-Concurrent-To: "), own)
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nContent-Type: application/http;msgtype=response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    refers = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To-Date: {date}\r\nWARC-Refers-To-Target-URI: "), F.col("first_uri"))
    capture = F.when(revisit, _record(F.lit("revisit"), own, F.concat(about, digest, refers), http))
    capture = capture.otherwise(_record(F.lit("response"), own, F.concat(about, digest), F.concat(http, F.col("html"))))
    get = F.concat(F.lit("GET "), _uri(), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    request = _record(F.lit("request"), _urn("request"), F.concat(beside, F.lit("\r\nContent-Type: application/http;msgtype=request")), get)
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), _urn("metadata"), F.concat(beside, F.lit("\r\nContent-Type: application/warc-fields")), fields)
    records = p.select(F.explode(F.array(request, capture, metadata)).alias("record"))
    packed = records.select(F.concat("record", F.lit(END)).cast("binary").alias("record")).mapInArrow(_pack, "record binary")
    _text(packed.select(F.col("record").cast("string")).write).text(path)


RECORDS = "record_id string, type string, concurrent_to string, target_uri string, stored_digest string, page_id long, payload_bytes long, payload_digest string, payload binary"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode().strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives under path; payload only if asked for, its size and digest always.

    Archives are cut between records while reading, so they may be of any size; a record has to fit into memory. A response's
    payload is what follows the HTTP header. page_id comes from the fields of metadata records.
    """
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORDS.split(", ")])

    def row(h: dict[str, str], block: bytes) -> dict:
        out = {"record_id": h["warc-record-id"], "type": h["warc-type"], "concurrent_to": h.get("warc-concurrent-to"), "target_uri": h.get("warc-target-uri")}
        out["stored_digest"] = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if h["warc-type"] == "response":
            body = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
            out |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "payload": bytes(body) if payloads else None}
        elif h["warc-type"] == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
            out["page_id"] = int(fields["page_id"]) if fields.get("page_id") else None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for packed in batch["packed"]:
                for h, block in parse(io.BytesIO(zlib.decompress(packed.as_buffer(), 31))):
                    rows.append(row(h, block))
                    size += len(block) if payloads else 0
                if len(rows) >= 10_000 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = _text(spark.read).text(path)
    return files.select(F.col("value").cast("binary").alias("packed")).mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, request, response (or revisit, with what it refers to) and metadata.

    Request and metadata are joined to the record that they are concurrent to. A revisit is joined to the responses of its
    payload digest, aggregated to one row before, so copies of a response don't multiply it. Where payloads repeat very
    often, Spark may split the revisits' side of that join; the other side has one row for each digest.
    """
    captured = records.where(F.col("type").isin("response", "revisit"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "target_uri").alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), "page_id", F.struct(F.col("record_id").alias("id"), "page_id").alias("metadata"))
    captures = captured.drop("page_id", "concurrent_to").join(request, "record_id", "left").join(metadata, "record_id", "left")
    responses = captures.where("type = 'response'").groupBy("payload_digest")
    responses = responses.agg(F.min("page_id").alias("first_id"), F.max("payload_bytes").alias("first_bytes")).withColumnRenamed("payload_digest", "first_digest")
    revisits = captures.where("type = 'revisit'").join(responses, F.col("stored_digest") == F.col("first_digest"), "left")
    revisits = revisits.withColumn("payload_bytes", F.col("first_bytes")).withColumn("payload_digest", F.col("first_digest")).withColumnRenamed("first_id", "refers_to").drop("first_bytes", "first_digest")
    out = captures.where("type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
    response = F.struct(F.col("record_id").alias("id"), "type", "payload_bytes", "payload_digest", "refers_to", "payload", (F.col("payload_digest") == F.col("stored_digest")).alias("verified"))
    return out.select("page_id", "target_uri", "request", response.alias("response"), "metadata")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = staged(read_records(spark, path, payloads=False), "warc-records")
    got = assemble(records)
    return got.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "response.refers_to")


OP6_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) b, sha256(coalesce(html, '')) d from pages),
f as (select *, first_value(page_id) over (partition by d order by page_id nulls last) f from p)
select page_id, b payload_bytes, d payload_digest,
  case when b >= 100 and page_id is distinct from f then 'revisit' else 'response' end record_type,
  case when b >= 100 and page_id is distinct from f then f end refers_to
from f
"""
