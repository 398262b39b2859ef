"""WARC archives of fetched feed pages, with copies written as revisits.

Spark's text writer puts the records together: a record is its header, an empty
line and the payload, and the writer's line separator is the two line ends that
close a record. The archives are read by their Content-Length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, shares

VERSION, END = "WARC/1.1", "\r\n"
LEAST = 100  # bytes of payload from which a copy is a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_ROWS = 2_000  # records of an archive file
DATE = "2026-01-01T00:00:00Z"  # of records whose time of capture the pages do not hold
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes) of every page, without its payload."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page with a smaller page_id has.

    The digest tells pages of one page_id apart.

    Only digests are shuffled. A digest that many pages share is one row for each
    task before the shuffle; the join back is between small rows.
    """
    heads = headers(pages).where((F.col("bytes") >= LEAST) & F.col("page_id").isNotNull())
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return heads.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def uuid(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), page_id.cast("string")).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(pages: DataFrame, files: int) -> DataFrame:
    """(record string): a WARC record for every page, fresh headers included, without its closing line ends.

    The pages are dealt to the files once, by page_id and digest, and the revisits come to them there.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    at = own.repartition(files, "page_id", "digest").join(revisits(pages).repartition(files, "page_id", "digest").hint("shuffle_hash"), ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", ""), F.lit(""))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))  # noqa: E731  a null value: no such line
    parts = [
        F.lit(VERSION + END), field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.coalesce(uuid(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))), field("WARC-Date", F.lit(DATE)), field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), field("WARC-Feed-Page", F.col("page_id").cast("string")),
        field("WARC-Refers-To", uuid(F.col("refers_to"))), field("WARC-Refers-To-Feed-Page", F.col("refers_to").cast("string")), field("WARC-Profile", F.when(again, PROFILE)),
        field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", F.when(again, 0).otherwise(F.octet_length("html")).cast("string")), F.lit(END)]
    return at.select(F.concat(*parts, F.when(again, F.lit("")).otherwise(F.col("html"))).alias("record"))


def write(pages: DataFrame, folder: str) -> None:
    """Writes every page as a record of gzipped archives in `folder`, which must be new.

    pages: page_id (long), url, html; other columns are left out. Of equal
    payloads of at least 100 bytes the one with the smallest page_id is the
    response and the others are revisits without payload; shorter ones and pages
    without an id are responses. Null html is an empty payload. A page that
    stands in the table twice is two records alike; unlike pages with one page_id
    are judged each by its own payload. An empty table writes archives without
    records. Files hold a few thousand records each.
    """
    records(pages, shares(pages, FILE_ROWS)).write.option("lineSep", END * 2).option("compression", "gzip").text(folder)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive: header fields, and the payload by its Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(END)
        if lines[0] != VERSION:
            raise ValueError(f"not a record at byte {at}: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, url, payload) of the archives' own records.

    A revisit has no payload here; payload_digest is computed from a response's
    payload and taken from a revisit's header.
    """
    import zlib

    schema = RECORD

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x is not None else None
        for packed in batch.column("content"):
            rows, size = [], 0
            for f, body in parsed(zlib.decompress(packed.as_py(), 31)):
                again = f["WARC-Type"] == "revisit"
                digest = f["WARC-Payload-Digest"].removeprefix("sha256:") if again else hashlib.sha256(body).hexdigest()
                rows.append((number(f.get("WARC-Feed-Page")), f["WARC-Type"], number(f.get("WARC-Refers-To-Feed-Page")), None if again else len(body), digest, f["WARC-Target-URI"], None if again else body))
                size += len(body)
                if size > 4_000_000:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "payload")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return per_batch(files, run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Records with payload_bytes of revisits taken from the responses that they refer to. The payload column is left out."""
    heads = found.drop("payload")
    first = heads.where("record_type = 'response' and payload_bytes >= 100").groupBy(F.col("page_id").alias("origin"), F.col("payload_digest").alias("origin_digest")).agg(F.min("payload_bytes").alias("origin_bytes"))
    again = heads.where("record_type = 'revisit'").join(first, (F.col("refers_to") == F.col("origin")) & (F.col("payload_digest") == F.col("origin_digest")), "left").drop("origin", "origin_digest")
    plain = heads.where("record_type <> 'revisit'").withColumn("origin_bytes", F.lit(None).cast("long"))
    return plain.unionByName(again).withColumn("payload_bytes", F.coalesce("payload_bytes", "origin_bytes")).drop("origin_bytes")
