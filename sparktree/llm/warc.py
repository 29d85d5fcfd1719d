"""WARC archives with resolved revisits.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the
largest id is written as a response and the others as revisits that refer to it; all
shorter payloads are responses. Headers alone (id, digest, length) settle that: one
partial aggregation finds the response of each digest, and headers join it by digest.
Both sides of that join are plain shuffles, so Spark splits a digest that a third of
all pages share. If there are at most ``BROADCAST_ROWS`` shared digests, they are sent
to the payloads, which move once, to their archives; beyond, payloads are shuffled by
digest before that. Only then are records made, with fresh headers, and written by
Spark's text writer, whose separator is the end of a record: task commits make the
write safe when executors are lost.

Archives are read back whole, one a task at a time; they are cut at about
``ARCHIVE_BYTES`` (one record may be longer), which bounds a reader's memory. Records
are cut by Content-Length, never by a separator in a payload. A revisit's payload
length comes from the response that it refers to, by a join on the response's record
id.

Defined results: a null payload is empty; pages with equal ids each get a record, and
where they also share the payload of a response, each is a response; a page without id
is a revisit if any page with its payload has an id, else a response.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: Bytes of a record's headers, about.
HEAD_BYTES = 600
#: Digests that are broadcast at most (40 characters and an id each).
BROADCAST_ROWS = 500_000
DATE = "2025-01-01T00:00:00Z"
END = "\r\n\r\n"
NAMES = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "Content-Type", "Content-Length")}


def payloads(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url, payload, digest, bytes of every row."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})


def responses(headers: DataFrame) -> DataFrame:
    """(digest, refers_to) of each digest of at least REVISIT_BYTES with more than one page."""
    return headers.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("shared"), "refers_to")


def record_id(page_id: str, digest: str):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(":"), F.col(digest), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """value: each row of (page_id, url, payload, digest, bytes, refers_to, revisit) as a
    record without its end."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    refers = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id("refers_to", "digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        record_id("page_id", "digest"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.regexp_replace("url", "[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(F.col("revisit"), refers).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), http.cast("binary"), body).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record for each page as gzip archives under ``path``, copies as revisits."""
    rows = payloads(pages, id_col, url_col, payload_col)
    headers = materialize(rows.select("page_id", "digest", "bytes"), "headers")
    total = headers.agg(F.sum(F.col("bytes") + HEAD_BYTES)).first()[0] or 0
    target = materialize(responses(headers), "responses")
    if target.count() <= BROADCAST_ROWS:
        target = F.broadcast(target)
    known = rows.join(target, rows.digest == target.shared, "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    made = records(known.withColumn("revisit", revisit))
    made.repartition(int(total // ARCHIVE_BYTES) + 1).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; ValueError if it is cut short or
    does not say where a block ends. Header names are as written but for a record's own
    ones, which are spelt as WARC does; lines without a colon continue the one before."""
    at = 0
    while at < len(archive):
        stop = archive.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError("the archive ends within a record's headers")
        _, *lines = archive[at:stop].decode("utf-8", "replace").split("\r\n")
        head: dict[str, str] = {}
        name = None
        for line in lines:
            if ":" in line and line[:1] not in " \t":
                name, value = line.split(":", 1)
                name = NAMES.get(name.strip().lower(), name.strip())
                head[name] = value.strip()
            elif name:
                head[name] += " " + line.strip()
        if not head.get("Content-Length", "").isdigit():
            raise ValueError(f"record {head.get('WARC-Record-ID')} has no Content-Length")
        at = stop + 4 + int(head["Content-Length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('WARC-Record-ID')} does not end where its Content-Length says")
        yield head, archive[stop + 4 : at]
        at += 4


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of a block; the whole block if it has none."""
    if not head.get("Content-Type", "").startswith("application/http"):
        return block
    _, end, payload = block.partition(b"\r\n\r\n")
    return payload if end else b""


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """record_id, type, uri, stated_digest, refers_to, payload_bytes, payload_digest and,
    if asked for, payload of every record, whoever wrote it (a header that is not there is null); length and digest are those of the payload
    that the record itself holds."""
    names = ["record_id", "type", "uri", "stated_digest", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                cols: list[list] = [[] for _ in names]
                for head, block in parse(gzip.decompress(content.as_py())):
                    payload = payload_of(head, block)
                    stated = head.get("WARC-Payload-Digest")
                    row = (head.get("WARC-Record-ID"), head.get("WARC-Type"), head.get("WARC-Target-URI"), stated and stated.removeprefix("sha1:"), head.get("WARC-Refers-To"), len(payload), hashlib.sha1(payload).hexdigest(), payload)
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    ddl = "record_id string, type string, uri string, stated_digest string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, ddl)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """record_id, type, refers_to and the full payload's length and digest of every
    record; those of a revisit come from the response that it refers to."""
    found = materialize(read_archives(spark, path, with_payload=False), "records")
    asked = found.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    full = materialize(found.where("type = 'response'").join(asked, "record_id", "left_semi").groupBy(F.col("record_id").alias("origin")).agg(F.first("payload_bytes").alias("full_bytes"), F.first("payload_digest").alias("full_digest")), "originals")
    both = found.join(full, found.refers_to == full.origin, "left")
    held = F.col("type") == "response"
    return both.select("record_id", "type", "refers_to", F.when(held, F.col("payload_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"), F.when(held, F.col("payload_digest")).otherwise(F.col("full_digest")).alias("payload_digest"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?\\d*):", 1), F.lit("")).cast("long")
    return resolved(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p
), m AS (
  SELECT d, max(page_id) AS top, count(*) AS c FROM h WHERE n >= 1000 GROUP BY d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h.d AS payload_digest,
  CASE WHEN m.top IS NULL OR m.top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.top = page_id THEN NULL ELSE m.top END AS refers_to
FROM h LEFT JOIN m ON h.d = m.d
"""
