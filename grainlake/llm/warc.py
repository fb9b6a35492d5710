"""WARC archives: writing without repeated payloads, reading, and resolving revisits.

Only headers are shuffled by payload digest.  Of equal payloads the record with
the smallest id stays a response; the others become revisit records that refer
to it and carry fresh headers but no payload.  The list of revisits meets the
records by their ids: where it is too large to be broadcast, records are dealt
by id, so a payload that very many records share is spread like any other.  Archives are written by Spark's
own text writer, whose record separator is that of the WARC format, so they go
to any store that Spark writes, under its commit protocol.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

END = "\r\n\r\n"
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 100
RECORDS_PER_FILE = 1000
SALTS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(digest, first)``: for each payload that occurs twice or more, the smallest id that has it.

    ``headers`` has ``id``, ``digest`` and ``payload_bytes``; rows with a null
    id are never the first one.  Partial minima are taken before the shuffle,
    so a payload that a third of all records share is no burden to one task.
    """
    of = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("digest")
    return of.agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")


def revisits(headers: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(id, key, first, salt)``: the records that ``firsts`` makes revisits, once each; ``key`` is the digest's bytes.

    A null id is listed once for each of ``SALTS``, among which ``salt_of``
    spreads the records without an id.
    """
    again = headers.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first")))
    again = again.select("id", F.unhex("digest").alias("key"), "first").distinct()
    salts = F.when(F.col("id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return again.withColumn("salt", F.explode(salts))


def salt_of(record_id: Column, url: Column) -> Column:
    """Spreads records without an id by their urls; 0 for all others."""
    return F.when(record_id.isNull(), F.pmod(F.xxhash64(url), F.lit(SALTS))).otherwise(0).cast("int")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks in values are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    least_bytes: int = LEAST_BYTES,
) -> None:
    """Write a record per row under ``path``: gzipped archives without repeated payloads.

    A null payload is empty, a null url or id leaves its value out.  Rows that
    repeat an id and payload are all responses if they are the first of it.
    An empty table writes no record.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    headers = materialise(rows.select("id", "digest", "payload_bytes"), "warc-headers")
    again = materialise(revisits(headers, resolve(headers, least_bytes)), "warc-revisits")
    again = again.withColumnRenamed("id", "of")
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("salt") == salt_of(F.col("id"), F.col("url"))) & (F.unhex("digest") == F.col("key"))
    rows = rows.join(again, same, "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <" + URN),
        F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To", F.concat(F.lit("<" + URN), F.col("first").cast("string"), F.lit(">"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit(END),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))
    writer = rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        body = data.index(b"\r\n\r\n", at) + 4
        head = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data[data.index(b"\r\n", at) : body])}
        end = body + int(head["content-length"])
        yield head, data[body:end]
        at = end


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``.

    ``(record_id, record_type, url, refers_to, payload_bytes, payload_digest,
    payload)``; for a revisit, size and digest are those of the full payload
    and the payload is null.  For a response both are taken from the bytes.
    """
    names = ["record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind, bare = head["warc-type"], lambda x: x.strip("<>") if x else None
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
            digest, payload = head["warc-payload-digest"].rpartition(":")[2], None
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        return bare(head["warc-record-id"]), kind, head.get("warc-target-uri"), bare(head.get("warc-refers-to")), size, digest, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows = [row(*r) for r in records(content.as_py())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def restore(archive: DataFrame) -> DataFrame:
    """Each revisit record of ``read_warc`` with the payload of the response it refers to.

    A revisit whose response is missing keeps a null payload.
    """
    originals = archive.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("payload").alias("original"))
    joined = archive.join(originals, "refers_to", "left")
    return joined.withColumn("payload", F.coalesce("payload", "original")).drop("original").select(*archive.columns)


def page_id(urn: Column) -> Column:
    """The id that a record's URN holds; null where it has none."""
    return F.replace(urn, F.lit(URN), F.lit("")).try_cast("long")
