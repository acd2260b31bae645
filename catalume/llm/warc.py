"""WARC archives as chunked record tables.

Writing: one record a page; a payload that stands elsewhere already becomes a revisit without a body, an oversized one a
record and continuation records (WARC segments) of at most ``chunk_bytes``. Spark's text writer puts the records into
the archives, Spark's text reader finds them again by the bytes that begin a record, so neither needs a file system that
Python can open. Reading gives a chunk table, rows of record and chunk number; the digest of a payload in several chunks
is carried from chunk to chunk, so that no task holds a whole oversized payload. (A page to be archived is one row of its
table, so that the writing task reads it whole; its chunks are cut from it once.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, until_exit

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: The line that begins each record. No part of it but the whole both begins and ends it, so that a reader that looks for it byte by byte cannot miss one.
BEGIN = VERSION + CRLF
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never revisits.
LEAST = 1000
CHUNK = 1 << 16


#: Parts in which the pages of one payload are told their response.
SALTS = 16


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (null for a revisit), payload_bytes, payload_digest, refers_to (null: a response) for each page.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the response; rows that repeat that
    page_id are responses too. A null page_id refers to the largest other one. A null html is an empty payload. Payloads are
    equal if length and SHA-1 are. Which page is which is found on rows without payloads, a popular payload's in SALTS parts;
    payloads are exchanged once, each but once from a task, and shorter ones stay where they are.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    size, digest = F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest")
    same = ["payload_digest", "payload_bytes"]
    short = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) < least).select("page_id", "url", "html", size, digest, F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"))
    long = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    narrow = materialize(long.select("page_id", "url", size, digest), "narrow")
    held = narrow.groupBy(*same).agg(F.max("page_id").alias("__held"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    held = held.select(*same, "__held", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    told = narrow.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(held, [*same, "__salt"], "left")
    told = materialize(told.select("page_id", "url", *same, F.when(~F.col("page_id").eqNullSafe(F.col("__held")), F.col("__held")).alias("refers_to")), "told")
    discard(narrow)
    bodies = long.select("html", size, digest).groupBy(*same).agg(F.first("html").alias("html"))
    responses = told.where("refers_to IS NULL").join(bodies, same).select("page_id", "url", "html", *reversed(same), "refers_to")
    revisits = told.where("refers_to IS NOT NULL").select("page_id", "url", F.lit(None).cast("string").alias("html"), *reversed(same), "refers_to")
    return short.unionByName(responses).unionByName(revisits)


def segments(html: Column, chunk_bytes: int) -> Column:
    """The payload as an array of binary chunks of at most ``chunk_bytes``; a version line inside a payload, or a version at a chunk's end, where a line break is written, is cut in two, so that no chunk looks like the start of a record."""
    parts = F.transform(F.split(F.coalesce(html, F.lit("")), r"(?<=WARC/1)(?=\.1\r\n)", -1), lambda p: F.encode(p, "UTF-8"))
    cut = lambda p: F.transform(F.sequence(F.lit(0), ((F.octet_length(p) - 1) / chunk_bytes).cast("int")), lambda i: F.substr(p, i * chunk_bytes + 1, F.lit(chunk_bytes)))
    end, size = F.lit(VERSION.encode()), len(VERSION)
    halves = lambda c: F.array(F.substr(c, F.lit(1), F.octet_length(c) - 2), F.lit(VERSION[-2:].encode()))
    apart = lambda c: F.when(F.substr(c, F.octet_length(c) - (size - 1), F.lit(size)) == end, halves(c)).otherwise(F.array(c))
    return F.flatten(F.transform(F.flatten(F.transform(parts, cut)), apart))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, chunk_bytes: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a WARC record for each page into gzip archives under ``path``: one gzip stream a file, so that a file is read from its start. Columns other than page_id, url and html are not archived, whatever their names; an empty table gives archives without records."""
    planned = plan_records(pages, least).select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", F.uuid().alias("__id"), segments(F.col("html"), chunk_bytes).alias("__segments"))
    rows = planned.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "__id", F.size("__segments").alias("__of"), F.posexplode("__segments").alias("__no", "__data"))
    name = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))  # noqa: E731  a null value leaves the line out
    first, revisit = F.col("__no") == 0, F.col("refers_to").isNotNull()
    block = F.when(first, F.concat(F.encode(F.lit(HTTP), "UTF-8"), F.col("__data"))).otherwise(F.col("__data"))
    head = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))),
        line("WARC-Record-ID", name(F.when(first, F.col("__id")).otherwise(F.uuid()))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20]+", "%20"), r"(?<=WARC/1)\.(?=1$)", "%2E")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Segment-Number", F.when(F.col("__of") > 1, F.col("__no") + 1)),
        line("WARC-Segment-Origin-ID", F.when(~first, name(F.col("__id")))),
        line("WARC-Segment-Total-Length", F.when((F.col("__of") > 1) & (F.col("__no") + 1 == F.col("__of")), F.col("payload_bytes") + len(HTTP))),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page", F.col("refers_to")),
        line("Content-Type", F.when(first, F.lit("application/http;msgtype=response")).otherwise(F.lit("application/octet-stream"))),
        line("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    )
    rows.select(F.concat(F.encode(head, "UTF-8"), block).cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: record_id, chunk_no (from 1), chunked, page_id, record_type, refers_to, declared_bytes, declared_digest, data.

    A record whose block is shorter than its Content-Length is an error.
    """
    raw = spark.read.option("lineSep", BEGIN).text(path).where("value <> ''")
    head = F.concat(F.lit(CRLF), F.substring_index("value", CRLF * 2, 1), F.lit(CRLF))
    rows = raw.select(F.col("value").cast("binary").alias("__raw"), F.octet_length(F.substring_index("value", CRLF * 2, 1)).alias("__at"), head.alias("__head"))
    field = lambda key: F.nullif(F.regexp_extract("__head", rf"\r\n{key}: ([^\r]*)\r\n", 1), F.lit(""))
    rows = rows.select("__raw", "__at", *(field(k).alias(a) for k, a in {"WARC-Type": "__type", "WARC-Record-ID": "__own", "WARC-Segment-Origin-ID": "__origin", "WARC-Segment-Number": "__no", "X-Payload-Length": "declared_bytes", "X-Page-ID": "page_id", "X-Refers-To-Page": "refers_to", "WARC-Payload-Digest": "declared_digest", "Content-Length": "__length"}.items()))
    block = F.substr("__raw", F.col("__at") + 5, F.col("__length").cast("int"))
    whole = F.when(F.octet_length(block) == F.col("__length").cast("int"), block).otherwise(F.raise_error(F.concat(F.lit("record cut short: "), F.col("__own"))).cast("binary"))
    return rows.select(
        F.coalesce("__origin", "__own").alias("record_id"),
        F.coalesce(F.col("__no").cast("int"), F.lit(1)).alias("chunk_no"),
        F.col("__no").isNotNull().alias("chunked"),
        F.col("page_id").cast("long").alias("page_id"),
        F.when(F.col("__type") == "revisit", "revisit").otherwise("response").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
        F.col("declared_bytes").cast("long").alias("declared_bytes"),
        F.substring_index("declared_digest", ":", -1).alias("declared_digest"),
        F.when(F.col("__origin").isNull(), F.substr(whole, F.lit(len(HTTP) + 1))).otherwise(whole).alias("data"),
    )


DIGESTS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string())])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and SHA-1 of each record, chunk by chunk; the chunks of a record come one after another, in order, perhaps over several batches. Records of one piece have theirs and go through."""
    now, digest, size, due = None, None, 0, 0

    def done():
        return now | {"payload_bytes": size, "payload_digest": digest.hexdigest()}

    for batch in batches:
        whole = batch.filter(pc.invert(batch.column("chunked")))
        yield pa.RecordBatch.from_arrays([whole.column(c) for c in DIGESTS.names], schema=DIGESTS)
        pieces, rows = batch.filter(batch.column("chunked")), []
        for i in range(pieces.num_rows):
            row = {c: pieces.column(c)[i].as_py() for c in (*DIGESTS.names, "chunk_no")}
            if now is None or row["record_id"] != now["record_id"]:
                if now is not None:
                    rows.append(done())
                now, digest, size, due = row, hashlib.sha1(), 0, 1
            if row["chunk_no"] != due:
                raise ValueError(f"chunk {due} of {row['record_id']} is missing")
            data = pieces.column("data")[i].as_buffer()
            digest.update(data)
            size, due = size + data.size, due + 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, DIGESTS)
    if now is not None:
        yield pa.RecordBatch.from_pylist([done()], DIGESTS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under ``path``: record_id, page_id, record_type, refers_to, payload_bytes, payload_digest.

    Length and digest of a response are computed from its chunks and must match what it declares (else an error); a
    revisit has those of the payload that it refers to. The archives are read once; of records in one piece only what has
    been computed is exchanged, of others the chunks.
    """
    chunks = read_chunks(spark, path)
    revisit = F.col("record_type") == "revisit"
    rows = chunks.select(
        "record_id", "chunk_no", "chunked", "page_id", "record_type", "refers_to",
        F.when(revisit, F.col("declared_bytes")).when(~F.col("chunked"), F.octet_length("data").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).when(~F.col("chunked"), F.sha1("data")).alias("payload_digest"),
        "declared_digest", F.when(F.col("chunked"), F.col("data")).alias("data"),
    )
    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in DIGESTS)
    rows = rows.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_carry, kinds)
    ok = F.when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_digest"))
    return rows.withColumn("payload_digest", ok.otherwise(F.raise_error(F.concat(F.lit("wrong digest: "), F.col("record_id"))).cast("string"))).drop("declared_digest")


def op9_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read again. An empty table gives no rows."""
    path = new_path(spark, "warc")
    write_warc(pages, path)
    return read_records(spark, until_exit(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for `op9_warc`.
OP9_SQL = """
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN octet_length(body) >= 1000 AND page_id < held THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(body) >= 1000 AND page_id < held THEN held END AS refers_to
FROM (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS held
      FROM (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages))
"""
