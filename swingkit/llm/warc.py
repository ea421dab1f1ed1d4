"""WARC records through a chunked record table.

Every payload becomes rows of a record identifier, a chunk number and a chunk of at most ``CHUNK`` bytes, each written as
a WARC record of its own: the first with the HTTP header of a response, later ones as ``continuation`` segments. A row
holds the payload that Spark read and the chunk that is being written, never a second array of all chunks; on reading, a row
holds a chunk. Spark's text writer makes the archives, one gzip stream for each file, in whatever store the path names.
Payloads are also cut inside every ``WARC/1.1``, so the line that starts a record is a safe separator, and the archives are
read back by Spark's text reader, split by it.

Payload digests are of whole payloads: on writing they name equal payloads, on reading they are worked out anew, for
payloads of several chunks as running digests over the chunks in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm.common import bounded, new_folder, small_batches, table

CHUNK = 1 << 16
START, LINE = "WARC/1.1\r\n", "\r\n"
#: Before every payload, and the profile of a record that only names an equal payload (fixed values of the format).
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many groups of equal payloads are broadcast; more are joined by a shuffle.
MOST_GROUPS = 1_000_000
#: Base-32 digits of Spark's ``conv`` and the signs of RFC 4648.
_DIGITS, _SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base 32 of a hexadecimal SHA-1 (20 bits at a time)."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _SIGNS)


def with_types(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) plus payload, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``smallest`` bytes the rows of the least page_id are responses and the others revisit
    it; a group without any page_id is all response. A null html is the empty payload.
    """
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload).cast("long")
    digests = pages.select("page_id", "url", size.alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("sha1")).filter(F.col("payload_bytes") >= smallest)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    groups = digests.groupBy("sha1", "payload_bytes").agg(F.count("*").alias("n"), first).filter("n > 1 and first is not null")
    known = pages.select("page_id", "url", payload.alias("payload"), size.alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("sha1"))
    joined = known.join(bounded(groups.drop("n"), MOST_GROUPS), ["sha1", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_to_url"),
    )


def records(typed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each WARC record, without its last line end: ``value``; the chunks of a payload follow one another."""
    revisit = F.col("record_type") == "revisit"
    parts = F.when(revisit, F.array(F.lit(""))).when(F.instr("payload", START[:-2]) == 0, F.array("payload")).otherwise(F.split("payload", r"(?<=WARC)(?=/1\.1)"))
    rows = typed.withColumns({"record_id": F.expr("uuid()"), "parts": parts.cast("array<binary>")})
    # Chunks of the parts before each part, from lengths alone.
    many = F.transform("parts", lambda p: F.greatest(F.lit(1), F.ceil(F.octet_length(p) / chunk)).cast("long"))
    rows = rows.withColumn("many", many).withColumn("chunks", F.aggregate("many", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.select(*(c for c in rows.columns if c not in ("payload", "parts", "many")), "many", F.posexplode("parts").alias("part", "bytes"))
    before = F.aggregate(F.slice("many", 1, F.col("part")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("before", before).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.get("many", F.col("part")) - 1)))
    piece = F.substring("bytes", F.col("k").cast("int") * chunk + 1, F.lit(chunk))
    rows = rows.select("*", (F.col("before") + F.col("k")).alias("number"), piece.cast("string").alias("chunk")).drop("bytes", "many")
    first, last = F.col("number") == 0, F.col("number") == F.col("chunks") - 1
    whole = F.col("payload_bytes") + len(HTTP)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE))
    some = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    identifier = lambda value: F.concat(F.lit("<urn:uuid:"), value, F.lit(">"))
    here = F.when(first, HTTP).otherwise("")
    return rows.select(
        F.concat(
            F.lit(START),
            field("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
            field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            some("WARC-Target-URI", _uri("url")),
            field("WARC-Record-ID", identifier(F.when(first, F.col("record_id")).otherwise(F.expr("uuid()")))),
            F.when(first, field("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(""),
            some("X-Page-ID", F.col("page_id")),
            F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), some("WARC-Refers-To-Target-URI", _uri("refers_to_url")))).otherwise(""),
            some("X-Refers-To-Page-ID", F.col("refers_to")),
            F.when(first, F.concat(field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), field("X-Payload-Length", F.col("payload_bytes")))).otherwise(""),
            F.when(F.col("chunks") > 1, F.concat(
                field("WARC-Segment-Number", F.col("number") + 1),
                F.when(first, "").otherwise(field("WARC-Segment-Origin-ID", identifier(F.col("record_id")))),
                F.when(last, field("WARC-Segment-Total-Length", whole)).otherwise(""),
            )).otherwise(""),
            field("Content-Length", F.octet_length(here) + F.octet_length("chunk")),
            F.lit(LINE),
            here,
            F.col("chunk"),
            F.lit(LINE),
        ).alias("value")
    )


def _uri(url: str) -> Column:
    """A url without line ends, and without the sign that starts a record."""
    safe = F.col(url)
    for plain, escaped in (("\r", "%0D"), ("\n", "%0A"), (START[:-2], "WARC%2F1.1")):
        safe = F.replace(safe, F.lit(plain), F.lit(escaped))
    return safe


def write_archives(typed: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write the records as gzipped WARC files below ``path``."""
    records(typed, chunk).write.option("lineSep", LINE).option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: record_id, number (from 0), type, page_id, refers_to, digest and length fields, chunk (binary)."""
    lines = spark.read.option("lineSep", START).text(path).filter("value <> ''")
    cut = F.instr("value", LINE * 2)
    head = lines.select(F.substr("value", F.lit(1), cut + 1).alias("head"), F.substr("value", cut + 4).cast("binary").alias("rest"))
    field = lambda name, pattern=r"[^\r]*": F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: ({pattern})\r", 1), F.lit(""))
    kind = field("WARC-Type")
    header = F.when(kind == "continuation", 0).otherwise(len(HTTP))
    return head.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("number"),
        field("WARC-Segment-Number").isNotNull().alias("segmented"),
        kind.alias("type"),
        field("WARC-Target-URI").alias("url"),
        field("X-Page-ID").cast("long").alias("page_id"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:[^\r]*").substr(6, 32).alias("written_digest"),
        field("X-Payload-Length").cast("long").alias("written_bytes"),
        F.substring("rest", header + 1, field("Content-Length").cast("int") - header).alias("chunk"),
    )


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Length and digest of each record whose chunks follow one another in order."""
    record, digest, size = None, hashlib.sha1(), 0
    for batch in batches:
        out = []
        for name, chunk in zip(batch["record_id"], batch["chunk"], strict=True):
            if name != record:
                if record is not None:
                    out.append((record, size, digest.hexdigest()))
                record, digest, size = name, hashlib.sha1(), 0
            digest.update(chunk)
            size += len(chunk)
        yield pd.DataFrame(out, columns=["record_id", "payload_bytes", "sha1"])
    if record is not None:
        yield pd.DataFrame([(record, size, digest.hexdigest())], columns=["record_id", "payload_bytes", "sha1"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of archives: record_id, url, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests are worked out from the chunks; those of a revisit, which has no payload, are the fields it was
    written with.
    """
    small_batches(spark)
    chunks = read_chunks(spark, path)
    whole = chunks.filter("not segmented").select(
        "record_id", "url", "page_id", "type", "refers_to", "written_bytes", "written_digest", F.octet_length("chunk").cast("long").alias("payload_bytes"), base32(F.sha1("chunk")).alias("payload_digest")
    )
    parts = chunks.filter("segmented")
    run = parts.select("record_id", "number", "chunk").repartition("record_id").sortWithinPartitions("record_id", "number").select("record_id", "chunk").mapInPandas(_running, "record_id string, payload_bytes long, sha1 string")
    firsts = parts.filter("number = 0").select("record_id", "url", "page_id", "type", "refers_to", "written_bytes", "written_digest")
    found = whole.unionByName(firsts.join(run, "record_id").withColumn("payload_digest", base32(F.col("sha1"))).drop("sha1"))
    again = F.col("type") == "revisit"
    return found.select(
        "record_id", "url", "page_id",
        F.when(again, F.col("written_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("written_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    path = new_folder(spark, "warc")
    write_archives(with_types(table(spark, sf_dir, "pages")), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS BIGINT)) % 32 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
