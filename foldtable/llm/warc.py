"""WARC archives in which equal payloads are stored once.

Only headers are shuffled by payload digest; each repeated payload gets one original, and the
other records become revisits that refer to it. Archives are written by Spark's own writer, so
they land in whatever store the path names, and are read back record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, parts_for, stage, utf8_size

# Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SPARK_BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_bytes long, record_id string"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 of a SHA-1, by expressions: 20 bits at a time are 5 hex and 4 base32 digits."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), SPARK_BASE32, BASE32)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The originals of repeated payloads: digest, payload_bytes, original page_id.

    headers: page_id, payload_bytes, payload_digest. Counting combines before the shuffle, so a
    payload that a third of all pages share is no larger to a task than any other.
    """
    return (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("original").isNotNull())
        .drop("n")
    )


def _record_text(date: str) -> Column:
    crlf, uri = "\r\n", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    revisit, first = F.col("original").isNotNull(), (F.col("_salt") == 0) & (F.col("_copy") == 1)
    urn = lambda page: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("payload_digest"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes"), F.lit(crlf * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: "), F.when(first, urn(F.col("page_id"))).otherwise(F.replace(urn(F.col("page_id")), F.lit(">"), F.concat_ws("", F.lit(":"), "_salt", F.lit("."), "_copy", F.lit(">")))),
        F.lit(f"{crlf}WARC-Date: {date}{crlf}WARC-Target-URI: "), uri,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Profile: {REVISIT_PROFILE}{crlf}WARC-Refers-To: "), urn(F.col("original")))).otherwise(""),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), block,
        F.lit(crlf * 2), http, F.when(revisit, "").otherwise(F.col("html")), F.lit(crlf),
    )


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 16 << 20,
) -> None:
    """Write one record for each row of pages (page_id, url, html) to archives under `path`.

    Of rows with equal payloads of at least `min_bytes`, that with the largest page_id is the
    response and the others are revisits of it; rows equal in page_id and payload share that
    role. Null html is an empty payload; a row without page_id is a response unless its payload
    has another, numbered original; a null url is an empty one. Other columns are left out. Only
    headers travel by digest; pages travel once, by page_id, into archives of about
    `archive_bytes` before gzip. Rows that repeat one page_id (or have none) and one payload are
    dealt to several archives where they would fill one, and their record ids are numbered from the
    second on. An empty table writes an empty archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    full = pages.select(
        "page_id", "url", payload.alias("html"), utf8_size(payload).alias("payload_bytes"),
        base32_sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
    )
    headers = stage(full.select("page_id", "payload_bytes", "payload_digest"), "warc-headers")
    originals = stage(resolve_revisits(headers, min_bytes), "warc-originals")
    # A payload on a third of all rows: the adaptive skew join splits that side, as both are plain reads.
    revisits = (
        headers.join(originals, ["payload_digest", "payload_bytes"])
        .where(~F.col("page_id").eqNullSafe(F.col("original")))
        .select(_key().alias("_key"), "original")
        .distinct()
    )
    total = headers.agg(F.sum(F.col("payload_bytes") + 600)).first()[0]
    archives = parts_for(spark, total, archive_bytes)
    keyed, revisits = full.withColumn("_key", _key()), stage(revisits, "warc-revisits")
    keyed, revisits = keyed.withColumn("_salt", F.lit(0)), revisits.withColumn("_salt", F.lit(0))
    repeats = stage(_repeated_keys(headers, archive_bytes), "warc-repeats")
    hot = repeats.where("_splits > 1")
    if not hot.isEmpty():
        # Spark broadcasts these if their files are small, and merges by key if they aren't.
        split = F.coalesce("_splits", F.lit(1))
        keyed = keyed.join(hot, "_key", "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), split).cast("int")).drop("_splits")
        revisits = revisits.join(hot, "_key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), split - 1))).drop("_splits")
    # Both sides are dealt by the join's key, so pages move once and archives are the join's partitions.
    by = ["_key", "_salt"]
    records = keyed.repartition(archives, *by).join(revisits.repartition(archives, *by).hint("shuffle_hash"), by, "left")
    # Copies are counted within an archive, which is sorted for that alone; a split key's never fill one.
    copy = F.lit(1) if repeats.isEmpty() else F.row_number().over(Window.partitionBy(*by).orderBy("url"))
    (
        records.withColumn("_copy", copy).select(_record_text(date).alias("value"))
        .write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    )


def _repeated_keys(headers: DataFrame, archive_bytes: int) -> DataFrame:
    """Keys of several rows, and into how many parts they are to be split so that none takes over half an archive."""
    bytes_of = F.sum(F.col("payload_bytes") + 600)
    sizes = headers.groupBy(_key().alias("_key")).agg(F.count("*").alias("n"), bytes_of.alias("b"))
    return sizes.where("n > 1").select("_key", F.ceil(F.col("b") * 2 / archive_bytes).cast("int").alias("_splits"))


def _key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "payload_digest")


def _parse(content: bytes):
    """(header fields, block) of each record, by Content-Length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(fields["Content-Length"])
        block = content[end + 4 : end + 4 + size]
        if content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where its length says")
        yield fields, block
        at = end + 8 + size


def _page(urn: str | None) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+):", urn or "")
    return int(found[1]) if found else None


def _read(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in _parse(gzip.decompress(content.as_py())):
                http, payload = block.split(b"\r\n\r\n", 1)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), size, digest, len(payload), fields["WARC-Record-ID"]))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the archives under `path`, payloads checked against their digests."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    return files.select("content").mapInArrow(_read, READ_SCHEMA)


def archive_pages(spark, pages: DataFrame) -> DataFrame:
    """Archive all pages and report on each record as the archives have it."""
    path = new_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
