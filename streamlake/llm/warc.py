"""Content-addressed web archive.

An archive is two tables: ``payloads`` holds each distinct payload once under its SHA-256 address,
``headers`` the exact header bytes of every record and the address of its payload. Reading joins
them, verifies address, digest and lengths, and gives back the records byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlake.session import run_dir

# Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RADIX32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
LEAST_SHARED_BYTES = 0
HEADERS = "page_id bigint, address binary, header binary"
PAYLOADS = "address binary, payload binary"


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1: each five hexadecimal digits are four digits of radix 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), RADIX32_DIGITS, BASE32_DIGITS)


def record_id(page_id: Column, address: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"), address))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def http_head(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def addressed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.unhex(F.sha2(payload, 256)).alias("address"))


def write(pages: DataFrame, least_shared_bytes: int = LEAST_SHARED_BYTES,
          date: str = DATE) -> str:
    """Archive ``pages (page_id, url, html)`` and return the folder.

    Of records with equal payloads of at least ``least_shared_bytes`` the one with the smallest page
    id is a response and the others are revisits of it; smaller payloads are responses throughout.
    A null html is an empty payload, a null url leaves its header line out, control characters in
    one are percent-encoded. Rows that repeat a page id and its payload are responses or revisits
    alike; rows without page id are responses. Other columns are ignored.

    The first page of a payload is a map-side minimum; payload bytes are shuffled only for the rows
    that hold a first page.
    """
    rows = addressed(pages)
    first = rows.groupBy("address").agg(F.min("page_id").alias("first_id"))
    size = F.octet_length("payload")
    known = (rows.withColumn("bytes", size.cast("long"))
             .withColumn("digest", payload_digest(F.col("payload"))).drop("payload")
             .join(first.withColumnRenamed("address", "at"), F.col("address") == F.col("at")))
    revisit = (F.col("bytes") >= least_shared_bytes) & (F.col("page_id") > F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    head = http_head(F.col("bytes"))
    block = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("bytes"))
    url = F.transform(F.split("url", ""), lambda c: F.when(
        c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0")))
        .otherwise(c))
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.array_join(url, "")).otherwise(
        F.col("url"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), field("WARC-Type", kind),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("address"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id"), F.col("address")))),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("X-Refers-To-Page-ID", F.when(revisit, F.col("first_id").cast("string"))),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", block.cast("string")), F.lit("\r\n"), head)
    out = run_dir(pages.sparkSession, "warc")
    (known.select("page_id", "address", header.cast("binary").alias("header"))
     .write.option("compression", "zstd").parquet(f"{out}/headers"))
    # Joined and made distinct by the same two columns, so the payloads move once. A missing id has
    # a place of its own, which only counts where no row of the payload has an id.
    nowhere = F.lit(-(1 << 63))
    firsts = rows.withColumn("holder", F.coalesce("page_id", nowhere)).join(
        first.select(F.col("address").alias("at"), F.coalesce("first_id", nowhere).alias("from")),
        (F.col("address") == F.col("at")) & (F.col("holder") == F.col("from")), "left_semi")
    (firsts.select("address", "holder", "payload").dropDuplicates(["address", "holder"])
     .drop("holder")
     .write.option("compression", "zstd").parquet(f"{out}/payloads"))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``page_id, url, record_type, payload_digest, refers_to, payload,
    record``, where ``record`` is the complete record as it stands in an archive file.

    Fails on a missing payload, one whose bytes are not those of its address or digest, and on a
    wrong length.
    """
    def header_field(name: str) -> Column:
        value = F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers").select(
        F.col("address").alias("of"), F.col("header").cast("string").alias("head"))
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").select(
        "address", F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("a payload does not match its address")).cast("binary"))
        .alias("payload"))
    joined = headers.join(payloads, F.col("of") == F.col("address"), "left").select(
        "head", F.coalesce("payload", F.raise_error(F.lit("a payload is missing")).cast("binary"))
        .alias("payload"))
    parsed = joined.select(
        header_field("X-Page-ID").cast("long").alias("page_id"),
        header_field("WARC-Target-URI").alias("url"),
        header_field("WARC-Type").alias("record_type"),
        header_field("WARC-Payload-Digest").alias("told"),
        header_field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        # Of the two lengths in the header the first is that of the record's block.
        F.regexp_extract("head", r"\r\nContent-Length: (\d+)\r\n\r\n", 1).cast("long")
        .alias("told_length"), "head", "payload", payload_digest(F.col("payload")).alias("digest"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(
        F.lit("").cast("binary"))
    length = F.octet_length("head") - F.octet_length(
        F.substring_index("head", "\r\n\r\n", 1)) - 4 + F.octet_length(body)
    sound = (F.col("told") == F.concat(F.lit("sha1:"), F.col("digest"))) & (
        F.col("told_length") == length)
    return parsed.select(
        "page_id", "url", "record_type",
        F.when(sound, F.col("digest")).otherwise(
            F.raise_error(F.lit("a record does not match its headers")).cast("string"))
        .alias("payload_digest"), "refers_to", "payload",
        F.concat(F.col("head").cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
        .alias("record"))
