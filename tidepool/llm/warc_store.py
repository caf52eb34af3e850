"""WARC records in a content-addressed archive.

An archive is two tables: `payloads` holds every distinct payload once under its digest, `headers` the exact header bytes
of each record with the digest of the payload that belongs to it. The address is SHA-256; the SHA-1 that WARC headers
carry is kept beside it. Records are put together again by joining the two and are verified: the length and both digests
of the payload must be those that the header and the address name. A payload that more than one record has is written by
the record with the largest page_id, the others are revisits that refer to it.

Defined results: null html is an empty payload (and, as any payload of `least` bytes or more, shared); a null url gives
a record without WARC-Target-URI, line ends in a url are left out;
rows that repeat the largest page_id are responses as well; an empty table gives an empty archive; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

VERSION = "WARC/1.1"
_DATE = "2024-01-31T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits as four times 40 bits, eight digits each."""
    digits = lambda i: F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[digits(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, record_type, refers_to, sha256, payload_digest, payload_bytes, header and, on responses, payload."""
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    known = raw.select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = known.groupBy("sha256").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = known.join(first.where("n > 1").drop("n"), "sha256", "left")
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = shared.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    urn = lambda page: F.concat(F.lit("<urn:tidepool:page:"), page.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:tidepool:page:>"))), line("WARC-Date", F.lit(_DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.coalesce(F.when(revisit_column(), line("WARC-Refers-To", urn(F.col("refers_to")))), F.lit("")), F.when(revisit_column(), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit_column(), F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))), F.lit("\r\n"),
    )
    return typed.withColumn("header", F.encode(header, "UTF-8"))


def revisit_column() -> Column:
    return F.col("record_type") == "revisit"


def write_archive(pages: DataFrame, path: str, least: int = 0, most_shared: int = 1_000_000) -> None:
    """Writes the two tables of an archive.

    Payloads that one page has are written where they are read; only copies are shuffled, to keep one of each. For that the
    digests that copies share go to all tasks if they are at most `most_shared` (64 bytes each); beyond, all payloads are shuffled.
    """
    rows = records(pages, least)
    rows.select("page_id", "record_type", "refers_to", "sha256", "payload_digest", "payload_bytes", "header").write.parquet(f"{path}/headers")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    raw = pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload"))
    copies = materialize(pages.sparkSession.read.parquet(f"{path}/headers").groupBy("sha256").count().where("count > 1").select("sha256"), "copies")
    if copies.count() <= most_shared:
        shared = F.broadcast(copies)
        stored = raw.join(shared, "sha256", "left_anti").union(raw.join(shared, "sha256", "left_semi").dropDuplicates(["sha256"]))
    else:
        stored = raw.dropDuplicates(["sha256"])
    stored.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, put together from header and payload bytes, parsed from their own bytes and verified.

    Responses meet their payloads; length and digests are computed from the block that the record's Content-Length cuts out.
    Revisits are headers alone; they take length and digest from the response that holds their payload. A record whose
    bytes do not agree, or whose payload is missing, stays with verified false.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    whole = headers.where("record_type <> 'revisit'").select("sha256", "header").join(payloads, "sha256", "left")
    record = whole.select("sha256", F.concat("header", F.coalesce("payload", F.encode(F.lit(""), "UTF-8")), end).alias("record"))
    head = F.length(F.substring_index(F.decode("record", "ISO-8859-1"), "\r\n\r\n", 1)) + 4  # a character for each byte
    cut = record.withColumn("head", head).withColumn("size", _field(F.decode(F.expr("substring(record, 1, head)"), "UTF-8"), "Content-Length").try_cast("int"))
    block = cut.select("sha256", F.expr("substring(record, 1, head)").alias("header"), F.expr("substring(record, head + 1, size)").alias("block"), F.expr("substring(record, head + size + 1)").alias("rest"))
    sound = (F.sha2("block", 256) == F.col("sha256")) & (F.col("rest") == end)
    read = block.select("sha256", "header", F.octet_length("block").cast("long").alias("payload_bytes"), base32_sha1(F.col("block")).alias("digest"), F.coalesce(sound, F.lit(False)).alias("sound"))
    read = materialize(read, "responses")
    proven = read.groupBy("sha256").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("digest").alias("digest"), F.bool_and("sound").alias("sound"))
    revisits = headers.where("record_type = 'revisit'").select("sha256", "header").join(proven, "sha256", "left").select(*read.columns)
    text = F.decode("header", "UTF-8")
    number = lambda name: F.regexp_extract(_field(text, name), r"page:(-?\d+)>", 1).try_cast("long")
    parsed = read.union(revisits).select(
        number("WARC-Record-ID").alias("page_id"), _field(text, "WARC-Target-URI").alias("url"), "payload_bytes", F.regexp_replace(_field(text, "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field(text, "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), "digest", "sound", _field(text, "Content-Length").try_cast("long").alias("length"),
    )
    ok = F.col("sound") & (F.col("digest") == F.col("payload_digest")) & (F.col("length") == F.when(revisit_column(), 0).otherwise(F.col("payload_bytes")))
    return parsed.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce(ok, F.lit(False)).alias("verified"))


def _field(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def record_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact WARC record bytes, header and block, put together by a join."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    block = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return headers.join(payloads, "sha256").select("page_id", F.concat("header", block, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def write_warc(spark: SparkSession, path: str, out: str, per_file: int = 20_000) -> None:
    """Exports an archive as WARC files through Spark's own text writer: records end with two line ends."""
    lines = record_bytes(spark, path).select(F.decode("record", "UTF-8").alias("value"))
    lines.select(F.expr("substring(value, 1, length(value) - 4)").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of every record in WARC files, found by Content-Length. A file is one task's; per_file bounds it."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                raw, at, heads, blocks = data.as_py(), 0, [], []
                while at < len(raw):
                    end = raw.index(b"\r\n\r\n", at) + 4
                    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", raw[at:end])[1])
                    heads.append(raw[at:end])
                    blocks.append(raw[end : end + size])
                    at = end + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(blocks, pa.binary())], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "header binary, block binary")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes an archive of the pages to the shared folder and reads its records back."""
    path = f"{shared_dir(pages.sparkSession)}/archive"
    write_archive(pages, path, least)
    return read_archive(pages.sparkSession, path)
