"""Content-addressed web archives: headers of all records, payload bytes once by verified digest.

An archive is a folder of two Parquet tables. ``headers``: one row per record, with its exact WARC/1.1 header
block and the SHA-256 and length of its payload. ``payloads``: one row per SHA-256. Records are rebuilt by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.scratch import scratch_path

#: Payloads of fewer bytes are always stored as responses.
LEAST_REVISIT = 1000
CRLF = "\r\n"


def _header(date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    key = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace("url", r"[\r\n]", " ")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", key("page_id")), line("WARC-Date", F.lit(date)),
        F.when(url.isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", key("refers_to")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archive one record per page under ``path``.

    Of records with equal payloads of LEAST_REVISIT bytes or more, that with the largest id is the response
    (several, if rows repeat it; a null id only if there is no other), and the rest are revisits of it. A null
    html is an empty payload; a null url leaves its header line out. Records of repeated ids have the same Record-ID,
    and those without an id ``null`` in it. Equal digests are checked to be of equal bytes, else the job fails. Payload
    bytes are moved once, without repeats in a task, and not with the headers. An empty table gives an empty archive.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.encode(F.col(f"`{html_col}`"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "n_bytes": F.length("payload").cast("long")})
    rows.select("sha256", "payload").distinct().write.option("compression", "zstd").parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads")
    if different := stored.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1").first():
        raise ValueError(f"different payloads with digest {different['sha256']}")
    heads = rows.select("page_id", "url", "sha256", "n_bytes", F.sha1("payload").alias("sha1"))
    latest = heads.where(F.col("n_bytes") >= LEAST_REVISIT).groupBy("sha256").agg(F.max("page_id").alias("latest"))
    old = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    kinds = heads.join(latest, "sha256", "left").withColumns({"record_type": F.when(old, "revisit").otherwise("response"), "refers_to": F.when(old, F.col("latest"))})
    kinds.select("page_id", "sha256", "n_bytes", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' header fields, parsed from the stored header blocks, with the key of the payload."""
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    key = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: <urn:page:([^>]*)>", 1), F.lit("")).try_cast("long")
    return spark.read.parquet(f"{path}/headers").select(
        key("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), key("WARC-Refers-To").alias("refers_to"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"), F.substring(field("WARC-Payload-Digest"), 6, 40).alias("digest"), "sha256", "n_bytes", "header",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, refers_to, url, digest, sha256, header, payload, record``: whole records as WARC bytes, and the full payload."""
    joined = read_headers(spark, path).join(spark.read.parquet(f"{path}/payloads").select("sha256", "payload"), "sha256")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n"))
    return joined.select("page_id", "record_type", "refers_to", "url", "digest", "sha256", "header", "payload", record.alias("record"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Per rebuilt record: ``page_id``, size and SHA-1 of its payload, ``record_type, refers_to`` and ``intact``.

    The block is cut out of the record's bytes, behind the first empty line and as long as the header says. A record
    is intact if that is its whole payload (nothing for a revisit), only the end mark follows, and the payload has
    both the digest in the header and the one it is stored by.
    """
    head = F.locate("\r\n\r\n", "header") + 3
    size = F.regexp_extract("header", r"\r\nContent-Length: (\d+)", 1).cast("int")
    block = F.substring("record", F.octet_length("header") + 1, size)
    whole = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    intact = (
        (head == F.length("header")) & (block == whole) & (F.octet_length("record") == F.octet_length("header") + size + 4)
        & (F.sha1("payload") == F.col("digest")) & (F.sha2("payload", 256) == F.col("sha256"))
    )
    return read_records(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to", intact.alias("intact"))


def op10_query(pages: DataFrame) -> DataFrame:
    """The contract's columns and ``intact``, all from records that were written, read again and rebuilt; edge cases as in ``write_archive``."""
    path = scratch_path(pages.sparkSession, "archive")
    write_archive(pages, path)
    return verify(pages.sparkSession, path)
