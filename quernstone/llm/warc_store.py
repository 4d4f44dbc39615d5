"""Content-addressed WARC archive: payloads once by SHA-256, exact record headers apart, records back through a join.

``write_archive`` writes two Parquet tables below one folder: ``payloads`` (digest,
payload), each distinct payload once whatever its number of records, and ``headers``
(one row a record: key, digest, and the record's exact header bytes up to the payload).
``record_bytes`` joins them to the original records byte for byte, recomputing every digest
from the bytes read; a mismatch, a missing payload or a header that names another digest raises.
``records`` gives their columns.

Edge cases: null payloads are empty; a null url is the empty URI; line breaks in a url
are percent-encoded, as a header can't hold them. Rows that repeat a key and payload
are records of their own: the rows that hold the smallest key are all responses.
A null key never refers others while its payload has another key. Empty tables give
empty archives. Payload groups are pre-aggregated before the shuffle, so a payload
shared by a third of the rows costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import quoted, shared_dir, table

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one record per row: a revisit where a smaller key has the same payload of least_bytes or more, else a response."""
    body = F.coalesce(quoted(payload).cast("binary"), F.lit(b""))
    rows = pages.select(quoted(key).alias("key"), F.regexp_replace(F.regexp_replace(F.coalesce(quoted(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    small = rows.drop("payload")
    first = small.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    named = small.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("n") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = _lines("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ", F.col("n").cast("string"), CRLF + CRLF)
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n"))
    header = _lines(
        "WARC/1.1" + CRLF + "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"), CRLF + "WARC-Record-ID: ", uri("key"), CRLF + f"WARC-Date: {date}" + CRLF + "WARC-Target-URI: ", F.col("url"),
        CRLF + "WARC-Payload-Digest: sha256:", F.col("digest"), CRLF, F.when(revisit, _lines("WARC-Refers-To: ", uri("first"), CRLF + f"WARC-Profile: {PROFILE}" + CRLF)).otherwise(""),
        "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: ", length.cast("string"), CRLF + CRLF, F.col("http"),
    )
    named.withColumn("http", http).select("key", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    return path


def _verified(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.parquet(f"{path}/payloads").withColumn("actual", F.sha2("payload", 256))
    return got.withColumn("actual", F.when(F.col("actual") == F.col("digest"), F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest")))))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Each header with its verified payload and its record: the bytes of both, the payload not in a revisit, and two line breaks."""
    named = F.regexp_extract(F.decode("header", "UTF-8"), r"(?md)^WARC-Payload-Digest: (.*?)\r$", 1)
    heads = spark.read.parquet(f"{path}/headers").withColumns({"named": named, "revisit": F.contains(F.decode("header", "UTF-8"), F.lit(CRLF + "WARC-Type: revisit" + CRLF))})
    whole = heads.join(_verified(spark, path), "digest", "left")
    bad = F.raise_error(F.concat(F.lit("no payload of the digest in the header: "), F.coalesce("named", F.lit("none")))).cast("boolean")
    whole = whole.where(F.when(F.col("actual").isNotNull() & (F.col("named") == F.concat(F.lit("sha256:"), F.col("actual"))), True).otherwise(bad))
    return whole.withColumn("record", F.concat("header", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """key, url, payload_bytes, payload_digest, record_type, refers_to (the key as text), read from the original records; a revisit's payload is that which it refers to."""
    size = F.octet_length("header")
    text = F.decode(F.substring(F.col("record"), F.lit(1), size), "UTF-8")
    body = F.when(F.col("revisit"), F.col("payload")).otherwise(F.substring(F.col("record"), size + 1, F.octet_length("record") - size - 4))
    field = lambda name: F.regexp_extract(text, rf"(?md)^{name}: (.*?)\r$", 1)
    return _whole(spark, path).select(
        "key", field("WARC-Target-URI").alias("url"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"), field("WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(text, r"(?md)^WARC-Refers-To: <urn:x-page:(.*?)>\r$", 1), F.lit("")).alias("refers_to"),
    )


def record_bytes(spark: SparkSession, path: str) -> DataFrame:
    """key and record: each original record byte for byte, ending in the two line breaks that part records."""
    return _whole(spark, path).select("key", "record")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = write_archive(pages, shared_dir(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    return records(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""
