"""A content-addressed web archive: payload bytes stored once, record headers kept apart, records rebuilt by a join.

Layout under one folder
* ``blobs``: ``digest, n_bytes, payload``, one row per SHA-256 digest;
* ``headers``: ``page_id, digest, header``, one row per record; ``header`` holds the record's header block exactly.

A record is its header block followed by its content block; for a revisit the content block is empty and the original
payload is that of the record it refers to, found by the same digest.

Defined results
* null payload: empty; null url: an empty target; line breaks in a url are percent-encoded, so headers stay whole;
* payloads under ``revisit_from`` bytes are never revisited, but their bytes are stored once too;
* equal payloads: the smallest id is the response; repeated rows of that id are responses too, every other row revisits;
  where all ids of a group are null, all of its rows are responses;
* an empty table gives an empty archive; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tontine.sources.shared import fresh_path

REVISIT_FROM = 100
#: Fixed values of the record format.
VERSION_LINE = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables hold no capture time; records carry this one unless the caller names another.
CAPTURED = "1970-01-01T00:00:00Z"


class ArchiveError(RuntimeError):
    """Stored bytes do not have the digest under which they are filed."""


def payloads(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    return pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def header_block(revisit: Column, captured: str = CAPTURED) -> Column:
    """The header block of a record with columns page_id, url, digest, n_bytes, response_id."""
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    original = F.concat(F.lit("<urn:page:"), F.col("response_id").cast("string"), F.lit(">"))
    return F.concat(
        F.lit(f"{VERSION_LINE}\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", identity),
        _line("WARC-Date", F.lit(captured)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit, F.concat(_line("WARC-Refers-To", original), _line("WARC-Profile", F.lit(PROFILE)))
        ).otherwise(F.lit("")),
        _line("X-Payload-Length", F.col("n_bytes").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, **columns: str) -> None:
    """Write ``blobs`` and ``headers``.

    Bytes are folded map-side, one copy per task and digest, and filed once. The narrow index of digests is read back
    from the blob table and joined to the records; both join sides are plain shuffles, so a digest that holds a third
    of all records can be split at run time.
    """
    spark = pages.sparkSession
    rows = payloads(pages, **columns)
    (
        rows.groupBy("digest")
        .agg(
            F.min("page_id").alias("response_id"),
            F.min(F.struct(F.length("payload").alias("n"), F.xxhash64("payload").alias("h"))).alias("least"),
            F.max(F.struct(F.length("payload").alias("n"), F.xxhash64("payload").alias("h"))).alias("most"),
            F.first("payload").alias("payload"),
        )
        # The digest is trusted only because a second hash and the length agree for all its payloads.
        .withColumn(
            "payload",
            F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(
                F.raise_error(F.concat(F.lit("two payloads share digest "), F.col("digest"))).cast("binary")
            ),
        )
        .select("digest", F.col("least.n").cast("long").alias("n_bytes"), "response_id", "payload")
        .write.option("compression", "zstd")
        .parquet(f"{path}/blobs")
    )
    index = spark.read.parquet(f"{path}/blobs").select("digest", "n_bytes", "response_id")
    revisit = (
        (F.col("n_bytes") >= revisit_from)
        & F.col("response_id").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    )
    (
        rows.select("page_id", "url", "digest")
        .join(index, "digest")
        .select("page_id", "digest", header_block(revisit).alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/headers")
    )


def verified_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The blob table; reading a blob whose bytes no longer have its digest raises."""
    blobs = spark.read.parquet(f"{path}/blobs")
    intact = (F.sha2("payload", 256) == F.col("digest")) & (F.length("payload") == F.col("n_bytes"))
    problem = F.raise_error(F.concat(F.lit("damaged blob "), F.col("digest"))).cast("long")
    checked = blobs.withColumn("n_bytes", F.when(intact, F.col("n_bytes")).otherwise(problem))
    return checked.filter("n_bytes >= 0").select("digest", "n_bytes", "payload")


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record, payload, digest``: the record's bytes as an archive file holds them, and the original payload."""
    joined = spark.read.parquet(f"{path}/headers").join(verified_blobs(spark, path), "digest")
    body = F.when(F.col("header").contains("WARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit(b"\r\n\r\n")
    return joined.select(
        "page_id", F.concat(F.encode("header", "UTF-8"), body, end).alias("record"), "payload", "digest"
    )


def _field(name: str) -> Column:
    value = F.regexp_extract("head", f"(?m)^{name}: ([^\\r\\n]*)", 1)
    return F.when(value != "", value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the rebuilt records say: each is cut at its header's end and its content is measured and hashed.

    A response whose content has another length or digest than its header states raises. A revisit has no content; its payload
    is that of the record it refers to, which is verified where it is read.
    """
    rebuilt = rebuild_records(spark, path)
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    cut = rebuilt.select("record", "payload", "digest", head.alias("head")).withColumn("start", F.octet_length("head") + 5)
    content = F.substring("record", F.col("start"), F.octet_length("record") - F.col("start") - 3)
    parsed = cut.select(
        F.regexp_extract("head", "WARC-Record-ID: <urn:page:(-?\\d+)>", 1).alias("identity"),
        _field("WARC-Target-URI").alias("url"),
        F.replace(_field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")).alias("stated"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract("head", "WARC-Refers-To: <urn:page:(-?\\d+)>", 1).alias("original"),
        _field("Content-Length").cast("long").alias("content_length"),
        content.alias("content"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
        "digest",
    )
    revisit = F.col("record_type") == "revisit"
    found = F.when(revisit, F.col("digest")).otherwise(F.sha2("content", 256))
    sound = (found == F.col("stated")) & (F.octet_length("content") == F.col("content_length"))
    problem = F.raise_error(F.concat(F.lit("damaged record of page "), F.col("identity"))).cast("string")
    return parsed.select(
        F.when(F.col("identity") != "", F.col("identity")).cast("long").alias("page_id"),
        "url",
        F.when(revisit, F.col("n_bytes")).otherwise(F.octet_length("content").cast("long")).alias("payload_bytes"),
        F.when(sound, found).otherwise(problem).alias("payload_digest"),
        "record_type",
        F.when(F.col("original") != "", F.col("original")).cast("long").alias("refers_to"),
    )


def archive(pages: DataFrame, **columns: str) -> str:
    """Write an archive into the shared folder and return its path."""
    path = fresh_path(pages.sparkSession, "archive")
    write_archive(pages, path, **columns)
    return path
