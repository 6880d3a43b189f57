"""WARC records in a content-addressed archive.

Two tables hold the archive. ``payloads`` has every distinct payload once, under its SHA-256. ``headers``
has one row per record with the exact bytes of its header block and the digest of its payload. The
original record is the join of both. A second digest and the length are compared when payloads are
stored, and the digest is computed anew from the stored bytes when records are read back.

Among records with equal payloads of at least ``min_bytes`` that with the largest id is the response and
the others revisit it; records with smaller payloads are all responses.

Defined cases: a null payload counts as empty; a null id sorts below all others and is written as an
empty id; of repeated ids the first by target and row hash is the response, and fully equal rows share
its role; null targets are written as empty; an empty table makes an empty archive; other columns
are not read.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.session import cut_lineage, scratch_folder, tidy_shuffles

# The base-32 alphabet and the names that the archive format prescribes.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"
#: Signs that some reader takes for the end of a line.
_LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: five hex digits give four letters."""
    digits = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(_BASE32), place, F.lit(1)))
    return F.concat(*letters)


def _digested(pages: DataFrame, id_column: str, target_column: str, payload_column: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.coalesce(F.col(target_column).cast("string"), F.lit("")).alias("target"),
        payload.alias("payload"),
    )
    return rows.withColumn("strong", F.sha2("payload", 256))


def _header(kind: Column, date: str) -> Column:
    """Header block of a record, up to and with the empty line."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    # A target cannot hold what ends a line anywhere; it is percent-encoded.
    target = F.col("target")
    for sign in _LINE_ENDS:
        target = F.replace(target, F.lit(sign), F.lit("".join(f"%{byte:02X}" for byte in sign.encode())))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("weak")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: " + _REVISIT_PROFILE)),
        F.lit("Content-Type: text/html; charset=utf-8"),
        # The length of the payload in the store: a revisit carries no copy of it in its own block.
        F.concat(F.lit("WARC-Stored-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END)), "UTF-8")


def write_archive(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    id_column: str = "page_id",
    target_column: str = "url",
    payload_column: str = "html",
    date: str | None = None,
) -> None:
    """Write ``headers`` and ``payloads`` below ``folder``; no payload is moved before it is known to be new.

    ``date`` is the time of capture of all records (W3C format, UTC); without one it is the time of writing.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = _digested(pages, id_column, target_column, payload_column)
    facts = cut_lineage(
        rows.select(
            "page_id",
            "target",
            "strong",
            base32_sha1(F.col("payload")).alias("weak"),
            F.octet_length("payload").cast("long").alias("bytes"),
        ),
        tidy=True,
    )
    # Partial maxima travel, so a payload that a third of all records share costs a row per task.
    order = F.struct(F.col("page_id"), F.xxhash64("target").alias("tie"))
    holders = facts.groupBy("strong").agg(
        F.max(order).alias("holder"),
        F.count("*").alias("copies"),
        (F.min(F.struct("weak", "bytes")) != F.max(F.struct("weak", "bytes"))).alias("clash"),
    )
    holders = cut_lineage(
        holders.select(
            F.when(F.col("clash"), F.raise_error(F.lit("two payloads share one strong digest"))).otherwise(F.col("strong")).alias("strong"),
            F.col("holder.page_id").alias("holder_id"),
            F.col("holder.tie").alias("holder_tie"),
            "copies",
        ),
        tidy=True,
    )
    records = facts.join(holders, "strong")
    own = F.col("page_id").eqNullSafe(F.col("holder_id")) & (F.xxhash64("target") == F.col("holder_tie"))
    response = own | (F.col("bytes") < min_bytes)
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    records = records.withColumn("refers_to", F.when(~response, F.col("holder_id")))
    headers = records.select("page_id", F.col("strong"), _header(kind, date).alias("header"))
    # Equal digests are equal payloads, so any record brings the one copy; tasks drop what they hold twice.
    once = rows.select("strong", "payload").dropDuplicates(["strong"])
    # The shuffled payloads go once they are stored: reading shuffles them again, and both need not be on disk at a time.
    with tidy_shuffles(pages.sparkSession):
        headers.write.parquet(f"{folder}/headers")
        once.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Original records: ``page_id``, ``header``, ``payload``, ``strong``; a damaged payload is an error."""
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("strong"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not have digest "), F.col("strong"))).cast("binary")
    )
    checked = payloads.select("strong", sound.alias("payload"))
    return headers.join(checked, "strong").select("page_id", "header", "payload", "strong")


def record_bytes(archive: DataFrame) -> DataFrame:
    """``page_id`` and the exact ``record``: header block, block (empty for revisits) and the two line ends."""
    block = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    end = F.encode(F.lit(_END + _END), "UTF-8")
    return archive.select("page_id", F.concat(F.col("header"), block, end).alias("record"))


def _field(name: str) -> Column:
    """A header field: a line starts after the format's own line end and nowhere else."""
    found = F.regexp_extract(F.decode(F.col("header"), "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), "<urn:page:(-?[0-9]+)>", 1).try_cast("long")


def record_facts(archive: DataFrame) -> DataFrame:
    """What the records say, read from header bytes and stored payloads."""
    stored = F.octet_length("payload").cast("long")
    length = F.when(_field("WARC-Stored-Length").cast("long") == stored, stored).otherwise(
        F.raise_error(F.lit("a record's length is not that of its payload")).cast("long")
    )
    return archive.select(
        _page("WARC-Record-ID").alias("page_id"),
        length.alias("payload_bytes"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
    )


def export_warc(archive: DataFrame, folder: str) -> None:
    """Plain WARC files: one text line per record, ended by the two line ends of the format."""
    text = F.decode(F.concat(F.col("header"), F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))), "UTF-8")
    archive.select(text.alias("value")).write.option("lineSep", _END + _END).text(folder)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write an archive of the pages to the shared folder and return the facts of the records read back."""
    spark = pages.sparkSession
    folder = f"{scratch_folder(spark)}/tunelake/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder, min_bytes)
    return record_facts(read_archive(spark, folder))
