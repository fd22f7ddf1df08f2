"""Content-addressed archive of WARC records: payloads once, exact headers apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.operators.joins import hot_keys, salted_join
from pairmatch.session import work_dir, written

#: Payloads shorter than this are always stored as responses of their own.
LEAST_BYTES = 100
#: The tables have no capture time, so records carry a given one.
DATE = "2000-01-01T00:00:00Z"
END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Paths of an archive's two tables."""

    headers: str
    payloads: str


def record_uuid(*parts: Column) -> Column:
    """A name-based record id from the record's own values."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))
    pieces = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *pieces))


def header_block() -> Column:
    """The header lines of a record; line ends inside a URL are percent-coded."""
    url = F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D"))
    url = F.replace(url, F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    first = F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("X-Page-ID", number),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, line("WARC-Profile", profile)).otherwise(F.lit("")),
        F.when(revisit, line("X-Refers-To-Page-ID", first)).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line(
            "Content-Length",
            F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        ),
        F.lit(END),
    )


def field(block: str, name: str) -> Column:
    """The value of a header line, null where the line is absent."""
    found = F.regexp_extract(F.col(block), rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.instr(F.col(block), f"\r\n{name}: ") > 0, found)


def write_archive(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST_BYTES,
) -> Archive:
    """Write a record per row; each distinct payload is stored once under its SHA-256.

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest page
    id (a null id last) is the response and the others are revisits of it; of rows that agree in
    id and payload one is the response. Smaller payloads are responses throughout, still stored
    once. A null payload is empty, a null URL is written as empty, other columns are ignored; an
    empty table makes an empty archive.

    The response of each digest is chosen on narrow rows. Payloads move once, to the partition
    of their digest, and equal ones are thinned out before that, so a payload with a large part
    of all rows is no single task.
    """
    page = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    digest = F.sha2("payload", 256).alias("digest")
    rows = written(
        page.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            "url",
            digest,
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        ),
        "records",
    )
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    groups = written(
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1"),
        "repeated",
    )
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    records = salted_join(
        rows, groups, ["digest"], hot_keys(groups, ["digest"]), F.col("row"), how="left"
    ).withColumns(
        {
            "record_type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            "refers_to": F.when(revisit, F.col("first.page_id")),
            "record_id": record_uuid(F.col("page_id"), F.col("url"), F.col("row")),
        }
    )
    archive = Archive(
        work_dir(pages.sparkSession, "warc-headers"), work_dir(pages.sparkSession, "warc-payloads")
    )
    records.select("record_id", "digest", header_block().alias("header")).write.option(
        "compression", "zstd"
    ).parquet(archive.headers)
    page.groupBy(digest).agg(F.any_value("payload").alias("payload")).write.option(
        "compression", "zstd"
    ).parquet(archive.payloads)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records of an archive, rebuilt from headers and payloads, a row per record.

    Returns ``(page_id, record_type, refers_to, payload_digest, payload_bytes, header, payload,
    record)``. All but the payload is parsed from the stored header lines. ``record`` is the
    exact record: header, block and the two closing line ends; a revisit has an empty block and
    ``payload`` shows what it refers to. Every stored payload is hashed again, and one that does
    not have its digest fails the read. Columns that are not asked for are not read or moved.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    sound = F.sha2("payload", 256) == F.col("digest")
    bad = F.raise_error(F.concat(F.lit("payload without its digest: "), "digest"))
    stored = payloads.select(
        "digest",
        "payload",
        F.when(sound, F.octet_length("payload").cast("long")).otherwise(bad.cast("long")).alias("payload_bytes"),
    )
    headers = spark.read.schema("record_id string, digest string, header string").parquet(
        archive.headers
    )
    named = headers.select(
        "record_id",
        "header",
        F.substring_index(field("header", "WARC-Payload-Digest"), ":", -1).alias("digest"),
        F.nullif(field("header", "X-Page-ID"), F.lit("null")).cast("long").alias("page_id"),
        field("header", "WARC-Type").alias("record_type"),
        F.nullif(field("header", "X-Refers-To-Page-ID"), F.lit("null")).cast("long").alias("refers_to"),
    )
    counts = headers.groupBy("digest").agg(F.count("*").alias("n"))
    found = salted_join(
        named, stored, ["digest"], hot_keys(counts, ["digest"]), F.col("record_id"), how="left"
    )
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit(END * 2).cast("binary")
    return found.select(
        "page_id",
        "record_type",
        "refers_to",
        F.col("digest").alias("payload_digest"),
        "payload_bytes",
        "header",
        "payload",
        F.concat(F.col("header").cast("binary"), block, end).alias("record"),
    )
