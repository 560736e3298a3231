"""Content-addressed web archive: payloads once, record headers apart, records by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, spread

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: eight digits for every ten."""
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def write_archive(pages: DataFrame, scratch: Scratch, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write ``pages(page_id, url, html)`` as two tables; returns (payloads, headers).

    ``payloads`` has a row per distinct payload: address (SHA-256), sha1 (base
    32), n_bytes and the payload. ``headers`` has a row per page: page_id,
    address and the record's exact header block. Payloads are compared byte by
    byte when they are grouped, and copies are combined before the shuffle.
    Of records with equal payloads of ``least_bytes`` or more, the one with the
    smallest page_id is the response (one of them, if rows repeat), and the
    others are revisits that refer to it.

    A null html is an empty payload. A null page_id sorts last and is written
    without a number. Line ends in URLs are percent-encoded; a null URL has no
    header line. Extra columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    groups = base.groupBy("payload").agg(F.min("page_id").alias("first_id"))
    payloads = scratch.keep(
        groups.select(F.sha2("payload", 256).alias("address"), base32_of_hex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), "first_id", "payload"),
        "payloads",
    )
    known = spread(payloads.select("address", "sha1", "n_bytes", "first_id"))
    rows = base.select("page_id", "url", F.sha2("payload", 256).alias("address")).withColumn(
        "copy", F.row_number().over(Window.partitionBy("page_id", "address").orderBy("url"))
    )
    rows = rows.join(known, "address")
    first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)
    response = first | (F.col("n_bytes") < least_bytes)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def name(col: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(col).cast("string"), F.lit("")), F.lit(">"))

    header = F.concat_ws(
        _EOL,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name("first_id"))),
        F.when(response, F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("n_bytes")).otherwise(0).cast("string")),
        F.lit(_EOL),
    )
    headers = scratch.keep(rows.select("page_id", "address", header.alias("header")), "headers")
    return payloads.drop("first_id"), headers


def records(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """page_id and record: the original WARC bytes, header block, payload (of responses) and the closing blank lines.

    Only headers of responses meet payloads, and of equal payloads of
    ``least_bytes`` or more just one header does.
    """
    response = F.col("header").contains(f"{_EOL}WARC-Type: response{_EOL}")

    def record(*body) -> Column:
        return F.concat(F.encode("header", "UTF-8"), *body, F.lit((_EOL * 2).encode())).alias("record")

    full = headers.where(response).join(payloads.select("address", "payload"), "address").select("page_id", record("payload"))
    return full.unionByName(headers.where(~response).select("page_id", record()))


def read_records(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each of ``records(record)``, from its bytes alone.

    The header block ends at the first blank line. A response's body is cut out
    by its Content-Length and digested anew; reading fails if the digest in the
    header is another, or if the record does not end behind the body. A revisit
    has the length and digest of the response it refers to, and reading fails
    if its header names another digest.
    """
    block = F.substring_index(F.decode("record", "UTF-8"), _EOL * 2, 1)
    rows = found.select("record", F.concat(block, F.lit(_EOL)).alias("block"))

    def field(name: str, pattern: str) -> Column:
        return F.regexp_extract(F.col("block"), f"(?md)^{name}: {pattern}\r\n", 1)

    def fail(text: str) -> Column:
        return F.raise_error(F.lit(text)).cast("string")

    at, n = F.octet_length("block") + 3, field("Content-Length", "([0-9]+)").cast("int")
    body = F.substr("record", at, n)
    whole = F.octet_length("record") == F.octet_length("block") + n + 6
    rows = rows.select(
        field("WARC-Record-ID", "<urn:page:(-?[0-9]*)>").try_cast("long").alias("page_id"),
        n.cast("long").alias("payload_bytes"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        F.when(whole, field("WARC-Type", "(response|revisit)")).otherwise(fail("a record does not end behind its body")).alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]*)>").alias("refers"),
        base32_of_hex(F.sha1(body)).alias("computed"),
    )
    sound = F.when(F.col("computed") == F.col("payload_digest"), F.col("payload_digest")).otherwise(fail("a payload does not match its header"))
    full = rows.where("record_type = 'response'").select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    first = full.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("refers"), "payload_digest", F.col("payload_bytes").alias("n")).dropDuplicates(["refers", "payload_digest"])
    again = rows.where("record_type = 'revisit'").drop("payload_bytes").join(spread(first), ["refers", "payload_digest"], "left")
    known = F.when(F.col("n").isNotNull(), F.col("payload_digest")).otherwise(fail("a revisit refers to no response with its digest"))
    return full.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), known.alias("payload_digest"), "record_type", F.col("refers").try_cast("long").alias("refers_to")))


def read_archive(payloads: DataFrame, headers: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rebuild every record of an archive by joins and read it; see :func:`records` and :func:`read_records`.

    Payloads are checked against their addresses on the way.
    """
    scratch = scratch or Scratch(payloads.sparkSession, "warc")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its address")).cast("binary"))
    return read_records(scratch.keep(records(payloads.withColumn("payload", sound), headers), "records"))
