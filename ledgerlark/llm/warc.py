"""WARC archives: write one record per page, read them back by boundary chains.

A record's start is a line ``WARC/1.0``, and so may be a line of any payload. Reading tasks take every such line for a candidate and
work out where its record would end; only candidates that a chain of record ends reaches from the file's start are records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import shared_folder
from .common import durable

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Most records in a file; a chain takes the logarithm of it in rounds.
RECORDS = 1000


def base32_sha1(column: str):
    """Upper-case base32 of SHA-1: 160 bits are eight groups of five hex digits, each four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(F.encode(column, "UTF-8")), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, type, refers_to``: of equal payloads of at least ``least`` bytes, the largest page_id responds."""
    full = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    full = full.withColumn("digest", base32_sha1("payload"))
    first = full.groupBy("digest").agg(F.max("page_id").alias("first"))
    joined = full.join(first, "digest")
    other = (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, "revisit").otherwise("response").alias("type"), F.when(other, F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Archive files in ``folder``; a revisit keeps its headers and not the payload. Spark's text writer ends each record."""
    body = F.when(F.col("type") == "response", F.col("payload")).otherwise("")

    def header(name: str, *value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n")), F.lit(""))

    text = F.concat(
        F.lit(MAGIC), header("WARC-Type", F.col("type")), header("WARC-Record-ID", F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), header("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        header("WARC-Refers-To", F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        header("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)
    writer = records.select(text.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS)
    writer.option("compression", compression).text(folder)


def _placed(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines that follow a magic, with the magic's offset ``at`` and the line's end ``stop``.

    A file was cut at every magic, so each of its bytes is in one line or one magic and lengths add up to offsets. A file is
    written with at most ``RECORDS`` records; archives of others are as long as one file may be.
    """
    before = F.sum(F.col("bytes") + len(MAGIC)).over(W.partitionBy("file").orderBy("block", "nth").rowsBetween(W.unboundedPreceding, -1))
    placed = lines.withColumn("at", F.coalesce(before, F.lit(0)) - len(MAGIC)).where("at >= 0")  # not what stands before the first magic
    return placed.select("file", "at", (F.col("at") + len(MAGIC) + F.col("bytes")).alias("stop"), *keep)


def chained(candidates: DataFrame) -> DataFrame:
    """The candidates ``(file, at, next, ...)`` that are reached from offset 0 of their file, by pointer jumping.

    Each round doubles the jumps: what is reached jumps, then every jump is followed by the next one. Rounds end when no
    candidate is new, after the logarithm of a file's records; nothing is looked at that no chain from the start meets.
    """
    jumps = durable(candidates.where("next > at").select("file", "at", "next"))
    reached = durable(candidates.where("at = 0").select("file", "at"))
    n = reached.count()
    while n:
        more = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        real = candidates.select("file", "at")
        reached = durable(reached.union(more.join(real, ["file", "at"], "left_semi")).distinct())
        now = reached.count()
        if now == n:
            break
        n = now
        ahead = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = durable(jumps.join(ahead, ["file", "next"]).select("file", "at", F.col("then").alias("next")))
    return candidates.join(reached, ["file", "at"])


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``file, at, headers, payload_bytes, payload_digest`` of each record in the archives of ``folder``.

    Spark's own reader cuts the files at the magic, in splits where they are not compressed. Each task works out what a record
    starting at each magic would hold and where it would end, and payloads stay where they are read. Only files with a record
    that runs over a later magic are read again, and its lines put together. Files that are no archives give nothing.
    """
    head = F.substring_index("value", END, 1)
    lines = spark.read.option("lineSep", MAGIC).text(folder).select(
        "value", F.octet_length("value").alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), head.alias("headers"))
    content = F.expr(r"try_cast(nullif(regexp_extract(headers, r'(?:^|\r\n)Content-Length: (\d{1,18})(?:\r\n|$)', 1), '') AS long)")
    payload = F.expr(f"substr(value, length(headers) + {len(END) + 1}, length(value) - length(headers) - {2 * len(END)})")
    small = lines.select("file", "block", "nth", "bytes", "headers", F.octet_length("headers").alias("head"), content.alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    found = _placed(small, "headers", "head", "payload_bytes", "payload_digest")
    found = durable(found.withColumn("next", F.col("at") + F.col("head") + F.col("payload_bytes") + len(MAGIC) + 2 * len(END)))
    real = durable(chained(found))
    alone = real.where("next = stop").select("file", "at", "headers", "payload_bytes", "payload_digest")
    over = real.where("next > stop").select("file", F.col("at").alias("start"), F.col("next").alias("end"), F.col("headers").alias("top"), "payload_bytes")
    if over.isEmpty():
        return alone
    again = lines.join(over.select("file").distinct(), "file", "left_semi")
    parts = _placed(again, "value").join(over, "file").where("at >= start AND at < end")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), MAGIC)
    glued = parts.groupBy("file", "start", "top", "payload_bytes").agg(whole.alias("value"))
    payload = F.expr(f"substr(value, length(top) + {len(END) + 1}, length(value) - length(top) - {2 * len(END)})")
    return alone.union(glued.select("file", F.col("start").alias("at"), F.col("top").alias("headers"), "payload_bytes", base32_sha1(payload).alias("payload_digest")))


def archive_digest(pages: DataFrame, least: int = 0, compression: str = "gzip") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row of ``pages(page_id, url, html)``.

    The pages are written to new archives in the shared folder and read back; a revisit's length is that of the response it
    names. Null html is an empty payload. Rows that share a page_id and a payload are both responses if no page_id is larger.
    A null id is never the largest while another row has the payload. Other columns are not looked at.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(planned(pages, least), folder, compression)

    def header(name: str, pattern: str):
        return F.expr(rf"nullif(regexp_extract(headers, r'(?:^|\r\n){name}: {pattern}(?:\r\n|$)', 1), '')")

    back = durable(records(pages.sparkSession, folder).select(
        header("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"), "payload_bytes", header("WARC-Payload-Digest", r"sha1:(\w+)").alias("stated"),
        "payload_digest", header("WARC-Type", r"(\w+)").alias("record_type"), header("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to")))
    full = back.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    named = full.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    again = back.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("stated").alias("payload_digest"))
    again = again.join(named, ["refers_to", "payload_digest"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.union(again)
