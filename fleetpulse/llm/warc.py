"""WARC archives: write records, and read them back by boundary-chain verification.

Writing: one part file is one archive (gzip by default). A record's payload is the page's text in UTF-8; of the
records with equal payloads of at least `min_bytes` bytes one is a response and the others are revisits that name it.

Reading: archives are read like any text file, with the magic as separator (plain ones in byte ranges). Each piece
is a candidate record; its Content-Length gives the offset where its successor must start. Pointer jumping from
offset 0 of each file keeps the candidates that the chain reaches, so that a magic inside a payload
(even a whole record) stays part of that payload.

Edge cases: a null payload counts as empty, a null URL writes no target, a null page_id an empty one, and line breaks
in a URL are percent-encoded. Of equal payloads the smallest page_id is the response (null only if there is no other);
rows that repeat both page_id and payload are one capture, and all of them are responses or all revisits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import pick
from fleetpulse.session import materialize, scratch_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


@F.pandas_udf(T.StringType())
def digest(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Base32 SHA-1 of each payload."""
    for part in payloads:
        yield part.map(lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode())


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, first: what to write for each row; first is the response's page_id for a revisit.

    Only payloads that occur again are joined with, so the pages themselves need no exchange while these are few.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("digest", digest(F.encode("html", "UTF-8")))
    again = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many"))
    again = materialize(again.filter("many > 1").select("digest", "first"), "warc-again")
    joined = rows.join(again, "digest", "left")
    return joined.withColumn("first", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def record_text(records: DataFrame) -> DataFrame:
    """The records as text, without the closing blank lines, which the writer adds."""

    def line(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def name_of(page_id):
        return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))

    revisit = F.col("first").isNotNull()
    payload = F.when(revisit, "").otherwise(F.col("html"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    headers = [
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(name_of(F.col("page_id")), F.concat(F.lit("<urn:page::"), F.col("digest"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", name_of(F.col("first"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(payload).cast("string")),
    ]
    return records.select(F.concat(F.lit(MAGIC), *headers, F.lit("\r\n"), payload).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write one archive for each task; the closing blank lines of records are the writer's line separator."""
    record_text(plan_records(pages, min_bytes)).write.option("lineSep", END).option("compression", compression).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """piece, file, at, next, head, value: the text after each magic, its offset and where its successor must start."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.monotonically_increasing_id().alias("piece"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.octet_length("value").alias("bytes"),
        F.octet_length(F.substring_index("value", END, 1)).alias("head"),
        F.regexp_extract(F.substring_index("value", END, 1), r"(?mi)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1).alias("length"),
    )
    return materialize(raw, "warc-pieces")


def offsets(pieces: DataFrame) -> DataFrame:
    """piece, file, at, next: narrow rows. Pieces of a block are in reading order; blocks add up per file."""
    narrow = pieces.select("piece", "file", "block", "bytes", "head", "length")
    blocks = narrow.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("before", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(inside), F.lit(0)))
    at = F.col("base") + F.col("before") - len(MAGIC)  # of the magic before the piece
    after = at + len(MAGIC) + F.col("head") + len(END) + F.expr("try_cast(length AS bigint)") + len(END)
    return placed.join(blocks, ["file", "block"]).select("piece", "file", at.alias("at"), after.alias("next"))


def reachable(links: DataFrame) -> DataFrame:
    """Candidates (file, at) that the chain from offset 0 of their file reaches, by pointer jumping.

    After round k every row points 2^k records ahead and the first 2^k records of a file are marked, so the
    number of rounds is the logarithm of the longest chain. Each round is written to the shared folder.
    """
    state = materialize(links.filter("at >= 0").select("file", "at", "next", (F.col("at") == 0).alias("reached")), "warc-chain")
    count = state.filter("reached").count()
    while True:
        ahead = state.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        marks = state.filter("reached AND next IS NOT NULL").select("file", F.col("next").alias("at"), F.lit(True).alias("mark"))
        moved = state.join(ahead, ["file", "next"], "left").join(marks, ["file", "at"], "left")
        state = materialize(
            moved.select("file", "at", F.col("beyond").alias("next"), (F.col("reached") | F.coalesce("mark", F.lit(False))).alias("reached")),
            "warc-chain",
        )
        grown = state.filter("reached").count()
        if grown == count:
            return state.filter("reached").select("file", "at")
        count = grown


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, at, header, payload (binary) of every record that the chain of its file reaches."""
    pieces = candidates(spark, path)
    places = materialize(offsets(pieces), "warc-offsets").filter("at >= 0")
    kept = reachable(places.select("file", "at", "next")).withColumn("kept", F.lit(True))
    places = places.join(kept, ["file", "at"], "left").select("piece", "file", "at", "next", F.coalesce("kept", F.lit(False)).alias("kept"))
    # a piece that is not kept lies inside the record of the last kept one before it
    stray = places.filter("NOT kept").select("piece", "file", "at", F.floor(F.col("at") / (1 << 16)).alias("cell"))
    owners = _owners(stray, places.filter("kept"))
    own = places.filter("kept").select("piece", "file", "at", F.col("piece").alias("owner"))
    parts = pieces.select("piece", "value", "head", "length").join(own.unionByName(owners), "piece")
    several = owners.select("owner").distinct().withColumn("several", F.lit(True))
    parts = parts.join(several, "owner", "left")
    alone = parts.filter("several IS NULL").select("file", "at", "value", "head", "length")
    in_order = F.array_sort(F.collect_list(F.struct("at", "file", "value", "head", "length")))
    joined = parts.filter("several").groupBy("owner").agg(in_order.alias("p")).select(
        F.expr("p[0].file").alias("file"), F.expr("p[0].at").alias("at"),
        F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"),
        F.expr("p[0].head").alias("head"), F.expr("p[0].length").alias("length"),
    )
    body = F.substring(F.encode("value", "UTF-8"), F.col("head") + len(END) + 1, F.expr("cast(length AS int)"))
    return alone.unionByName(joined).select("file", "at", F.substring_index("value", END, 1).alias("header"), body.alias("payload"))


def _owners(stray: DataFrame, kept: DataFrame) -> DataFrame:
    """piece, file, at, owner: the kept record whose range [at, next) holds the stray piece's offset.

    Ranges meet offsets by 64 kB cells of the file, so the join is on equal keys.
    """
    cells = kept.filter("next IS NOT NULL").select(
        "file", F.col("piece").alias("owner"), F.col("at").alias("start"), "next",
        F.explode(F.sequence(F.floor(F.col("at") / (1 << 16)), F.floor((F.col("next") - 1) / (1 << 16)))).alias("cell"),
    )
    found = stray.join(cells, ["file", "cell"]).filter("at > start AND at < next")
    return found.select("piece", "file", "at", "owner")


def parse(records: DataFrame) -> DataFrame:
    """page_id, record_type, url, digest, refers_to (page_id), payload from header and payload."""

    def field(name, pattern):
        return F.nullif(F.regexp_extract("header", rf"(?mi)^{name}:[ \t]*{pattern}\r?$", 1), F.lit(""))

    return records.select(
        field("WARC-Record-ID", r"<urn:page:(-?\d+):\w+>").cast("long").alias("page_id"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        field("WARC-Payload-Digest", r"sha1:(\w+)").alias("digest"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+):\w+>").cast("long").alias("refers_to"),
        "payload",
    )


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0, compression: str = "gzip") -> DataFrame:
    """Write pages to archives, read them, and describe each record by its full payload.

    page_id, payload_bytes, payload_digest, record_type, refers_to; the payload of a revisit is that of the
    response it names, and every digest is worked out anew from the bytes read.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes, compression)
    read = parse(read_archives(spark, path)).select(
        "page_id", "record_type", "digest", "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"), digest("payload").alias("payload_digest"),
    )
    read = materialize(read, "warc-read")
    full = read.filter("record_type = 'response'")
    revisits = read.filter("record_type = 'revisit'").select("page_id", "record_type", "digest", "refers_to")
    named = full.select(F.col("page_id").alias("refers_to"), "digest", "payload_bytes", "payload_digest").distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select(columns).unionByName(revisits.join(named, ["refers_to", "digest"], "left").select(columns))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(d.h, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f ON d.h = f.h
"""
