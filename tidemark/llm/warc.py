"""Web archives: records are written to files, read again, and put together as transactions.

Each capture is a request, a response (or a revisit of an equal payload) and a metadata record. Request and
metadata name the capture's record in WARC-Concurrent-To; the reader joins them on that identifier
and gives one nested row per capture.

Files are written by Spark's text writer, whose line separator is the blank lines that end a record, and read by its
binary reader, so any store that Spark knows will do. The reader follows Content-Length, never separators.

Defined results: a null html is an empty payload; line breaks in a URL are percent-encoded; a null URL is
empty; among equal payloads the rows with the largest page_id are responses (all of them, if a page_id is
repeated) and the others revisit it; rows without page_id revisit too unless no copy has one; an empty
table gives no rows; other columns are ignored. A record that has several requests or metadata records
keeps the one with the least identifier, and their number; a capture without one has null there and 0.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, shared_folder, written

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, digest string, http string, fields string, payload_bytes long, payload binary, intact boolean"
CRLF = "\r\n"
#: A file is read as one value, which holds 2 GB at most.
FILE_BYTES = 64_000_000


def base32_sha1(raw: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four of base 32."""
    hexa = F.sha1(raw)
    parts = [F.lpad(F.conv(F.substring(hexa, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _record(kind: str | Column, ident: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record but the blank lines at its end. A null header is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit(f"{VERSION}{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <"), ident, F.lit(f">{CRLF}WARC-Date: {DATE}")]
    for name, value in headers:
        head.append(F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit("")))
    head += [F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*head)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes three records per row of pages (page_id, url, html) as gzip files below path, of about file_bytes before compression at most."""
    size = pages.agg(F.coalesce(F.avg(F.octet_length("html")), F.lit(0.0))).first()[0] / 3 + 500
    records_per_file = max(3, int(file_bytes / size))
    raw = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), raw.alias("html"), base32_sha1(raw.cast("binary")).alias("digest"))
    # A digest with several rows has its largest page_id; the groups are counted before the shuffle, and the join may split a large one.
    first = page.select("page_id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    page = page.join(first, "digest", "left").withColumn("revisit", F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")))
    page = page.withColumn("n", F.monotonically_increasing_id())
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = F.concat(F.lit("urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    serial = F.concat(F.lit(":"), F.col("n").cast("string"))
    ident, owner = F.concat(name, serial), F.concat(F.lit("<urn:capture:"), F.col("owner").cast("string"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF + CRLF))
    near = ("WARC-Concurrent-To", F.concat(F.lit("<"), ident, F.lit(">")))
    target, digest = ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    capture = _record(kind, ident, [target, digest, ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Profile", F.when(F.col("revisit"), REVISIT_PROFILE)), ("WARC-Refers-To", F.when(F.col("revisit"), owner))], F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))))
    request = _record("request", F.concat(ident, F.lit(":request")), [target, near, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    meta = _record("metadata", F.concat(ident, F.lit(":metadata")), [target, near, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    records = page.select(F.explode(F.array(request, capture, meta)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records(stream: io.BufferedIOBase, payloads: bool, kinds: tuple[str, ...] | None) -> Iterator[tuple]:
    """The records of one archive, in the columns of RECORD."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError("a record ends early")
        kind = head["warc-type"]
        if kinds and kind not in kinds:
            continue
        bare = lambda name: head[name].strip("<>") if name in head else None
        http, fields, body, size, intact = None, None, None, None, True
        if head.get("content-type", "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http, size = top.decode("utf-8", "replace"), len(body)
            if kind == "revisit":  # the payload isn't repeated; its length is in the headers kept
                size = next((int(x.partition(":")[2]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), None)
                body = None
        else:
            fields = block.decode("utf-8", "replace")
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response" and digest:
            intact = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
        yield kind, bare("warc-record-id"), bare("warc-concurrent-to"), bare("warc-refers-to"), head.get("warc-target-uri"), digest, http, fields, size, body if payloads else None, intact


def read_archives(spark: SparkSession, path: str, payloads: bool = True, kinds: tuple[str, ...] | None = None, batch: int = 2000) -> DataFrame:
    """All records (or those of some kinds) of the gzip or plain archives below path."""

    @giving_back
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                out = []
                for row in records(stream, payloads, kinds):
                    out.append(row)
                    if len(out) >= batch:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def assemble(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per capture: struct columns response, request and metadata, and how many requests and metadatas there are.

    The archives are read once. Records meet under the identifier of their capture: a response's own, and the one that a request or
    metadata record is concurrent to. Responses come by a join, so that payloads aren't aggregated; records about a capture that isn't there are left out.
    """
    every = read_archives(spark, path, payloads)
    capture = F.when(F.col("type").isin("response", "revisit"), F.col("id")).otherwise(F.col("concurrent_to"))
    every = written(every.withColumn("_id", capture))
    response = every.where("type IN ('response', 'revisit')").select("_id", F.struct("id", "type", "uri", "refers_to", "digest", "payload_bytes", "http", "payload", "intact").alias("response"))
    kinds = {"request": ("uri", "http"), "metadata": ("fields",)}
    found = []
    for kind, cols in kinds.items():
        mine = F.col("type") == kind
        found += [F.min(F.when(mine, F.struct("id", *cols))).alias(kind), F.count_if(mine).alias(f"{kind}s")]
    about = every.where(F.col("type").isin(*kinds) & F.col("_id").isNotNull()).groupBy("_id").agg(*found)
    counted = {f"{kind}s": F.coalesce(f"{kind}s", F.lit(0).cast("long")) for kind in kinds}
    return response.join(about, "_id", "left").withColumns(counted).select("response", "request", "requests", "metadata", "metadatas")


def captures(pages: DataFrame, path: str | None = None, payloads: bool = False) -> DataFrame:
    """Writes archives for pages and gives the assembled captures read from them."""
    path = path or shared_folder(pages.sparkSession)
    write_archives(pages, path)
    return assemble(pages.sparkSession, path, payloads)
