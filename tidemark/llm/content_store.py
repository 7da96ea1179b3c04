"""A content-addressed store of token ids.

Files, all Parquet, below one folder:

- chunks: digest (BLAKE2b-128 of the bytes), ids (little-endian, two bytes each if the vocabulary allows, else
  four), each distinct chunk once. A rolling hash over the last SPAN ids says where a chunk ends, so equal passages give equal chunks
  wherever they stand.
- recipes: doc_id, its chunks' digests in order, their lengths, n_tokens, and the root of a Merkle tree over the digests; in ascending
  order of doc_id, with `start`, the ids of all documents before, and `rank`, its place.
- manifest: a Merkle tree over the recipes in their order, FAN children to a node, level by level up to one root; rows (level, i, hash).

Reading verifies each chunk against its address, each recipe against its root, that no chunk is missing, and the recipes against the
manifest, and fails otherwise. The CRC of a document is put together from those of its chunks, so checksums of the whole store need
no chunk to travel; `documents` gives the ids themselves.

Defined results: a null text is empty and holds the end id only; rows with an equal doc_id follow each other in
the order of their roots; rows without doc_id come first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import giving_back, in_order, offsets, shared_folder, written
from .tokens import END, crc32_joined, encoder

#: Ids that the rolling hash covers; a chunk has this many ids at least (but for a document's last), about MEAN more, and at most MOST.
SPAN, MEAN, MOST = 64, 1024, 8192
DIGEST = 16
#: Children of a node of the manifest, and ids that are cut together.
FAN, TOGETHER = 256, 500_000
#: The hash of each id, for the rolling sum: a mix of the id itself.
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def cuts(documents: list[np.ndarray]) -> list[list[int]]:
    """Where the chunks of each document end."""
    flat, sizes = np.concatenate([np.zeros(0, np.uint32), *documents]), [len(x) for x in documents]
    n = len(flat)
    x = (flat.astype(np.uint64) + np.uint64(1)) * _ROLL
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    # Each id's hash is multiplied by an odd factor to the power of its distance from the window's end.
    factor = np.uint64(0x5851F42D4C957F2D)
    powers = np.full(n + 1, factor, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    back = np.full(n + 1, pow(int(factor), -1, 2**64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(x * powers[:-1], dtype=np.uint64)])
    rolled = (sums[SPAN:] - sums[:-SPAN]) * back[: max(0, n - SPAN + 1)]
    ends = np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(MEAN) == 0) + SPAN
    upto = np.cumsum([0, *sizes])
    low, high = np.searchsorted(ends, upto[:-1] + SPAN), np.searchsorted(ends, upto[1:], "right")
    return [_ends(ends[a:b] - before, size) for a, b, before, size in zip(low.tolist(), high.tolist(), upto.tolist(), sizes, strict=False)]


def _ends(marks: np.ndarray, n: int) -> list[int]:
    """The ends of chunks in a document of n ids, from the ends of windows that mark one."""
    out, last = [], 0
    for e in marks.tolist():
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= SPAN:
            out.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed apart; a node without a partner moves up as it is."""
    level = [_digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [_digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else _digest(b"")


def _encode(path: str, blanks: bool, width: int):
    """Rows of chunks (digest, ids) and of recipes (a key of their own, doc_id, chunks, lengths). A task gives each chunk once while it remembers it."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = encoder(path, blanks), set()

        def rows(held: list[tuple]) -> pd.DataFrame:
            out = []
            for (doc, serial, ids), ends in zip(held, cuts([x[-1] for x in held]), strict=True):
                raw, names, last = ids.astype(f"<u{width}").tobytes(), [], 0
                for e in ends:
                    chunk = raw[width * last : width * e]
                    names.append(name := _digest(chunk))
                    last = e
                    if name not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(name)
                        out.append((name, chunk, None, None, None, None))
                out.append((serial.to_bytes(9, "big"), None, doc, b"".join(names), np.diff(ends, prepend=0).astype(np.int32), merkle(names)))
            made = pd.DataFrame(out, columns=["name", "ids", "doc_id", "chunks", "lengths", "root"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            return made

        try:
            for frame in frames:
                held, size = [], 0
                for doc, serial, ids in zip(frame["doc_id"], frame["serial"], own.documents(frame["text"].tolist()), strict=True):
                    held.append((doc, serial, ids))
                    size += len(ids)
                    if size >= TOGETHER:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)
        finally:
            own.clear()

    return run


def write_store(documents: DataFrame, path: str, tokenizer: str, blanks: bool, vocabulary: int) -> str:
    """Encodes all texts and writes the store below path."""
    spark = documents.sparkSession
    width = 2 if vocabulary <= 2**16 else 4
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("serial"))
    rows = docs.mapInPandas(_encode(tokenizer, blanks, width), "name binary, ids binary, doc_id long, chunks binary, lengths array<int>, root binary")
    # A recipe's name is its own (9 bytes), a chunk's its digest (16), so one pass deals out both; a chunk comes from each task once.
    rows = rows.dropDuplicates(["name"]).withColumn("kind", F.when(F.length("name") == DIGEST, "chunk").otherwise("recipe"))
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/parts")
    recipes = _parts(spark, path, "recipe").select("doc_id", "chunks", "lengths", "root", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_tokens"))
    placed = in_order(recipes, "doc_id", "root")
    before = offsets(placed, F.sum("n_tokens"), "_ids")
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(F.broadcast(before), "_part").withColumn("start", F.col("_ids") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed.select("doc_id", "start", "n_tokens", "chunks", "lengths", "root", F.col("_rank").alias("rank"), "_part", "_at").sortWithinPartitions("_part", "_at").drop("_part", "_at").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark, path).write.parquet(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The tree over the recipes as they are now: level 0 has a node for each FAN recipes, the last level one node. A task hashes FAN children of a node at a time."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "start", "n_tokens")]
    level = spark.read.parquet(f"{path}/recipes").select(F.col("rank").alias("i"), F.sha2(F.concat_ws("|", F.lit("leaf"), *fields, F.hex("root"), F.hex("chunks")), 256).alias("hash"))
    out, number, last = None, 0, None
    while last is None or last > 1:
        children = F.array_sort(F.collect_list(F.struct("i", "hash")))
        above = level.groupBy(F.floor(F.col("i") / FAN).cast("long").alias("node")).agg(F.sha2(F.concat(F.lit("node"), F.array_join(F.transform(children, lambda x: x["hash"]), "|")), 256).alias("hash"))
        level = written(above.select(F.lit(number).alias("level"), F.col("node").alias("i"), "hash"))
        out, last, number = level if out is None else out.unionAll(level), level.count(), number + 1
    return out


def _parts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = "name binary, ids binary, doc_id long, chunks binary, lengths array<int>, root binary, kind string"
    return spark.read.schema(schema).parquet(f"{path}/parts").where(F.col("kind") == kind)


def _check_chunks(width: int):
    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, raw in zip(frame["name"], frame["ids"], strict=True):
                if _digest(raw) != name:
                    raise ValueError(f"chunk {bytes(name).hex()} does not match its address")
                ids = np.frombuffer(raw, f"<u{width}")
                out.append((name, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pd.DataFrame(out, columns=["name", "n", "crc"])

    return run


@giving_back
def _join_crcs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From each document's verified chunks, in order: the root again and the CRC of the whole."""
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            chunks = sorted(row.found, key=lambda x: x["i"])
            if any(pd.isna(x["n"]) for x in chunks):
                raise ValueError(f"chunks of document {row.doc_id} are missing")
            names = [bytes(x["name"]) for x in chunks]
            if merkle(names) != bytes(row.root) or sum(x["n"] for x in chunks) != row.n_tokens:
                raise ValueError(f"document {row.doc_id} does not match its recipe")
            crc = 0
            for x in chunks:
                crc = crc32_joined(crc, int(x["crc"]), 4 * int(x["n"]))  # a null beside them makes floats
            out.append((row.doc_id, row.start, row.n_tokens, crc))
        made = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
        made["doc_id"] = made["doc_id"].astype("Int64")
        yield made


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    n = (F.length("chunks") / DIGEST).cast("int")
    names = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("chunks"), i * DIGEST + 1, F.lit(DIGEST)).alias("name")))
    return spark.read.parquet(f"{path}/recipes").withColumn("names", names)


def check_manifest(spark: SparkSession, path: str) -> None:
    """Fails if the recipes do not match the manifest."""
    said, now = spark.read.parquet(f"{path}/manifest"), manifest(spark, path).withColumnRenamed("hash", "now")
    if said.join(now, ["level", "i"], "full").where("NOT hash <=> now").limit(1).count():
        raise ValueError("the recipes do not match the manifest")


def checksums(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    check_manifest(spark, path)
    width = 2 if vocabulary <= 2**16 else 4
    chunks = _parts(spark, path, "chunk").select("name", "ids").mapInPandas(_check_chunks(width), "name binary, n int, crc long")
    uses = _recipes(spark, path).select("start", F.explode("names").alias("x")).select("start", "x.i", "x.name")
    found = uses.join(chunks, "name", "left").groupBy("start").agg(F.collect_list(F.struct("i", "name", "n", "crc")).alias("found"))
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "root")
    return recipes.join(found, "start").mapInPandas(_join_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, start and ids (array of int) of every document, put together from its chunks."""
    width = 2 if vocabulary <= 2**16 else 4
    uses = _recipes(spark, path).select("doc_id", "start", F.explode("names").alias("x")).select("doc_id", "start", "x.i", "x.name")
    found = uses.join(_parts(spark, path, "chunk").select("name", "ids"), "name", "left").groupBy("start").agg(F.any_value("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("found"))

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if any(x["ids"] is None for f in frame["found"] for x in f):
                raise ValueError("chunks are missing")
            ids = [np.concatenate([np.frombuffer(x["ids"], f"<u{width}") for x in f]).astype(np.int32) for f in frame["found"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "start": frame["start"], "ids": ids})

    return found.mapInPandas(run, "doc_id long, start long, ids array<int>")


def store_report(docs: DataFrame, tokenizer: str, blanks: bool = True, vocabulary: int = 50_257) -> DataFrame:
    path = shared_folder(docs.sparkSession)
    write_store(docs, path, tokenizer, blanks, vocabulary)
    return checksums(docs.sparkSession, path, vocabulary)
