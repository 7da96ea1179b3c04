"""Shared pieces: words, written intermediate tables, global order, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bits that monotonically_increasing_id() gives to the place within a partition.
PLACE_BITS = 33


def words(text: Column | str) -> Column:
    """The words of a text as an array; null gives an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row."""
    return F.transform(F.array(value), body)[0]


def free(taken: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column."""
    used, out = {c.lower() for c in taken.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same, but a task's Python worker, which Spark keeps for later tasks, returns freed memory to the system at the end."""

    def wrapped(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    It is spark.checkpoint.dir where that is set. Only a local master, whose executors are the driver's
    own threads, falls back to the temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_table(df: DataFrame) -> None:
    """Removes what written() wrote for this frame, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: the lineage ends there and any executor may go."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Adds _rank, the place of each row in the order of the keys, from 0 and without gaps.

    Rows are dealt out by range and written once, so the places stay fixed if a task runs again. The
    table of offsets has a row for each partition.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", PLACE_BITS)).withColumn("_at", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1))
    return dealt.join(F.broadcast(offsets(dealt, F.count(F.lit(1)), "_before")), "_part").withColumn("_rank", F.col("_before") + F.col("_at")).drop("_before")


def offsets(dealt: DataFrame, total: Column, name: str) -> DataFrame:
    """The running total before each partition of a frame with _part: as many rows as partitions."""
    sums = sorted(dealt.groupBy("_part").agg(total.alias("n")).coalesce(1).collect())
    out, before = [], 0
    for part, n in sums:
        out.append((part, before))
        before += n
    return dealt.sparkSession.createDataFrame(out, f"_part long, {name} long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): rows (node, component), component the least node.

    Alternating large-star and small-star steps. Each step is a minimum that is combined before the
    shuffle and an inner join whose large partitions Spark may split; its rows are written to the shared
    folder, and the loop ends when the links no longer change.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = written(small.where("a <> b").distinct())
        drop_table(large)
        drop_table(edges)
        edges = new
        before, state = state, edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
