"""Scans and sinks: projected story scans, footer statistics, resumable monthly shards, line corpora, JSON results."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: The columns of a story table, those that the ladder reads, and the rule for a usable row below.
STORY_COLUMNS = ("id", "type", "time", "title", "text", "score", "by", "url", "descendants")
LADDER_COLUMNS = ("id", "time", "title", "text", "score", "by", "url")
GUARD_BYTES = 15 * 10**9


def usable_story():
    """type 1, neither dead nor deleted, a title, a positive score. Written so that the parts reach the Parquet scan."""
    off = lambda c: F.col(c).isNull() | (F.col(c) == 0)
    return (F.col("type") == 1) & off("dead") & off("deleted") & F.col("title").isNotNull() & (F.col("title") != "") & (F.col("score") > 0)


def scan_stories(spark: SparkSession, paths: Sequence[str], limit: int | None = None) -> DataFrame:
    if not paths:
        raise ValueError("no paths to scan")
    found = spark.read.parquet(*paths).where(usable_story()).select(*STORY_COLUMNS).withColumn("time", F.col("time").cast("timestamp")).orderBy("time", "id")
    return found if limit is None else found.limit(limit)


def read_ladder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*LADDER_COLUMNS)


def footer_sizes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Compressed bytes of each top-level column, from the footers alone, largest first."""

    def sizes(frames: Iterable[pd.DataFrame]):
        import pyarrow.parquet as pq

        for frame in frames:
            out = []
            for path in frame["path"]:
                meta = pq.ParquetFile(path).metadata
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        x = meta.row_group(g).column(c)
                        out.append((x.path_in_schema.removesuffix(".list.element"), x.total_compressed_size))
            yield pd.DataFrame(out, columns=["column_name", "compressed_bytes"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(sizes, "column_name string, compressed_bytes long").groupBy("column_name").agg(F.sum("compressed_bytes").alias("compressed_bytes")).orderBy(F.desc("compressed_bytes"), "column_name")


def guard_projection(sizes: DataFrame, columns: Sequence[str], most: int = GUARD_BYTES) -> int:
    """The bytes of a projection; an error above the guard."""
    total = sizes.where(F.col("column_name").isin(*columns)).agg(F.coalesce(F.sum("compressed_bytes"), F.lit(0))).first()[0]
    if total > most:
        raise ValueError(f"the projection reads {total} bytes; the guard is {most}")
    return total


def months_of(df: DataFrame) -> DataFrame:
    """Distinct YYYY-MM in the names of a frame's files."""
    name = F.regexp_extract("_metadata.file_path", r"(\d{4}-\d{2})\.parquet$", 1)
    return df.select(name.alias("month")).where("month <> ''").distinct().orderBy("month")


def rows_scanned(commits: DataFrame) -> int:
    """The rows that the commits count together."""
    return commits.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_shards(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """The paths of the shards in a folder, by name; none if there is no such folder. Any store that Spark knows will do."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    return sorted((s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().endswith(suffix)), key=lambda x: x.rsplit("/", 1)[-1])


def is_current(spark: SparkSession, path: str, required: Sequence[str] = STORY_COLUMNS) -> bool:
    """Whether a shard is there, can be read and has every required column."""
    from pyspark.errors import AnalysisException

    try:
        return set(required) <= set(spark.read.parquet(path).columns)
    except AnalysisException:  # no such path, or nothing that is Parquet
        return False


def copy_shard(spark: SparkSession, source: str, target: str) -> bool:
    """The usable rows of a month as one zstd shard, under its name only when whole. A shard that is current stays; says whether it was written."""
    if is_current(spark, target):
        return False
    fs, path = _files(spark, target)
    part = spark._jvm.org.apache.hadoop.fs.Path(target + ".part")
    scan_stories(spark, [source]).write.mode("overwrite").option("compression", "zstd").parquet(target + ".part")
    fs.delete(path, True)
    if not fs.rename(part, path):
        raise OSError(f"{target} could not be put in place")
    return True


def pull_months(spark: SparkSession, sources: Sequence[str], folder: str) -> list[str]:
    """Copies monthly files in the order of their names and resumes where an earlier run ended; gives the shards written now."""
    done = []
    for source in sorted(sources, key=lambda x: x.rsplit("/", 1)[-1]):
        target = f"{folder.rstrip('/')}/{source.rsplit('/', 1)[-1]}"
        if copy_shard(spark, source, target):
            done.append(target)
    return done


def merge_shards(spark: SparkSession, folder: str, months: Sequence[str], target: str) -> dict:
    """All months as one table in the order of time and id, and its report; an error names the months whose shard isn't there.

    The table's files are ranges in order, so it is sorted as a whole and no task holds all of it.
    """
    there = {x.rsplit("/", 1)[-1].removesuffix(".parquet") for x in list_shards(spark, folder)}
    if missing := [m for m in months if m not in there]:
        raise FileNotFoundError(f"no shard for {', '.join(missing)}")
    shards = spark.read.parquet(*[f"{folder.rstrip('/')}/{m}.parquet" for m in months])
    shards.orderBy("time", "id").write.mode("overwrite").option("compression", "zstd").parquet(target)
    return ingest_report(spark.read.parquet(target), shards.count())


def summary(report: dict) -> str:
    share = "no rows scanned" if report["keep_rate"] is None else f"{report['keep_rate']:.2%} of {report['scanned']:,} kept"
    return f"{report['stories']:,} rows from {report['first']} to {report['last']}, {share}"


def write_months(stories: DataFrame, path: str) -> None:
    """zstd Parquet by month; months present in the frame replace what is there, others stay."""
    month = F.date_format("time", "yyyy-MM")
    stories.withColumn("month", month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(path)


def ingest_report(stories: DataFrame, scanned: int) -> dict:
    row = stories.agg(F.count(F.lit(1)).alias("n"), F.min("time"), F.max("time")).first()
    return {"stories": row[0], "scanned": scanned, "first": row[1], "last": row[2], "keep_rate": row[0] / scanned if scanned else None}


def commit_times(spark: SparkSession, path: str) -> DataFrame:
    """month and commit time from the CSV of commits."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.format_string("%d-%02d", F.col("year").cast("int"), F.col("month").cast("int")).alias("month"), F.to_timestamp("committed_at").alias("committed_at"), F.col("count").cast("long").alias("count"))


def list_words(df: DataFrame, column: str = "words", month: str | None = None, time: str = "time") -> DataFrame:
    """Rows with a filled list, of one month (YYYY-MM) or of all."""
    filled = df.where(F.size(column) > 0)
    return filled if month is None else filled.where(F.date_format(time, "yyyy-MM") == month)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_id and the blank-separated tokens of each line; empty lines go."""
    rows = spark.read.text(path).withColumn("line_id", F.monotonically_increasing_id())
    return rows.select("line_id", F.filter(F.split("value", r"(?U)\s+"), lambda t: t != "").alias("tokens")).where("size(tokens) > 0")


def text_chunks(text: str, size: int = 1 << 20) -> list[str]:
    """One long line cut at the last blank within each size characters; a cut ends a context."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text) and (cut := text.rfind(" ", at, end)) > at:
            end = cut
        if part := text[at:end].strip():
            out.append(part)
        at = end
    return out


def read_text8(spark: SparkSession, path: str, size: int = 1 << 20) -> DataFrame:
    """line_id and tokens of files that are one long line each: a chunk is a line. A file is read as one value, which holds 2 GB at most."""

    def chunks(frames: Iterable[pd.DataFrame]):
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame({"value": text_chunks(bytes(content).decode("utf-8", "replace"), size)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(chunks, "value string")
    return rows.select(F.monotonically_increasing_id().alias("line_id"), F.filter(F.split("value", r"(?U)\s+"), lambda t: t != "").alias("tokens")).where("size(tokens) > 0")


def _budgeted(lines: DataFrame, most: int | None) -> DataFrame:
    from tidemark.operators.vocab import budget

    return lines if most is None else budget(lines, most)


def read_plain(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """line_id and tokens of each line, normalised; lines without a token go, and tokens beyond the budget."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), T.tokens(T.normalise_title(F.col("value"))).alias("tokens"))
    return _budgeted(rows.where("size(tokens) > 0"), most)


def title_body_lines(stories: DataFrame, cutoff, most: int | None = None, id_: str = "id", time: str = "time") -> DataFrame:
    """line_id and tokens: of each story before the cutoff the title's line, then the body's without markup; lines without a token go."""
    early = stories.where(F.col(time) < F.lit(cutoff).cast("timestamp"))
    texts = F.array(F.struct(F.lit(0).alias("part"), T.normalise_title(F.col("title")).alias("text")), F.struct(F.lit(1).alias("part"), F.lower(T.strip_html(F.col("text"))).alias("text")))
    rows = early.select(F.col(id_).alias("_id"), F.explode(texts).alias("x")).select((F.col("_id") * 2 + F.col("x.part")).alias("line_id"), T.tokens(F.col("x.text")).alias("tokens"))
    return _budgeted(rows.where("size(tokens) > 0"), most)


def write_corpus(lines: DataFrame, path: str) -> dict:
    """A tokenised corpus as text, one line each, in the order of line_id; gives its tokens, lines, files and bytes."""
    from tidemark.operators.vocab import corpus_totals

    spark = lines.sparkSession
    lines.orderBy("line_id").select(F.array_join("tokens", " ").alias("value")).write.mode("overwrite").text(path)
    total = corpus_totals(read_lines(spark, path)).first()
    files = file_profile(spark, path).agg(F.count(F.lit(1)), F.sum("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256)).first()
    return {"tokens": total["tokens"], "lines": total["lines"], "files": files[0], "bytes": files[1], "sha256": files[2]}


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """idx, word and count as JSON lines; at most max_size rows."""
    vocab.select("idx", "word", "count").coalesce(1).sortWithinPartitions("idx").write.mode("overwrite").json(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx long, word string, count long").json(path)


def export_articles(articles: DataFrame, path: str, least: int = 200) -> None:
    """Long texts, one document a line with white space collapsed."""
    long = articles.where(F.col("text").isNotNull() & (F.length("text") > least))
    long.select(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("value")).write.mode("overwrite").text(path)


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """bytes, sha256 and non-empty lines of each file."""
    files = spark.read.format("binaryFile").load(path)
    lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != ""))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), lines.alias("lines"))


def write_json(value: dict, path: str) -> None:
    """A JSON result, whole or not at all."""
    target = Path(path)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, default=str))
    os.replace(part, target)


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())
