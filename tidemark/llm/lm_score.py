"""Likelihood of documents over the subword lattice.

The pieces are those of an existing vocabulary. Their scores start from the file's ranks and are fitted to the training
documents by expectation-maximisation, over the counts of all their words: a word's probability is the sum over
all its segmentations, by forward recursion in log space, and the end of a document is a piece of its own. A document's
score is the log10 probability of its words and its end. Beside it stands an add-one unigram score of whole words.

What is learned is a table of word counts, which is distributed and grows with the corpus, and the scores of the
vocabulary's pieces, whose number the file fixes. Words that are frequent enough to be among HOT at most are sent to
all tasks; the others meet their documents by a join on the word.

Defined results: a null text is empty and has the end only; an empty table gives no rows; with no training
documents counts are 0; rows with an equal doc_id are scored each for itself; a null doc_id has the checksum of
an empty text; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, words, written
from .lattice import MARK, expected, marginals, pieces

HOT, STEPS, SMOOTH = 150_000, 2, 0.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in all documents) and c (in training documents)."""
    each = docs.select("held_out", F.explode(words(F.translate("text", UPPER, LOWER))).alias("word"))
    return written(each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("held_out")).cast("long")).alias("c")))


def fit(counts: DataFrame, ends: int, model: str, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Natural log scores of the pieces, and of the end. The sums that come back have a row for each piece at most."""
    scores, end = pieces(model).scores, math.log(0.01)
    train = counts.where("c > 0").select("word", "c")
    for _ in range(steps):
        known = counts.sparkSession.sparkContext.broadcast(scores)

        @giving_back
        def count(frames: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            p, sums = pieces(model), None
            for frame in frames:
                got = expected(p, [MARK + w for w in frame["word"]], frame["c"].to_numpy(float), known.value)
                sums = got if sums is None else sums + got
            if sums is not None:
                used = np.flatnonzero(sums)
                yield pd.DataFrame({"piece": used, "e": sums[used]})

        rows = train.mapInPandas(count, "piece int, e double").groupBy("piece").agg(F.sum("e")).collect()
        known.unpersist()
        seen = np.where(np.isfinite(scores), SMOOTH, 0.0)
        for piece, e in rows:
            seen[piece] += e
        total = seen.sum() + ends + SMOOTH
        with np.errstate(divide="ignore"):
            scores, end = np.log(seen / total), math.log((ends + SMOOTH) / total)
    return scores, end


def least_hot(counts: DataFrame, most: int) -> float:
    """The least n of words that are sent to all tasks, so that they are at most so many. From a histogram of a few hundred rows."""
    steps = sorted(counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().collect(), reverse=True)
    total, least = 0, math.inf
    for step, n in steps:
        if (total := total + n) > most:
            break
        least = 2 ** (step / 8)
    return least


def score(documents: DataFrame, model: str, hot: int = HOT, steps: int = STEPS) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2)
    counts = word_counts(docs)
    ends = docs.where("NOT held_out").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = total[0] + ends, total[1] + (ends > 0)
    scores, end = fit(counts, ends, model, steps)
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(scores)
    floor = math.log10(n + v + 1)

    @giving_back
    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for frame in frames:
            frame["lm"] = marginals(p, [MARK + w for w in frame["word"]], known.value) / math.log(10)
            frame["base"] = np.log10(frame["c"] + 1.0) - floor
            yield frame[["word", "n", "c", "base", "lm"]]

    weighed = written(counts.mapInPandas(weigh, "word string, n long, c long, base double, lm double"))
    common = weighed.where(F.col("n") >= F.lit(float(least_hot(counts, hot)))).select("word", "c", "base", "lm").toPandas()
    table = spark.sparkContext.broadcast((dict(zip(common["word"].str.encode("utf-8"), range(len(common)), strict=True)), (common["c"] > 0).to_numpy(), common["base"].to_numpy(), common["lm"].to_numpy()))
    end_base, end_lm = math.log10(ends + 1) - floor, end / math.log(10) if ends else math.log10(1 / (n + v + 1))

    @giving_back
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each document what its common words give, and a row for each of its other words."""
        index, seen, base, lm = table.value
        for frame in frames:
            own, rare = [], []
            for row, text in zip(frame["row"], frame["text"], strict=True):
                times = Counter(text.encode().lower().split())
                at = np.fromiter((index.get(w, -1) for w in times), np.int64, len(times))
                k = np.fromiter(times.values(), np.int64, len(times))
                hit = at >= 0
                a, b = at[hit], k[hit]
                own.append((int(k.sum()) + 1, int((b * seen[a]).sum()) + (ends > 0), float((b * base[a]).sum()) + end_base, float((b * lm[a]).sum()) + end_lm))
                rare += [(row, w.decode(), c) for (w, c), x in zip(times.items(), hit, strict=True) if not x]
            made = pd.DataFrame(own, columns=["n_tokens", "n_known", "base", "lm"])
            made.insert(0, "row", frame["row"].to_numpy())
            made["doc_id"], made["held_out"] = frame["doc_id"].astype("Int64").to_numpy(), frame["held_out"].to_numpy()
            yield pd.concat([made, pd.DataFrame(rare, columns=["row", "word", "k"]).astype({"k": "Int64"})])[COLUMNS]

    COLUMNS = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "word", "k"]
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    parts = written(numbered.mapInPandas(sums, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, word string, k long"))
    rare = parts.where("word IS NOT NULL").select("row", "word", "k").join(weighed, "word").select("row", F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"), (F.col("k") * F.col("base")).alias("base"), (F.col("k") * F.col("lm")).alias("lm"))
    rare = rare.groupBy("row").agg(F.sum("n_known").alias("k2"), F.sum("base").alias("b2"), F.sum("lm").alias("l2"))
    out = parts.where("word IS NULL").join(rare, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0))).alias("base_score"),
        (F.col("lm") + F.coalesce("l2", F.lit(0.0))).alias("score"),
    )
