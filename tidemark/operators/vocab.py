"""Vocabularies, encoding, context windows, noise and subsampling, token budgets, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import before

UNKNOWN = "<unk>"


def word_counts(lines: DataFrame, tokens: str = "tokens") -> DataFrame:
    return lines.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(lines: DataFrame, min_count: int = 5, max_size: int = 50_000, tokens: str = "tokens") -> DataFrame:
    """idx, word, count: by count, then word; at index 0 the unknown word with the count of all others. max_size bounds the rows."""
    counts = word_counts(lines, tokens)
    kept = counts.where(F.col("count") >= min_count).orderBy(F.desc("count"), "word").limit(max_size - 1)
    kept = kept.withColumn("idx", F.row_number().over(W.orderBy(F.desc("count"), "word")).cast("long"))
    rest = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("a")).join(kept.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("b")), F.lit(True)).select(F.lit(UNKNOWN).alias("word"), (F.col("a") - F.col("b")).alias("count"), F.lit(0).cast("long").alias("idx"))
    return rest.unionByName(kept).select("idx", "word", "count")


def positions(lines: DataFrame, tokens: str = "tokens", line: str = "line_id") -> DataFrame:
    return lines.select(line, F.posexplode(tokens).alias("pos", "word"))


def encode(lines: DataFrame, vocab: DataFrame, line: str = "line_id") -> DataFrame:
    """Every token's index, 0 for unknown words. The vocabulary is bounded by its max_size, so it is sent to all tasks."""
    return positions(lines, line=line).join(F.broadcast(vocab.select("word", "idx")), "word", "left").select(line, "pos", F.coalesce("idx", F.lit(0)).alias("idx"))


def known_ids(lines: DataFrame, vocab: DataFrame, line: str = "line_id") -> DataFrame:
    """Each line's ids without unknown words, whose neighbours close up; lines of fewer than two go."""
    known = positions(lines, line=line).join(F.broadcast(vocab.where("idx > 0").select("word", "idx")), "word")
    ids = known.groupBy(line).agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("x"))
    return ids.select(line, F.col("x.idx").alias("ids")).where("size(ids) > 1")


def contexts(ids: Column, window: int) -> Column:
    """For each position the centre and the ids within the window on both sides."""
    n = F.size(ids)

    def one(i: Column) -> Column:
        left = F.slice(ids, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
        right = F.slice(ids, i + 2, F.lit(window))
        return F.struct(i.alias("pos"), F.get(ids, i).alias("centre"), F.concat(left, right).alias("context"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))


def cbow(lines: DataFrame, window: int, line: str = "line_id", ids: str = "ids") -> DataFrame:
    return lines.select(line, F.explode(contexts(F.col(ids), window)).alias("x")).select(line, "x.pos", "x.centre", "x.context").where("size(context) > 0")


def skipgram(lines: DataFrame, window: int, line: str = "line_id", ids: str = "ids") -> DataFrame:
    return cbow(lines, window, line, ids).select(line, "pos", "centre", F.explode("context").alias("context"))


def _some(vocab: DataFrame) -> None:
    if not vocab.agg(F.sum("count")).first()[0]:
        raise ValueError("all counts are 0")


def noise(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """The distribution of negative draws, the unknown word included."""
    _some(vocab)
    total = vocab.agg(F.sum(F.pow("count", F.lit(power))).alias("_t"))
    return vocab.join(F.broadcast(total), F.lit(True)).select("idx", "word", F.try_divide(F.pow("count", F.lit(power)), "_t").alias("probability"))


def keep_probability(vocab: DataFrame, threshold: float = 1e-5) -> DataFrame:
    _some(vocab)
    total = vocab.agg(F.sum("count").alias("_t"))
    keep = F.when(F.col("count") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.try_divide(F.lit(threshold) * F.col("_t"), "count"))))
    return vocab.join(F.broadcast(total), F.lit(True)).select("idx", "word", keep.alias("keep"))


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """The words of ids; an id that isn't in the vocabulary is the unknown word's. The vocabulary is bounded by its max_size, so it is sent to all tasks."""
    return encoded.join(F.broadcast(vocab.select("idx", "word")), "idx", "left").withColumn("word", F.coalesce("word", F.lit(UNKNOWN)))


def shared_words(a: DataFrame, b: DataFrame, least: int = 3, word: str = "word") -> DataFrame:
    """The words of both vocabularies but the unknown one; an error below the least number."""
    both = a.select(word).join(b.select(word), word).where(F.col(word) != UNKNOWN).distinct()
    if both.limit(least).count() < least:
        raise ValueError(f"fewer than {least} words in common")
    return both


def corpus_totals(lines: DataFrame, tokens: str = "tokens") -> DataFrame:
    """tokens and lines of a corpus."""
    return lines.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("lines"))


def count_examples(lines: DataFrame, window: int, ids: str = "ids") -> DataFrame:
    """How many (centre, context) pairs and how many centres with a context a pass over the lines makes, without making them."""
    n = F.size(ids)

    def pairs(w: int) -> Column:  # a line of n ids has, at each distance d below n, 2 (n - d) pairs
        m = F.least(n - 1, F.lit(w)).cast("long")
        return F.when(n > 1, 2 * m * n - m * (m + 1)).otherwise(0)

    return lines.agg(F.coalesce(F.sum(pairs(window)), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(n > 1, n).otherwise(0)), F.lit(0)).alias("centres"))


def budget(lines: DataFrame, most: int, order: str = "line_id", tokens: str = "tokens") -> DataFrame:
    """The first tokens in line order, the last line cut; lines left empty go."""
    cut = before(lines, [order], F.size(tokens).cast("long"), "_taken", order).withColumn("_left", F.lit(most) - F.col("_taken")).where("_left > 0")
    return cut.withColumn(tokens, F.slice(tokens, 1, F.least(F.col("_left"), F.lit(2**31 - 1)).cast("int"))).drop("_left", "_taken").where(F.size(tokens) > 0)


def interleave(first: DataFrame, second: DataFrame, order: str = "line_id") -> DataFrame:
    """Both sources merged by progress; at a tie the first goes first. Adds source and progress, the sort key."""

    def marked(df: DataFrame, source: int) -> DataFrame:
        total = df.agg(F.count(F.lit(1)).alias("_n"))
        ranked = before(df, [order], F.lit(1), "_r", order)
        return ranked.join(F.broadcast(total), F.lit(True)).withColumns({"source": F.lit(source), "progress": F.col("_r") / F.col("_n")}).drop("_r", "_n")

    return marked(first, 0).unionByName(marked(second, 1)).orderBy("progress", "source")


def encoder(df: DataFrame, key: str, least: int, first: int = 1) -> DataFrame:
    """key and index of keys with enough rows, by count; what is absent here is out of vocabulary (0)."""
    counts = df.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("_less", -F.col("n"))
    return before(counts, ["_less", key], F.lit(1), "_at", "_less").select(key, (F.col("_at") + first).cast("int").alias("idx"))


#: The domain encoder's reserved rows.
UNSEEN, NO_URL = 0, 1


def domain_index(df: DataFrame, fitted: DataFrame, host: str, name: str = "domain_idx") -> DataFrame:
    """Adds each row's index: NO_URL without a host, UNSEEN for a host that encoder(..., first=2) did not take."""
    known = fitted.select(F.col(fitted.columns[0]).alias("_host"), F.col("idx").alias("_idx"))
    own = F.when(F.coalesce(F.col(host), F.lit("")) == "", NO_URL).otherwise(F.coalesce("_idx", F.lit(UNSEEN)))
    return df.join(known, F.col(host) == F.col("_host"), "left").withColumn(name, own).drop("_host", "_idx")
