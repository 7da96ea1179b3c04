"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes +1 (good), -1 (bad) or 0 (abstains) over its own range of one measure, so votes of rules conflict. Expectation-maximisation
estimates, for each rule, how often good and bad documents get its good vote, and the share of good documents; the posterior probability of the good
class, in which votes weigh by those chances, replaces the demand that all rules pass. A bad vote may be outvoted.

Expectation runs on the table of vote patterns, of which there are at most 3 to the number of rules, whatever
the input; each step is one aggregation over that table.

Defined results: a null or blank text has no words and fails the base rule; an empty table gives no rows;
rows that are alike get equal results; other columns are kept out of the result. Ratios of texts without words
make a rule abstain.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, words, written

SYMBOLS, CAPITALS, BLANK_CHARS = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\x0b\x0c\r"
#: Rule: (measure, good while at most, bad from).
HIGH_RULES = {
    "symbols": ("n_symbols / n_words", 0.05, 0.15),
    "repeats": ("n_repeat_words / n_words", 0.3, 0.5),
    "lines": ("n_dup_lines / n_lines", 0.1, 0.5),
    "capitals": ("n_capitals / word_chars", 0.2, 0.4),
    "shouts": ("n_shouts / n_words", 0.05, 0.2),
    "long_words": ("word_chars / n_words", 10.0, 14.0),
}
#: Rule: (measure, good from, bad below).
LOW_RULES = {"length": ("n_words", 100, 50), "short_words": ("word_chars / n_words", 3.5, 2.5)}
RULES = [*HIGH_RULES, *LOW_RULES]
#: The share of good documents from which estimation starts.
SHARE = 0.6
STEPS = 12
#: Signs that a good document carries at most once in so many, whatever the estimate; the other signs are weighed as they are met.
STRONG, ONCE_IN = ("symbols", "repeats", "short_words"), 1000
#: Where estimation starts: the chances of a rule's good vote (of a strong sign, of another) on a good and on a bad document, which count as PRIOR_ROWS votes.
START = {True: (1 - 1 / ONCE_IN, 0.6), False: (0.95, 0.9)}
PRIOR_ROWS = 10
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(w: Column, n: int = 3) -> Column:
    """Words inside windows of n words that occur twice or more, from sorted window hashes with their places."""
    size = F.size(w)

    def of(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("h"), i.alias("i")))

        def marked(s: Column) -> Column:
            same = lambda x, j: x["h"] == F.get(s, j)["h"]
            twice = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            places = F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(n)])))
            return F.size(F.array_distinct(places))

        return let(F.sort_array(hashed), marked)

    return F.when(size >= n, of(w)).otherwise(F.lit(0))


def measures(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the counts that the rules look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = documents.select(F.col(key).alias("doc_id"), t.alias("_t"), words(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: without(x, BLANK_CHARS) > 0).alias("_l"))
    return whole.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        without(F.col("_t"), BLANK_CHARS).cast("long").alias("word_chars"),
        (F.length("_t") - without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        let(F.col("_w"), lambda w: repeated_words(w)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - without(F.col("_t"), CAPITALS)).cast("long").alias("n_capitals"),
        (F.length("_t") - without(F.col("_t"), "!")).cast("long").alias("n_shouts"),
    )


def votes(measured: DataFrame) -> DataFrame:
    """Adds a column v_<rule> for each measure: good where it is quiet, bad where it is loud, whatever the other rules say."""
    out = {f"v_{name}": F.when(_measure(what) >= high, -1).when(_measure(what) <= low, 1).otherwise(0) for name, (what, low, high) in HIGH_RULES.items()}
    out |= {f"v_{name}": F.when(_measure(what) < low, -1).when(_measure(what) >= high, 1).otherwise(0) for name, (what, high, low) in LOW_RULES.items()}
    return measured.withColumns(out)


def _measure(what: str) -> Column:
    top, _, bottom = what.partition(" / ")
    return F.try_divide(F.col(top), F.col(bottom)) if bottom else F.col(top)


def posterior(chances: dict[str, tuple[float, float]], share: float) -> Column:
    """The probability of the good class: a vote weighs as the odds of meeting it on a good and on a bad document."""
    odds = (F.when(F.col(f"v_{n}") == 1, math.log(g / b)).when(F.col(f"v_{n}") == -1, math.log((1 - g) / (1 - b))).otherwise(0.0) for n, (g, b) in chances.items())
    return 1 / (1 + F.exp(-reduce(add, odds, F.lit(math.log(share / (1 - share))))))


def fit(voted: DataFrame, steps: int = STEPS) -> tuple[dict[str, tuple[float, float]], float]:
    """For each rule the chances of its good vote on a good and on a bad document, and the share of good documents."""
    patterns = written(voted.groupBy(*[f"v_{n}" for n in RULES]).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    start = {n: START[n in STRONG] for n in RULES}
    chances, share = start, SHARE
    for _ in range(steps):
        weighed = patterns.withColumn("_p", posterior(chances, share))
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_p")).alias("good")]
        for name in RULES:
            for kind, p in (("good", F.col("_p")), ("bad", 1 - F.col("_p"))):
                sums += [F.sum(F.when(F.col(f"v_{name}") == 1, F.col("n") * p).otherwise(0.0)).alias(f"{name}_{kind}"), F.sum(F.when(F.col(f"v_{name}") != 0, F.col("n") * p).otherwise(0.0)).alias(f"{name}_{kind}_votes")]
        row = weighed.agg(*sums).first()
        if not row["n"]:
            break
        share = (row["good"] + SHARE * PRIOR_ROWS) / (row["n"] + PRIOR_ROWS)
        chances = {}
        for name in RULES:
            g, b = ((row[f"{name}_{kind}"] + first * PRIOR_ROWS) / (row[f"{name}_{kind}_votes"] + PRIOR_ROWS) for kind, first in zip(("good", "bad"), start[name], strict=True))
            g = max(g, 1 - 1 / ONCE_IN) if name in STRONG else g
            chances[name] = g, min(g, b)  # a good vote never speaks against a document
    return chances, share


def judge(documents: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """For each document its counts, base_failed, the posterior quality and kept."""
    voted = votes(written(measures(documents, text, key)))  # written first, so that votes don't measure again
    p = posterior(*fit(voted))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (p >= threshold)).alias("kept"), F.round(p, 6).alias("quality"))


def keep(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that the rules keep, all columns. Rows that share an id are told apart by their text; a row without an id is judged too."""
    ident, hashed = free(documents, "_id", "_hash")
    marked = documents.select(F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash")).alias("_key"), F.col(text).alias("_text"))
    bad = judge(marked, "_text", "_key").where("NOT kept").select(F.col("doc_id.id").alias(ident), F.col("doc_id.hash").alias(hashed)).distinct()
    return documents.join(bad, documents[key].eqNullSafe(F.col(ident)) & (F.xxhash64(documents[text]) == F.col(hashed)), "left_anti")
