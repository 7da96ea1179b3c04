"""Filters, temporal splits, samples and feature guards."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import tokens

#: Fixed values.
TYPE_NAMES = {1: "story", 2: "comment", 3: "poll", 4: "pollopt", 5: "job"}
ALLOWED = ("title", "by", "url", "time", "text")
LEAKED = ("score", "descendants", "kids")


class LeakedFeatureError(ValueError):
    """A feature is known only after submission."""


class UnknownFeatureError(ValueError):
    """A feature is not on the allowlist."""


def filter_stories(df: DataFrame, min_title_tokens: int = 1) -> DataFrame:
    """Rows with a title, a positive score and enough title tokens; flags count where the columns exist. In order of time."""
    keep = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.expr("try_cast(score AS double)") > 0) & (F.size(tokens(F.col("title"))) >= min_title_tokens)
    for flag in {"dead", "deleted"} & set(df.columns):
        keep &= F.coalesce(F.col(flag), F.lit(0)) == 0
    return df.where(keep).orderBy("time", *(["id"] if "id" in df.columns else []))


def decode_type(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(names, code.cast("int")), F.concat(F.lit("unknown:"), code.cast("string"))))


def modal_type(df: DataFrame) -> DataFrame:
    """The commonest type among titled, scored rows (the least at a tie)."""
    return df.where("title <> '' AND score > 0").groupBy("type").count().orderBy(F.desc("count"), "type").limit(1)


def drop_months(df: DataFrame, months: Iterable[str], time: str = "time") -> DataFrame:
    return df.where(~F.date_format(time, "yyyy-MM").isin(*months))


@dataclass(frozen=True)
class Split:
    """Half-open intervals."""

    train_start: dt.datetime
    train_end: dt.datetime
    test_start: dt.datetime
    test_end: dt.datetime

    def __post_init__(self) -> None:
        if self.train_start >= self.train_end or self.test_start >= self.test_end:
            raise ValueError("an interval is empty")
        if self.train_end > self.test_start:
            raise ValueError("train and test overlap")

    @classmethod
    def of_months(cls, train: tuple[str, str], test: tuple[str, str]) -> Split:
        """From inclusive months YYYY-MM."""
        return cls(month_start(train[0]), month_after(train[1]), month_start(test[0]), month_after(test[1]))

    def label(self, time: Column) -> Column:
        inside = lambda a, b: (time >= F.lit(a)) & (time < F.lit(b))
        return F.when(inside(self.train_start, self.train_end), "train").when(inside(self.test_start, self.test_end), "test")


def month_start(month: str) -> dt.datetime:
    return dt.datetime.strptime(month, "%Y-%m")


def month_after(month: str) -> dt.datetime:
    return (month_start(month) + dt.timedelta(days=32)).replace(day=1)


def apply_split(df: DataFrame, split: Split, time: str = "time") -> DataFrame:
    """Adds split; rows of the gap go."""
    return df.withColumn("split", split.label(F.col(time))).where("split IS NOT NULL")


def assert_no_overlap(df: DataFrame, time: str = "time") -> None:
    row = df.agg(F.max(F.when(F.col("split") == "train", F.col(time))), F.min(F.when(F.col("split") == "test", F.col(time)))).first()
    if row[0] is None or row[1] is None:
        raise ValueError("train or test is empty")
    if row[0] >= row[1]:
        raise ValueError("train reaches into test")


def seeded(key: Column, seed: int) -> Column:
    """A number from the md5 of key and seed: the same on any engine and layout."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def tail(time: Column, month: str) -> Column:
    return time >= F.lit(month_start(month))


def sample(df: DataFrame, n: int, id_: str, seed: int = 0) -> DataFrame:
    """n rows at random, without replacement."""
    return df.orderBy(seeded(F.col(id_), seed), id_).limit(n)


def cut_tail(df: DataFrame, month: str, id_: str, most: int | None = None, seed: int = 0, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """Fit and validation rows. Rows of the tail that are not sampled do not go back to fit."""
    late = tail(F.col(time), month)
    fit, held = df.where(~late), df.where(late)
    held = held if most is None else sample(held, most, id_, seed)
    if fit.isEmpty() or held.isEmpty():
        raise ValueError("one side of the cut is empty")
    return fit, held


def rows_before(df: DataFrame, cutoff, time: str = "time") -> DataFrame:
    return df.where(F.col(time) < F.lit(cutoff))


def walk_forward(df: DataFrame, train_days: int = 730, test_days: int = 90, step_days: int = 90, time: str = "time") -> DataFrame:
    """Folds over the range of a frame's times: fold, train_start, test_start, test_end."""
    span = df.agg(F.min(F.to_date(time)).alias("a"), F.max(F.to_date(time)).alias("b"))
    last = F.date_sub("b", train_days + test_days - 1)
    starts = F.when(last >= F.col("a"), F.sequence("a", last, F.expr(f"interval {step_days} days"))).otherwise(F.array().cast("array<date>"))
    return span.select(F.posexplode(starts).alias("fold", "train_start")).select("fold", "train_start", F.date_add("train_start", train_days).alias("test_start"), F.date_add("train_start", train_days + test_days).alias("test_end"))


def validate_features(columns: Iterable[str]) -> set[str]:
    found = set(columns)
    if bad := found & set(LEAKED):
        raise LeakedFeatureError(f"known only later: {sorted(bad)}")
    if bad := found - set(ALLOWED):
        raise UnknownFeatureError(f"not on the allowlist: {sorted(bad)}")
    return found
