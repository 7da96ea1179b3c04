"""Hand-computed cases."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import asof as A
from tidemark.operators import filters as B
from tidemark.operators import ranks as R
from tidemark.operators import vocab as J


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def test_author_history_is_strictly_earlier(spark):
    rows = spark.createDataFrame([(1, day(0), "alice", 9), (2, day(31), "alice", 999), (3, day(60), "alice", 3), (4, day(14), "bob", 99999)], "id long, time timestamp, by string, score int")
    got = {r.id: r.prior_mean for r in A.prior_mean(rows, "by", "time", F.log1p("score")).collect()}
    assert got[1] is None and got[4] is None
    assert got[2] == pytest.approx(math.log(10)) and got[3] == pytest.approx((math.log(10) + math.log(1000)) / 2)


def test_settling_lag(spark):
    rows = spark.createDataFrame([(1, day(0), "a", 9), (2, day(31), "a", 999), (3, day(31, 12), "a", 3), (4, day(32), "a", 1)], "id long, time timestamp, by string, score int")
    got = {r.id: (r.prior_mean, r.prior_count) for r in A.prior_mean(rows, "by", "time", F.log1p("score")).collect()}
    assert got[3] == (pytest.approx(math.log(10)), 1)
    assert got[4][1] == 1  # the row exactly at the cutoff does not count


def test_prefixes_and_order_do_not_matter(spark):
    data = [(i, day(i), "a", 3 + i % 7 if i != 50 else 5000) for i in range(60)]
    make = lambda d: spark.createDataFrame(d, "id long, time timestamp, by string, score int")
    run = lambda d: {r.id: r.rung1 for r in A.trailing_rung(make(d), "id", "time", F.log1p("score"), 5).collect()}
    whole = run(data)
    assert run(data[::-1]) == pytest.approx(whole)
    assert run(data[:40]) == pytest.approx({i: whole[i] for i in range(40)})


def test_filter(spark):
    base = {"type": 1, "dead": 0, "deleted": 0, "title": "a fine title", "score": 5.0}
    rows = [{}, {"score": 1.0}, {"type": 2}, {"dead": 1}, {"deleted": 1}, {"title": ""}, {"title": "   "}, {"score": 0.0}, {"title": None}, {"score": None}]
    df = spark.createDataFrame([(i, day(0, i), *(base | r).values()) for i, r in enumerate(rows)], "id long, time timestamp, type int, dead int, deleted int, title string, score double")
    assert [r.id for r in B.filter_stories(df).where("type = 1").collect()] == [0, 1]
    assert B.filter_stories(df, 4).count() == 0
    assert B.modal_type(df).first().type == 1


def test_text(spark):
    df = spark.createDataFrame([("<p>Read <a href='x'>this</a> &amp; weep &lt;really&gt;.</p>", "Google&amp;#x27;s plan", "don't ship ad-free gpt-4 on s3")], "a string, b string, c string")
    got = df.select(T.strip_html(F.col("a")), T.normalise_title(F.col("b")), T.tokens(F.col("c"))).first()
    assert tuple(got) == ("Read this & weep <really>.", "google's plan", ["don't", "ship", "ad-free", "gpt-4", "on", "s3"])


HOSTS = {
    "https://www.nytimes.com/a/b": "nytimes.com", "news.ycombinator.com": "news.ycombinator.com", "HTTPS://WWW.X.com/a": "x.com", "nytimes.com/x": "nytimes.com",
    "http://u:p@www.h.com:8080/x": "h.com", "http://[::1]/x": "::1", "http://my_host.com/a": "my_host.com", "http://[bad/x": "", None: "", "": "", "nytimes.com/x//y": "",
}


def test_hostnames(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "u string")
    assert {r.u: r.h for r in df.select("u", T.hostname(F.col("u")).alias("h")).collect()} == HOSTS


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.0, 2.0), (4, 4.0, 4.0)], "id long, p double, a double")
    got = R.report(df, "p", "a", "id", 2)
    assert got == {"rmse": pytest.approx(math.sqrt(0.5)), "mae": 0.5, "n": 4, "spearman": pytest.approx(0.8), "precision_at_2": 0.5}
    assert R.spearman(df.withColumn("p", F.lit(1.0)), "p", "a").first()[0] == 0.0
    with pytest.raises(ValueError):
        R.precision_at_k(df, "p", "a", "id", 100)


def test_budget_and_interleave(spark):
    lines = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d", "e"]), (3, ["f", "g", "h", "i"])], "line_id long, tokens array<string>")
    assert [r.tokens for r in J.budget(lines, 7).orderBy("line_id").collect()] == [["a", "b", "c"], ["d", "e"], ["f", "g"]]
    a = spark.createDataFrame(list(enumerate(["alpha", "beta", "gamma"])), "line_id long, t string")
    b = spark.createDataFrame(list(enumerate(["delta epsilon", "zeta"])), "line_id long, t string")
    assert [r.t for r in J.interleave(a, b).collect()] == ["alpha", "delta epsilon", "beta", "zeta", "gamma"]


def test_noise_and_keep(spark):
    v = spark.createDataFrame([(0, "a", 10000), (1, "b", 1000), (2, "c", 100), (3, "d", 10)], "idx long, word string, count long")
    assert [r.probability for r in J.noise(v).orderBy("idx").collect()] == pytest.approx([0.822994, 0.146352, 0.026025, 0.004628], abs=2e-6)
    v = spark.createDataFrame([(0, "a", 500000), (1, "b", 5000), (2, "c", 500), (3, "d", 50)], "idx long, word string, count long")
    assert [round(r.keep, 6) for r in J.keep_probability(v).orderBy("idx").collect()] == [0.003180, 0.031798, 0.100553, 0.317978]


def test_guards():
    assert B.validate_features(["title", "by"]) == {"title", "by"}
    with pytest.raises(B.LeakedFeatureError):
        B.validate_features(["title", "score"])
    with pytest.raises(B.UnknownFeatureError):
        B.validate_features(["year"])
    with pytest.raises(ValueError):
        B.Split.of_months(("2020-01", "2020-05"), ("2020-03", "2020-06"))
    with pytest.raises(ValueError):
        A.Prior(window_us=0)
