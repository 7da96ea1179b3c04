"""Scans, shards, corpora and results."""

from __future__ import annotations

import datetime as dt

import pytest

from tidemark.operators import vocab as J
from tidemark.sources import tables as S

KINDS = "id long, type int, time timestamp, title string, text string, score long, by string, url string, descendants int, dead int, deleted int"


def story(i, month, **changes):
    row = {"id": i, "type": 1, "time": dt.datetime(2020, month, 1 + i % 20), "title": f"Title {i}", "text": f"<p>Body &amp; {i}", "score": 5, "by": "a", "url": None, "descendants": 0, "dead": 0, "deleted": None}
    return tuple((row | changes).values())


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for m in (1, 2, 3):
        rows = [story(10 * m + i, m) for i in range(4)] + [story(10 * m + 5, m, title=""), story(10 * m + 6, m, score=0), story(10 * m + 7, m, dead=1), story(10 * m + 8, m, type=2)]
        spark.createDataFrame(rows, KINDS).write.parquet(f"file://{folder}/2020-0{m}.parquet")
    return f"file://{folder}"


def test_shards_are_listed_by_name(spark, months):
    assert [x.rsplit("/", 1)[-1] for x in S.list_shards(spark, months)] == ["2020-01.parquet", "2020-02.parquet", "2020-03.parquet"]
    assert S.list_shards(spark, months + "/none") == []


def test_scan_keeps_usable_rows_in_order(spark, months):
    got = [r.id for r in S.scan_stories(spark, S.list_shards(spark, months)).collect()]
    assert len(got) == 12 and got == sorted(got)
    assert S.scan_stories(spark, S.list_shards(spark, months), 5).count() == 5
    with pytest.raises(ValueError, match="no paths"):
        S.scan_stories(spark, [])
    assert set(S.read_ladder(spark, S.list_shards(spark, months)[0]).columns) == set(S.LADDER_COLUMNS)


def test_pull_resumes_and_merge_sorts(spark, months, tmp_path):
    folder, shards = f"file://{tmp_path}/shards", S.list_shards(spark, months)
    assert len(S.pull_months(spark, shards[:2], folder)) == 2
    assert [x.rsplit("/", 1)[-1] for x in S.pull_months(spark, shards, folder)] == ["2020-03.parquet"]
    assert S.pull_months(spark, shards, folder) == []
    assert S.is_current(spark, f"{folder}/2020-01.parquet") and not S.is_current(spark, f"{folder}/2020-09.parquet")
    report = S.merge_shards(spark, folder, ["2020-01", "2020-02", "2020-03"], f"file://{tmp_path}/all")
    assert (report["stories"], report["scanned"], report["keep_rate"]) == (12, 12, 1.0) and "12 rows" in S.summary(report)
    with pytest.raises(FileNotFoundError, match="2020-04"):
        S.merge_shards(spark, folder, ["2020-03", "2020-04"], f"file://{tmp_path}/none")


def test_footers_guard_the_projection(spark, months):
    import glob

    files = sorted(glob.glob(months.removeprefix("file://") + "/2020-01.parquet/part-*"))
    sizes = S.footer_sizes(spark, files)
    assert {"id", "title"} <= {r.column_name for r in sizes.collect()}
    assert S.guard_projection(sizes, ["id"]) > 0
    with pytest.raises(ValueError, match="guard"):
        S.guard_projection(sizes, ["id", "title"], 1)


def test_months_and_commits(spark, months, tmp_path):
    (tmp_path / "c.csv").write_text("year,month,committed_at,count\n2020,1,2020-02-01 00:00:00,8\n2020,2,2020-03-01 00:00:00,9\n")
    commits = S.commit_times(spark, f"file://{tmp_path}/c.csv")
    assert [r.month for r in commits.orderBy("month").collect()] == ["2020-01", "2020-02"] and S.rows_scanned(commits) == 17
    S.write_months(S.scan_stories(spark, S.list_shards(spark, months)), f"file://{tmp_path}/by_month")
    assert sorted(r.month for r in spark.read.parquet(f"file://{tmp_path}/by_month").select("month").distinct().collect()) == ["2020-01", "2020-02", "2020-03"]


def test_list_words(spark):
    rows = spark.createDataFrame([(["a"], dt.datetime(2020, 1, 5)), ([], dt.datetime(2020, 1, 6)), (["b"], dt.datetime(2020, 2, 1))], "words array<string>, time timestamp")
    assert S.list_words(rows).count() == 2 and S.list_words(rows, month="2020-01").count() == 1


def test_text_corpora(spark, tmp_path):
    (tmp_path / "t8").write_text(" one two three four five")
    lines = S.read_text8(spark, f"file://{tmp_path}/t8", 9).collect()
    assert [t for r in lines for t in r.tokens] == ["one", "two", "three", "four", "five"] and len(lines) > 1
    (tmp_path / "plain").write_text("Hello &amp; World\n\n!!!\nThe END of it\n")
    assert [r.tokens for r in S.read_plain(spark, f"file://{tmp_path}/plain").orderBy("line_id").collect()] == [["hello", "world"], ["the", "end", "of", "it"]]
    assert [r.tokens for r in S.read_plain(spark, f"file://{tmp_path}/plain", 3).orderBy("line_id").collect()] == [["hello", "world"], ["the"]]
    assert [r.tokens for r in S.read_lines(spark, f"file://{tmp_path}/plain").orderBy("line_id").collect()][0] == ["Hello", "&amp;", "World"]


def test_titles_and_bodies_are_lines_of_their_own(spark, months, tmp_path):
    stories = spark.createDataFrame([story(1, 1), story(2, 2, text=None), story(3, 3), story(4, 1, title="?", text="<br>")], KINDS)
    got = S.title_body_lines(stories, "2020-03-01")
    assert [(r.line_id, r.tokens) for r in got.orderBy("line_id").collect()] == [(2, ["title", "1"]), (3, ["body", "1"]), (4, ["title", "2"])]
    assert J.corpus_totals(S.title_body_lines(stories, "2020-03-01", 5)).first() == (5, 3)
    profile = S.write_corpus(got, f"file://{tmp_path}/corpus")
    assert (profile["tokens"], profile["lines"]) == (6, 3) and len(profile["sha256"]) == 64


def test_vocabulary_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["a", "c"])], "line_id long, tokens array<string>")
    v = J.vocabulary(lines, 1, 10)
    S.save_vocabulary(v, f"file://{tmp_path}/v")
    back = S.load_vocabulary(spark, f"file://{tmp_path}/v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    assert [r.word for r in J.decode(J.encode(lines, back), back).orderBy("line_id", "pos").collect()] == ["a", "b", "a", "a", "c"]
    with pytest.raises(ValueError, match="in common"):
        J.shared_words(v, back, 4)
    assert J.shared_words(v, back, 3).count() == 3


def test_json_and_articles(spark, tmp_path):
    S.write_json({"b": 1, "a": [2]}, str(tmp_path / "x.json"))
    assert S.read_json(str(tmp_path / "x.json")) == {"a": [2], "b": 1} and not (tmp_path / "x.json.part").exists()
    S.export_articles(spark.createDataFrame([("w " * 150,), ("short",), (None,)], "text string"), f"file://{tmp_path}/articles")
    assert spark.read.text(f"file://{tmp_path}/articles").count() == 1
