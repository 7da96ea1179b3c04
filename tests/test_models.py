"""Regressions, word vectors, chains and decision rules on small planted inputs."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators import evaluation as K
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import order as O
from tidemark.operators import ranks as R
from tidemark.operators import sparse as S
from tidemark.operators import vectors as V
from tidemark.operators import vocab as J
from tidemark.operators import word2vec as N
from tidemark.plans import chain as C
from tidemark.plans import ladder as L


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [2.0, -1.0, 0.5] + 4 + rng.normal(size=60) / 10
    rows = [(i, *map(float, r), float(t), Vectors.dense(r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    c = x - x.mean(0)
    return spark.createDataFrame(rows, ["id", "a", "b", "c", "y", "features"]).persist(), np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))


def test_ridge_equals_the_closed_form(planted):
    df, want = planted
    dense = M.ridge_dense(df, ["a", "b", "c"], "y")
    assert [dense[c] for c in "abc"] == pytest.approx(want, rel=1e-9)
    assert M.ridge(df, "y").coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_prefixes_of_boosted_trees(planted):
    df, _ = planted
    model = M.boosted(df, "y", trees=6, depth=2)
    ladder = M.tree_ladder(model, df, "y", [1, 3, 6, 9])
    assert [n for n, _ in ladder] == [1, 3, 6]
    for n, loss in ladder:
        found = M.first_trees(model, n).transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2)))).first()[0]
        assert math.sqrt(found) == pytest.approx(loss)


def test_patience():
    assert M.best_round([5, 4, 3, 3.5, 3.6, 1], patience=2) == 3
    assert M.best_round([5, 4, 3, 3.5, 3.6, 1], patience=4) == 6


def test_common_component(spark):
    rows = [([3.0 * k, 4.0 * k],) for k in (1, 2, -1)]
    df = spark.createDataFrame(rows, "v array<double>")
    u = X.common_component(df, "v")
    assert u == pytest.approx([0.6, 0.8])
    left = df.select(X.without_component(F.col("v"), u).alias("v")).collect()
    assert all(abs(x) < 1e-9 for r in left for x in r.v)


def test_first_loss_and_gradient():
    rng = np.random.default_rng(0)
    inside, outside = rng.normal(size=(5, 4)), np.zeros((5, 4))
    one = np.ones((1, 1))
    assert N.step(inside, outside, np.array([[1]]), one, np.array([2]), np.array([[3, 4]]), 0.0) == pytest.approx(3 * math.log(2))
    outside = rng.normal(size=(5, 4))
    args = (np.array([[0, 1]]), np.ones((1, 2)), np.array([2]), np.array([[3, 2]]))
    before = N.step(inside.copy(), outside.copy(), *args, 0.0)
    a, b = inside.copy(), outside.copy()
    N.step(a, b, *args, 1e-4)
    slope = (((a - inside) ** 2).sum() + ((b - outside) ** 2).sum()) / 1e-4
    assert N.step(a, b, *args, 0.0) - before == pytest.approx(-slope, rel=1e-2)


@pytest.mark.parametrize("objective", ["skipgram", "cbow"])
def test_planted_topics(spark, tmp_path, objective):
    lines = N.planted_topics(spark, 600)
    vocab = J.vocabulary(lines, 1, 100).persist()
    ids = J.known_ids(lines, vocab).persist()
    config = N.Config(objective=objective, width=12, window=3, rounds=3, rate=0.2, batch=64, threshold=1.0, partitions=2)
    model = N.train(ids, vocab, config, checkpoints=f"file://{tmp_path}", stage="s")
    assert N.check(model, config) == []
    m = model.matrix()[1:]
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    topic = np.array([w.split("w")[0] for w in model.words[1:]])
    near = np.argsort(-(m @ m.T - 9 * np.eye(len(m))), axis=1)[:, :5]
    assert (topic[near] == topic[:, None]).mean() > 0.9
    again = N.train(ids, vocab, config, checkpoints=f"file://{tmp_path}", stage="s")
    assert again.rounds == 3 and np.allclose(again.inside, model.inside) and again.loss_trace == pytest.approx(model.loss_trace)
    with pytest.raises(ValueError):
        N.train(ids, vocab.where("idx < 9"), config, checkpoints=f"file://{tmp_path}", stage="s")


def test_chain():
    def ok(objective, product):
        return "completed", (product or 0) + 1

    def stop(objective, product):
        raise C.GateFailed("short")

    def only_a(objective, product):
        if objective == "b":
            raise RuntimeError("lost")
        return "completed", product

    assert C.run_chain(["a", "b"], [C.Stage("x", ok), C.Stage("y", ok)]).outcome == "completed"
    assert C.run_chain(["a", "b"], [C.Stage("gate", stop, False), C.Stage("y", ok)]).outcome == "aborted_at_gate"
    part = C.run_chain(["a", "b"], [C.Stage("x", only_a), C.Stage("y", ok)])
    assert part.outcome == "partial" and part.objectives == {"a": "completed", "b": "failed"}
    assert [s["status"] for s in part.stages] == ["completed", "completed", "failed", "skipped"]


def test_gate():
    assert K.gate({"x": 0.9}, {"x": 1.0}, 0.2).passed
    assert not K.gate({"x": 0.7}, {"x": 1.0}, 0.2).passed
    assert not K.gate({"x": 0.9}, {"x": 1.0}, 0.1).passed
    assert not K.gate({}, {}, 1.0).passed


def test_question_files(spark, tmp_path):
    (tmp_path / "q").write_text(": capitals\nA b C d\na b c\n")
    assert [tuple(r)[1:] for r in K.read_questions(spark, f"file://{tmp_path}/q").collect()] == [("a", "b", "c", "d")]
    (tmp_path / "r").write_text("Word 1,Word 2,Human\nTiger,cat,7.35\ncar\tauto\t8\n")
    assert sorted(tuple(r) for r in K.read_ratings(spark, f"file://{tmp_path}/r").collect()) == [("car", "auto", 8.0), ("tiger", "cat", 7.35)]


def test_blocks_and_slices_of_queries_change_no_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 6))
    v[7] = v[3]  # a tie
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    expected = {(i, j) for i in range(60) for j in sorted(range(60), key=lambda j: (-round(sims[i, j], 9), j))[:3]}
    for query_bytes, held in ((10**9, 10**9), (10**9, 1), (500, 1)):  # one block and slice, one query a slice, several blocks
        monkeypatch.setattr(V, "QUERY_BYTES", query_bytes)
        monkeypatch.setattr(V, "SIMILARITY_BYTES", held)
        assert {(r["query"], r["id"]) for r in V.neighbours(rows, rows, 3).collect()} == expected
    assert V.neighbours(rows, rows.limit(0), 3).count() == 0


def test_analogies_leave_out_the_questions_words_and_unknown_ones(spark):
    space = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("far", [-1.0, -1.0]), ("near", [0.1, 1.0])], "word string, vector array<double>")
    asked = spark.createDataFrame([(1, "a", "b", "c", "near"), (2, "a", "b", "c", "far"), (3, "a", "b", "c", "unknown")], "qid long, a string, b string, c string, d string")
    assert tuple(K.analogies(space, asked).first()) == (0.5, 2)
    assert tuple(K.analogies(space, asked.limit(0)).first()) == (0.0, 0)


def test_rungs_share_their_features_and_measure_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda: "word" + "abcdefghijklmnopqrstuvwxyz"[int(26 * rng.random() ** 2)]
    rows = []
    for i in range(90):
        body = " ".join(word() for _ in range(rng.integers(0, 40)))
        rows.append((i, datetime(2024, 1, 1) + timedelta(hours=9 * i), body[:30] if i % 9 else None, body if i % 7 else None, f"a{i % 3}" if i % 5 else None, f"http://h{i % 4}.com/x" if i % 2 else None, float(len(set(body.split())))))
    stories = spark.createDataFrame(rows, "id long, time timestamp, title string, text string, by string, url string, label double")
    made = L.story_features(stories, "label").persist()
    train, test = made.where("id < 60"), made.where("id >= 60")
    calls, make = [], X.CountVectorizerModel.from_vocabulary
    monkeypatch.setattr(X.CountVectorizerModel, "from_vocabulary", lambda *a, **k: calls.append(a) or make(*a, **k))
    got = [tuple(r) for r in L.run_ladder(spark, L.six_rungs("label", "id", 12, "normal", trees=2, depth=2), train, test, "label", "id", 5).collect()]
    assert len(calls) <= 4  # two texts of two intervals, for three rungs together
    alone = {
        "1 trailing mean": L.given("rung1"), "2 author": L.given("author_prior"), "3 domain": L.given("domain_prior"),
        "4 body ridge": L.text_ridge(["body"], L.BODY, "label", "id", max_features=12, solver="normal"),
        "5 all signals ridge": L.text_ridge(["title", "body"], L.DENSE, "label", "id", max_features=12, solver="normal"),
        "6 all signals trees": L.text_trees(["title", "body"], L.DENSE, "label", "id", 12, trees=2, depth=2),
    }
    want = [(name, *R.report(rung(train, test), "predicted", "label", "id", 5).values()) for name, rung in alone.items()]
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1:] == pytest.approx(w[1:], rel=1e-6), g[0]


@pytest.mark.parametrize("size", [3, 40])
def test_frequent_terms_are_those_of_tfidf(spark, size):
    rng = np.random.default_rng(size)
    texts = [" ".join("wx" + "abcdefghij"[int(10 * rng.random() ** 2)] for _ in range(rng.integers(0, 30))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    fitted = [tuple(r) for r in X.fit_tfidf(df, "id", "text", size).orderBy("idx").select("term", "idf").collect()]
    found = X.frequent_terms(df, "text", size)
    assert (found is None) == (size > 9)  # with fewer words than asked for, or with none left, this way is no shorter
    assert found is None or found == [t for t, _ in fitted]
    counted = X.count_block(df, [t for t, _ in fitted], "text", "c").persist()
    assert X.idf_of_counts(counted, "c") == pytest.approx([i for _, i in fitted])


def test_ranks_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "LEAST_ROWS", 8)
    rng = np.random.default_rng(6)
    values = pd.DataFrame({"d": np.round(rng.normal(size=90), 1), "i": rng.integers(-9, 9, 90)})
    df = spark.createDataFrame(values).persist()
    for c in ("d", "i"):
        assert len(df.select(O.part_of(df, c).alias("p")).distinct().collect()) == 4
        got = sorted(tuple(r) for r in R.average_ranks(df, c, "r").select(c, "r").collect())
        assert got == sorted(zip(values[c].tolist(), values[c].rank().tolist(), strict=True))


def _plain_trees(x: np.ndarray, y: np.ndarray, k: S.Settings) -> np.ndarray:
    """Predictions of trees that try every split of every row set; nan is missing."""
    p = np.full(len(y), y.mean())

    def split(rows, g, depth):
        best, total, n = None, g[rows].sum(), len(rows)
        for f in range(x.shape[1] if depth < k.depth else 0):
            v = x[rows, f]
            for t in np.unique(v[~np.isnan(v)]):
                for missing in (False, True):
                    left = (v <= t) | (np.isnan(v) & missing)
                    a, m = g[rows][left].sum(), left.sum()
                    if 0 < m < n:
                        gain = a * a / (m + k.penalty) + (total - a) ** 2 / (n - m + k.penalty) - total**2 / (n + k.penalty)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, left)
        if best is None:
            p[rows] += k.rate * total / (n + k.penalty)
        else:
            split(rows[best[1]], g, depth + 1)
            split(rows[~best[1]], g, depth + 1)

    for _ in range(k.trees):
        split(np.arange(len(y)), y - p, 0)
    return p


@pytest.fixture(scope="module")
def holed(spark):
    rng = np.random.default_rng(1)
    x = (rng.integers(1, 6, (80, 6)) / 3).astype(np.float32)
    x[rng.random(x.shape) < 0.5] = np.nan
    y = np.where(np.isnan(x[:, 0]), 2, x[:, 0]) + (x[:, 1] > 1) + rng.normal(size=80) / 5
    vector = lambda i, r: Vectors.dense(np.nan_to_num(r)) if i % 4 == 0 else Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(r) if v == v])
    return spark.createDataFrame([(i, vector(i, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], ["id", "features", "y"]).repartition(3).persist(), x, y


@pytest.mark.parametrize(("tasks", "chunk", "few"), [(1, 60_000, 100), (3, 20, 100), (3, 20, 0)])
def test_sparse_trees_are_plain_trees_in_any_number_of_tasks(holed, monkeypatch, tasks, chunk, few):
    df, x, y = holed
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "FEW_ROWS", few)
    k = S.Settings(trees=4, depth=3)
    model = S.boosted_sparse(df, "y", settings=k, tasks=tasks)
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert got == pytest.approx(_plain_trees(x, y, k), rel=1e-6)


def test_columns_of_many_values_are_cut_evenly_and_equal_values_stay_together():
    v = np.r_[np.ones(50), np.arange(2, 152)].astype(np.float32)
    c = S.binned(np.arange(200, dtype=np.int32), np.zeros(200, np.int32), v, 10)
    assert np.diff(c.start).tolist() == [50, 10, *[20] * 7]
    assert len(S.binned(np.arange(200, dtype=np.int32), np.zeros(200, np.int32), v, 151).feature) == 151


@pytest.mark.parametrize("tasks", [1, 3])
def test_sparse_ridge_equals_the_closed_form(holed, tasks):
    df, x, y = holed
    x = np.nan_to_num(x.astype(float))
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + np.eye(6), c.T @ (y - y.mean()))
    model = S.ridge_sparse(df, "y", tasks=tasks)
    assert model.weights == pytest.approx(w, rel=1e-5)
    assert [r.prediction for r in model.transform(df).orderBy("id").collect()] == pytest.approx(c @ w + y.mean(), rel=1e-6)


def test_the_query_runs_the_ladder_with_the_references_parameters(spark, monkeypatch):
    from tidemark import catalog_models as Q

    seen = []
    monkeypatch.setattr(L, "story_features", lambda rows, *a: rows)
    monkeypatch.setattr(L, "Shared", lambda *a: seen.append(a[4]) or SimpleNamespace(rung=lambda texts, columns, model: model))
    monkeypatch.setattr(S, "boosted_sparse", lambda rows, label, settings: seen.append(settings))
    monkeypatch.setattr(L, "run_ladder", lambda spark, rungs, *a: rungs["6 all signals trees"](None) or spark.range(1))
    Q.regression_ladder(spark, "/root/testdata/sf0.001")
    assert seen[0] == 50_000 and (seen[1].trees, seen[1].depth, seen[1].rate, seen[1].bins) == (500, 6, 0.1, 64)
