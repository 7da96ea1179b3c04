"""What the reviewer's findings of round 1 ask for."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tidemark import catalog, catalog_models  # noqa: F401 - the second adds its queries to the first
from tidemark.llm import quality
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int = 150) -> list[str]:
    return ["".join(w) for w in np.random.default_rng(seed).choice(list("abcdefghij"), (n, 5))]


def test_weak_bad_vote_is_outvoted(spark):
    clean = [(i, " ".join(prose(i))) for i in range(40)]
    shouted = [(100 + i, " ".join(w.upper() if k % 2 else w for k, w in enumerate(prose(100 + i)))) for i in range(6)]
    junk = [(200 + i, " ".join(f"{w}##" if k % 2 else w for k, w in enumerate(prose(200 + i)))) for i in range(8)]
    documents = spark.createDataFrame(clean + shouted + junk, "doc_id long, text string")
    got = {r.doc_id for r in quality.judge(documents).where("kept").collect()}
    assert got == {d for d, _ in clean + shouted}
    assert {r.doc_id for r in quality.keep(documents).collect()} == got


def test_supervised_quality_follows_the_labels(spark):
    got = {r.doc_id: r for r in Q.op1_quality_rules(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(got[d].kept for d, q in labels.items() if q and not got[d].base_failed)
    assert not any(got[d].kept for d, q in labels.items() if not q)


def test_whole_vocabularies(spark):
    assert "idx <= 99999" in catalog.ORACLES["encode_100k"] and "LIMIT 50000)" in catalog.ORACLES["tfidf_weights_50k"]
    words = catalog.QUERIES["vocabulary_100k"](spark, "/root/testdata/sf0.1")
    assert words.where("idx > 0").count() == 8913


def test_only_emptied_rows_go(spark):
    shared = " ".join(prose(1, 80))
    rows = [(1, shared, 5), (2, shared, 5), (3, None, None), (4, "", None), (5, "", 7), (6, "few words", 9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for d in (documents, documents.drop("n_chars")):
        got = corpus_pipeline.substring_dedup(spark, d, SF)
        assert got.columns == d.columns and {r.doc_id for r in got.collect()} == {1, 3, 4, 5, 6}


def test_errors_read_all_events(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert catalog.QUERIES["rmse_mae_all"](spark, SF).first().n == n > catalog.QUERIES["rmse_mae"](spark, SF).first().n
