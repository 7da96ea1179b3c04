"""Nulls, empty and long texts, repeated rows, empty tables, and extra columns whose names the operators use themselves."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import content_store, embedding_dedup, lm_score, minhash_dedup, packing, quality, segment, sharding, spans, warc
from tidemark.llm.queries import vocabulary

CLASHES = ("_id", "_hash", "_gone", "_doc", "_t", "_starts", "_copy", "_key", "t", "node", "key", "row", "word", "n", "serial", "label", "component", "first", "size", "digest", "held_out", "kind", "_RANK")
_rng = random.Random(5)
LONG = " ".join("".join(_rng.choices("abcdefghij", k=5)) for _ in range(60_000))
DOCS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c d e f"), (6, "a b c d e f"), (7, LONG), (8, LONG), (9, "x" * 100_000), (10, "é中\U0001f600   ź"), (None, "no id here"), (None, None)]


def table(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds).withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [], "doc_id long, text string")


def test_quality(docs, none):
    got = quality.judge(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in DOCS)
    counts = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got}
    assert all(counts[d] == brute.quality_base(t) for d, t in DOCS if d and d != 10)
    assert not any(r.kept for r in got if r.base_failed)
    left = quality.keep(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {7, 8}
    assert quality.judge(none).count() == quality.keep(none).count() == 0


def test_lm(docs, none):
    got = lm_score.score(docs, vocabulary("piece_bpe_32k.model"), steps=1).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in DOCS)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2, 3, 7)} == {1: 1, 2: 1, 3: 1, 7: 60_001}
    assert lm_score.score(none, vocabulary("piece_bpe_32k.model"), steps=1).count() == 0


def test_warc(spark):
    kinds = "page_id long, url string, html string"
    pages = [(1, None, None), (2, "u\nv", ""), (3, "u", "<p>"), (3, "u", "<p>"), (4, "u", "WARC/1.1\r\n\r\n" * 9), (None, None, "<p>"), (None, None, "only")]
    got = warc.captures(table(spark, pages, kinds)).collect()
    found = sorted((r.response.type, r.response.payload_bytes, r.response.intact) for r in got)
    assert found == sorted([("revisit", 0, True), ("response", 0, True), ("response", 3, True), ("response", 3, True), ("response", 108, True), ("revisit", 3, True), ("response", 4, True)])
    assert all(r.requests == r.metadatas == 1 for r in got)
    assert warc.captures(table(spark, [], kinds)).count() == 0


def test_content_store(docs, none):
    got = sorted(content_store.store_report(docs, vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, *sorted(d for d, _ in DOCS if d)]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 1}
    assert content_store.store_report(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_embeddings(spark):
    kinds = "vec_id long, embedding array<float>"
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, -1.0]), (None, [1.0, 1.0])]
    got = embedding_dedup.near_vectors(table(spark, rows, kinds)).collect()
    assert len(got) == len(rows)
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in got if r.vec_id in (1, 2, 3, 4, 5, 6, 10, None))
    assert all((r.n_links, r.component_id) == (3, 7) for r in got if r.vec_id in (7, 8, 9))
    assert embedding_dedup.near_vectors(table(spark, [], kinds)).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(DOCS)
    slots, same = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        same[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in same.values())
    assert sharding.shard(none, 4).count() == 0


def test_minhash(docs, none):
    got = minhash_dedup.near_documents(docs).collect()
    assert len(got) == len(DOCS)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    left = minhash_dedup.drop_near_documents(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 9, 10, None, None]))
    assert minhash_dedup.near_documents(none).count() == minhash_dedup.drop_near_documents(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in DOCS}
    total, at = sum(r.length for r in rows), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert total == sum(at.values()) and max(at.values()) == 4096
    assert packing.pack(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_nbest(docs, none):
    model = vocabulary("piece_bpe_32k.model")
    got = segment.segment(docs, model, with_ids=True)
    assert all(r.decodes for r in got.collect())
    back = {r.doc_id: r.text for r in segment.decode(got, model).collect()}
    assert all(back[d] == (t or "") for d, t in DOCS if d)
    assert segment.segment(none, model).count() == 0


def test_substrings(docs, none):
    got = spans.span_report(docs).collect()
    assert len(got) == len(DOCS)
    want = brute.span_cuts([(d, t) for d, t in dict(x for x in DOCS if x[0]).items() if d != 7 and d != 8])
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id in want)
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (7, 8)} == {7: 0, 8: 60_000}
    left = spans.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(DOCS)
    assert spans.span_report(none).count() == spans.remove_repeats(none).count() == 0


def test_stages(spark, docs, none):
    for start in (docs, none):
        kept = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, "")
            assert kept.columns == start.columns
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
