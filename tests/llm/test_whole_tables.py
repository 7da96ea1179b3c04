"""Every query against a plain version over the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import lm_score
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_quality(spark, docs):
    got = {r.doc_id: r for r in Q.op1_quality_rules(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_base(t), d
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[d].kept for d, q in quality.items() if q and not got[d].base_failed]
    bad = [got[d].kept for d, q in quality.items() if not q]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.3


def test_lm(spark, docs):
    got = {r.doc_id: r for r in Q.op2_lm_score(spark, SF).collect()}
    want = brute.base_scores(docs)
    assert got.keys() == want.keys()
    for d, (held, n, known, train, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    # Fitting raises the likelihood of documents that it has not seen.
    plain = lm_score.score(spark.read.parquet(f"{SF}/documents.parquet"), Q.vocabulary("piece_bpe_32k.model"), steps=0)
    before = sum(r.score for r in plain.collect() if r.held_out)
    assert sum(r.score for r in got.values() if r.held_out) > 0.75 * before


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in Q.op3_warc(spark, SF).collect()}
    owner = defaultdict(list)
    for p in pages:
        owner[p.html or ""].append(p.page_id)
    assert len(got) == len(pages)
    for p in pages:
        raw, r = (p.html or "").encode(), got[p.page_id]
        last = max(owner[p.html or ""])
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if p.page_id == last else ("revisit", last))
        assert r.intact


def ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_content_store(spark, docs):
    got = {r.doc_id: r for r in Q.op4_content_store(spark, SF).collect()}
    start = 0
    for (d, _), x in zip(sorted(docs), ids("byte_bpe_50k.json", [t for _, t in sorted(docs)]), strict=True):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    want = brute.labels([r.vec_id for r in rows], [(rows[i].vec_id, rows[j].vec_id) for i, j in np.argwhere(np.triu(near, 1))])
    for r in Q.op5_embedding_dedup(spark, SF).collect():
        i = next(i for i, x in enumerate(rows) if x.vec_id == r.vec_id)
        assert (r.n_links, r.component_id) == (near[i].sum() - 1, want[r.vec_id])


def test_sharding(spark, docs):
    got = {r.doc_id: r for r in Q.op6_sharding(spark, SF).collect()}
    groups = defaultdict(list)
    for d, t in sorted(docs):
        groups[t or ""].append(d)
    order = sorted(groups.items(), key=lambda g: g[1][0])
    _, runs = brute.minimax([len(g[1]) * (len(g[0].encode()) + 8) for g in order], 24)
    at = 0
    for shard, n in enumerate(runs):
        slot = 0
        for text, members in order[at : at + n]:
            for d in members:
                r = got[d]
                assert (r.size, r.text_crc32, r.shard, r.slot) == (len(text.encode()) + 8, zlib.crc32(text.encode()), shard, slot)
                slot += 1
        at += n
    assert at == len(order)


def test_minhash(spark, docs):
    want, sizes = brute.near_labels(docs, 85)
    for r in Q.op7_minhash_dedup(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def check_packing(rows, want):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for d, x in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(x)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0


def test_packing(spark, docs):
    want = dict(zip([d for d, _ in docs], ids("word_bpe_49k.json", [t for _, t in docs]), strict=True))
    check_packing(Q.op8_packing(spark, SF).collect(), want)


def test_nbest(spark, docs):
    got = {r.doc_id: r for r in Q.op9_nbest(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in got.values():
        assert r.decodes and len(r.scores) == 4
        assert r.scores == sorted(r.scores, reverse=True) and r.scores[0] == pytest.approx(r.score)


def test_substrings(spark, docs):
    want = brute.span_cuts(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op10_substring_dedup(spark, SF).collect()}
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 0
