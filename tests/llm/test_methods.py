"""What the methods promise beyond the rows: n-best by enumeration, corrupted stores, lost records, repeated ids, recall, paths, and the whole pipeline."""

from __future__ import annotations

import itertools
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_whole_tables import check_packing, ids
from tidemark.llm import content_store, embedding_dedup, lattice, minhash_dedup, packing, quality, segment, spans, warc
from tidemark.llm.queries import vocabulary

MODEL, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")


def every_segmentation(p, word):
    if not word:
        return [(0.0, ())]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in p.index:
            i = p.index[word[:n]]
            out += [(p.scores[i] + s, (i, *rest)) for s, rest in every_segmentation(p, word[n:])]
        elif n == 1:
            own = p.spell(ord(word[0]))
            out += [(p.scores[own].sum() + s, (*own.tolist(), *rest)) for s, rest in every_segmentation(p, word[1:])]
    return out


@pytest.mark.parametrize("word", ["▁xxxxxxx", "▁banana", "----------", "▁the", "éàé", "▁中x中", "aaaaaaaa"])
def test_n_best_and_marginals_by_enumeration(word):
    p = lattice.pieces(MODEL)
    every = sorted(every_segmentation(p, word), key=lambda x: -x[0])
    for n in (1, 4, 7):
        got = lattice.astar(p, word, p.scores, n)
        assert np.allclose([s for s, _ in got], [s for s, _ in every[:n]])
        known = {x: s for s, x in every}
        assert len({x for _, x in got}) == len(got) and all(math.isclose(known[x], s) for s, x in got)
    whole = np.logaddexp.reduce([s for s, _ in every])
    assert lattice.marginals(p, [word], p.scores)[0] == pytest.approx(whole)


def test_n_best_of_texts_by_enumeration():
    p = lattice.pieces(MODEL)
    for text in ("to be", "aa\nb -", "x  yy"):
        parts = ["".join(g) for g in __import__("re").findall("\n|▁*[^▁\n]+|▁+", "▁" + text.replace(" ", "▁"))]
        sums = sorted((sum(s for s, _ in c) for c in itertools.product(*[every_segmentation(p, w) for w in parts])), reverse=True)
        ((_, score, found, decodes),) = segment.Segmenter(p).documents([text])
        assert decodes and score == pytest.approx(sums[0])
        assert np.allclose([s for s, _ in found], sums[:4])


def test_runs_of_one_character_end():
    own = segment.Segmenter(lattice.pieces(MODEL))
    for c, n in itertools.product("x-# é", (1, 999, 1000, 4000, 20_000)):
        ((_, score, found, decodes),) = own.documents([c * n])
        assert decodes and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def store(spark, folder):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(3000 if i == 3 else 40))) for i in range(12)] + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{folder}/store"
    content_store.write_store(docs, path, BYTES, True, 50_257)
    return rows, path


def change(folder, body):
    file = next(f for f in sorted(Path(folder).rglob("part-*.parquet")) if pq.read_metadata(f).num_rows)
    t = pq.read_table(file, partitioning=None)
    pq.write_table(body(t), file)
    for crc in file.parent.glob(f".{file.name}.crc"):
        crc.unlink()


def test_store_gives_back_what_it_took(spark, tmp_path):
    rows, path = store(spark, tmp_path)
    want = dict(zip([d for d, _ in rows], ids("byte_bpe_50k.json", [t for _, t in rows]), strict=True))
    got = {r.doc_id: r.ids for r in content_store.documents(spark, path, 50_257).collect()}
    assert got.keys() == want.keys() and all(got[d] == want[d].tolist() for d in want)
    assert content_store.checksums(spark, path, 50_257).count() == len(rows)


def turned(t, column):
    x = t[column].to_pylist()
    x[0] = bytes([x[0][0] ^ 1]) + x[0][1:]
    return t.set_column(t.column_names.index(column), t.schema.field(column), pa.array(x, t.schema.field(column).type))


@pytest.mark.parametrize("part, body", [("parts/kind=chunk", lambda t: turned(t, "ids")), ("parts/kind=chunk", lambda t: t.slice(1)), ("recipes", lambda t: turned(t, "root")), ("recipes", lambda t: turned(t, "chunks")), ("recipes", lambda t: t.slice(1))])
def test_damage_is_seen(spark, tmp_path, part, body):
    _, path = store(spark, tmp_path)
    change(tmp_path / "store" / part, body)
    with pytest.raises(Exception, match="match|missing"):
        content_store.checksums(spark, path, 50_257).collect()


def test_a_lost_request_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "v", "<q>")], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/all")
    lines = [r.value for r in spark.read.option("lineSep", "\r\n\r\n").text(f"file://{tmp_path}/all").collect()]
    at = next(i for i, x in enumerate(lines) if "WARC-Type: request" in x)
    del lines[at : at + 2]  # head and block of the first request
    Path(tmp_path / "less").mkdir()
    Path(tmp_path / "less" / "part-0").write_bytes("".join(x + "\r\n\r\n" for x in lines).encode())
    got = warc.assemble(spark, f"file://{tmp_path}/less").collect()
    assert sorted((r.requests, r.request is None, r.metadatas) for r in got) == [(0, True, 1), (1, False, 1)]


def test_repeated_ids_keep_their_links(spark):
    rows = [(9, [1.0, 0.0]), (9, [0.0, 1.0]), (11, [1.0, 0.01]), (12, [0.01, 1.0]), (20, [1e-50, 2e-50, 0.0]), (21, [1.0, 2.0, 0.0]), (22, [1e300, 2e300, 0.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(9, 1, 9), (9, 1, 9), (11, 1, 9), (12, 1, 9), (20, 2, 20), (21, 2, 20), (22, 2, 20)]
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    docs = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b[:-1], "z"])), (3, " ".join([*a[:-1], "z"])), (4, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_documents(docs, 80).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted((r.doc_id, r.text[:2]) for r in minhash_dedup.drop_near_documents(docs).collect()) == [(1, "a0"), (1, "b0"), (4, "ot")]


def test_recall_just_above_the_threshold(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(400):
        x, y = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 48)))
        y = y - x * (x @ y)
        c = rng.uniform(0.9001, 0.92)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert got >= 0.95 * 800


def test_nnls_and_padding():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 5)), np.array([0.0, 2.0, 0.0, 1.0, 3.0])
    assert np.allclose(packing.nnls(a, a @ x), x)
    for _ in range(5):  # the conditions for a minimum: no gradient where x > 0, none that would lower the error elsewhere
        b = rng.normal(size=12)
        got = packing.nnls(a, b)
        gradient = a.T @ (b - a @ got)
        assert (got >= 0).all() and np.allclose(gradient[got > 0], 0, atol=1e-6) and (gradient <= 1e-6).all()
    lengths = rng.integers(1, 5000, 800)
    pieces = packing.Packer().pack(lengths)
    sequences = {}
    for d, start, n, number, at in pieces:
        sequences.setdefault(number, []).append((at, n))
    total = sum(n for _, _, n, _, _ in pieces)
    assert total == lengths.sum()
    padded = sum(-s % 4096 for s in (sum(n for _, n in x) for x in sequences.values()) if s & (s - 1))
    assert padded <= 0.001 * total


def prose(seed, n):
    return ["".join(w) for w in np.random.default_rng(seed).choice(list("abcdefghij"), (n, 6))]


def test_long_spans_go_by_paths(spark, monkeypatch):
    shared = prose(0, 300)
    docs = [(i, " ".join([*prose(10 + i, 80), *shared, *prose(50 + i, 80)])) for i in range(6)]
    seen, original = [], spans.written
    monkeypatch.setattr(spans, "written", lambda df: (seen.append(out := original(df)), out)[1])
    got = spans.span_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.span_cuts(docs)
    judged = next(x for x in seen if "held" in x.columns)
    by_path = judged.where("held AND doc_id > first").selectExpr("sum(length - 49) AS n").first().n
    assert by_path >= 0.8 * 5 * 251  # the edges of a passage are looked up


def test_what_stays_keeps_its_lines(spark):
    shared = prose(1, 60)
    rows = [(1, " ".join(shared), 5), (2, "line one\nline two\n" + " ".join(shared) + "\nline three\n", 9), (3, "\tuntouched \n text", 1), (4, " ".join(shared) + " end", 2), (5, "start " + " ".join(shared), 2)]
    got = {r.doc_id: (r.text, r.n_chars) for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert got[2] == ("line one\nline two\nline three\n", 29)
    assert got[3] == ("\tuntouched \n text", 1) and got[4] == ("end", 3) and got[5] == ("start", 5)


def test_expectation_finds_a_bad_rule(spark):
    """Votes planted at random for one rule, and by class for the others: the random one weighs next to nothing."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(3000):
        good = rng.random() < 0.7
        rows.append([int(rng.choice([1, -1])) if name == "shouts" else (1 if good else -1) if rng.random() < 0.9 else 0 for name in quality.RULES])
    voted = spark.createDataFrame(rows, [f"v_{n}" for n in quality.RULES])
    chances, share = quality.fit(voted)
    assert share == pytest.approx(0.7, abs=0.05)
    weight = {n: math.log(g / b) for n, (g, b) in chances.items()}
    assert weight["shouts"] < 0.2 and all(w > 2 for n, w in weight.items() if n != "shouts")


def test_pipeline_against_plain_versions(spark, tmp_path):
    base = [prose(100 + i, 120) for i in range(30)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join([*base[0][:-2], "xx", "yy"]), texts[1], " ".join([*prose(900, 100), *base[2][20:90], *prose(901, 30)]), "# $ % " * 40, "short", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    kept = {d: t for d, t, *_ in rows if not brute.quality_base(t)[-1] and d != 33}
    stage = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert {r.doc_id for r in stage} == kept.keys()
    near, _ = brute.near_labels(list(kept.items()), 80)
    kept = {d: t for d, t in kept.items() if near[d] == d}
    cuts = brute.span_cuts(list(kept.items()))
    left = {}
    for d, t in kept.items():
        gone = {j for f in kept if f < d for i in range(len(t.split()) - 49) for w in [t.split()[i : i + 50]] if " ".join(w) in kept[f] for j in range(i, i + 50)}
        assert len(gone) == cuts[d][1]
        left[d] = " ".join(w for i, w in enumerate(t.split()) if i not in gone)
    want = dict(zip(left, ids("word_bpe_49k.json", list(left.values())), strict=True))
    check_packing(corpus_pipeline.run(spark, f"file://{tmp_path}").collect(), want)
