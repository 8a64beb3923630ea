"""The lexical index, scans with bounded best lists and containment against plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import rules
from scriptorium.operators import best, lexical, retrieve


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(f"c{i}", i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, ordinal long, text_folded string")


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, question string")


def plain_bm25(chunks, queries, k):
    docs = [(c, o, t.split()) for c, o, t in ((c, o, t or "") for c, o, t in chunks)]
    n, avg = len(docs), sum(len(t) for _, _, t in docs) / len(docs)
    df = {}
    for _, _, ts in docs:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: rules.EPSILON * mean if v < 0 else v for t, v in raw.items()}
    out = set()
    for q, text in queries:
        rows = []
        for c, o, ts in docs:
            s = sum(idf[t] * ts.count(t) * (rules.K1 + 1) / (ts.count(t) + rules.K1 * (1 - rules.B + rules.B * len(ts) / avg)) for t in text.split() if t in ts)
            if round(s, 6) > 0:
                rows.append((-round(s, 6), -o, c))
        out |= {(q, c, rank, -s) for rank, (s, _, c) in enumerate(sorted(rows)[:k], 1)}
    return out


QUESTIONS = [(1, "w0 w1 w40"), (2, "w59 w58 w58 w3"), (3, "nothing here"), (4, "w0"), (5, " ".join(f"w{i}" for i in range(0, 60, 3)))]


def rows_of(df):
    return {(r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in df.collect()}


def same(got, want):
    assert {x[:3] for x in got} == {x[:3] for x in want}
    scores = {x[:3]: x[3] for x in want}
    assert all(math.isclose(x[3], scores[x[:3]], abs_tol=2e-6) for x in got)


def test_scan_equals_plain_bm25(spark):
    chunks = corpus(1, 300) + [("null", 300, None), ("blank", 301, " ")]
    same(rows_of(retrieve.bm25(frame(spark, chunks).repartition(5), asked(spark, QUESTIONS), 7, aliases=None)), plain_bm25(chunks, QUESTIONS, 7))


def test_stored_index_follows_its_chunks(spark, tmp_path):
    """Built, asked, updated by new, changed and removed chunks, asked again: ranks as of an index built anew."""
    index = lexical.StoredIndex(spark, f"{tmp_path}/index", buckets=8)
    first = corpus(2, 250)
    index.update(frame(spark, first).repartition(3))
    same(rows_of(retrieve.bm25_indexed(index, asked(spark, QUESTIONS), 6, aliases=None)), plain_bm25(first, QUESTIONS, 6))
    index.update(frame(spark, first))
    assert index._segments() == [0]  # nothing changed, nothing written
    second = [(c, o, t + " w59 w58" if o % 9 == 0 else t) for c, o, t in first[20:]] + [("new", 900, "w58 w59 w3"), ("empty", 901, "")]
    index.update(frame(spark, second))
    same(rows_of(retrieve.bm25_indexed(index, asked(spark, QUESTIONS), 6, aliases=None)), plain_bm25(second, QUESTIONS, 6))
    assert index.sums() == lexical.ForwardIndex.of(frame(spark, second)).sums()
    assert {tuple(r) for r in index.document_frequencies().collect()} == {tuple(r) for r in lexical.ForwardIndex.of(frame(spark, second)).document_frequencies().collect()}
    # Only what changed is written again, and chunks outside a partial update stay.
    assert spark.read.parquet(f"{tmp_path}/index/forward/segment=1").count() == sum(o % 9 == 0 for _, o, _ in first[20:]) + 2
    index.update(frame(spark, [("more", 902, "w57 w57")]), complete=False)
    assert index.sums()[0] == len(second) + 1


def test_a_killed_update_is_not_read(spark, tmp_path):
    index = lexical.StoredIndex(spark, f"{tmp_path}/index", buckets=4)
    rows = corpus(3, 80)
    index.update(frame(spark, rows))
    index._write(frame(spark, rows).select("chunk_id", F.lit("w0").alias("term"), "ordinal", F.lit(1).alias("dl"), F.lit(1).alias("tf"), F.lit(0).alias("bucket")), "postings", 1, "bucket")
    same(rows_of(retrieve.bm25_indexed(index, asked(spark, QUESTIONS), 5, aliases=None)), plain_bm25(rows, QUESTIONS, 5))
    changed = rows[5:]
    index.update(frame(spark, changed))
    same(rows_of(retrieve.bm25_indexed(index, asked(spark, QUESTIONS), 5, aliases=None)), plain_bm25(changed, QUESTIONS, 5))


def test_batches_of_queries_in_several_scans(spark, monkeypatch):
    chunks = corpus(4, 120)
    monkeypatch.setattr(lexical, "SCAN_TERMS", 4)
    same(rows_of(retrieve.bm25(frame(spark, chunks), asked(spark, QUESTIONS), 5, aliases=None)), plain_bm25(chunks, QUESTIONS, 5))


def test_best_keeps_the_best_of_many_batches(monkeypatch):
    monkeypatch.setattr(best, "CELLS", 50)
    rng = np.random.default_rng(2)
    held = best.Best(3, 4)
    scores, ordinals = rng.integers(-5, 5, (200, 3)) / 4, rng.permutation(200)
    for at in range(0, 200, 7):
        held.offer(scores[at : at + 7], ordinals[at : at + 7], np.array([f"c{o}" for o in ordinals[at : at + 7]], object))
    import pyarrow as pa

    rows = pa.Table.from_batches(list(held.rows(pa.array([10, 11, 12])))).to_pylist()
    for q in range(3):
        want = sorted(zip(-scores[:, q], -ordinals, strict=True))[:4]
        assert sorted((-r["score"], -r["ordinal"]) for r in rows if r["query_id"] == 10 + q) == want
    assert best.millionths(np.array([0.0078125, -0.0078125, 1.0000004])).tolist() == [7813, -7813, 1000000]


def test_dense_equals_plain_cosine(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs, qs = rng.normal(size=(90, 6)).round(2), rng.normal(size=(9, 6)).round(2)
    vecs[5] = vecs[4]
    vecs[7] = 0
    rows = spark.createDataFrame([(f"c{i}", i, v.tolist()) for i, v in enumerate(vecs)] + [("none", 99, None)], "chunk_id string, ordinal long, vec array<float>").repartition(4)
    batch = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)] + [(50, None)], "query_id long, vec array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    scores = unit(vecs.astype(np.float32).astype(float)) @ unit(qs).T
    want = {(q, f"c{i}", rank) for q in range(9) for rank, i in enumerate(sorted(range(90), key=lambda i, q=q: (-round(scores[i, q], 6), -i))[:5], 1)}
    for limit in (retrieve.DENSE_BYTES, 200):
        monkeypatch.setattr(retrieve, "DENSE_BYTES", limit)
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in retrieve.dense(rows, batch, 5).collect()} == want
    assert retrieve.dense(rows, batch.limit(0), 5).collect() == [] and retrieve.dense(rows.limit(0), batch, 5).collect() == []


@pytest.mark.parametrize("few", [False, True])
def test_containing_equals_a_plain_search(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(retrieve, "CONTAINED", 3)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "ca", "bab", "c"]) for _ in range(rng.randint(0, 9))) for _ in range(80)] + [None, "", "a  b", " ab"]
    said = ["b", "ab", "c ab", "ab c", "ab ab", "b ab c", "ab b c ab", "zz", "ab zz c", "", " ", "a  b", " ab", "ab ", "abc b ", None]
    chunks = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, ordinal long, text_raw string").repartition(4)
    got = retrieve.containing(chunks, asked(spark, list(enumerate(said)))).collect()
    want = [(q, f"c{i}", i) for q, s in enumerate(said) for i, t in enumerate(texts) if s is not None and t is not None and s in t]
    assert sorted(map(tuple, got)) == sorted(want)


def test_coverage_fills_up_with_the_last_chunks(spark):
    chunks = spark.createDataFrame([("a", 0, "candle window"), ("b", 1, "window"), ("c", 2, "stone"), ("d", 3, None)], "chunk_id string, ordinal long, text_raw string")
    got = retrieve.coverage_ranks(chunks, asked(spark, [(1, "window candle"), (2, "the")]), 3).collect()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in got) == [(1, 1, "a", 1.0), (1, 2, "b", 0.5), (1, 3, "d", 0.0)]


def test_best_holds_few_scores_at_once():
    """Over many batches no more is held than a few times k a query or a slice; before, four million scores."""
    rng = np.random.default_rng(4)
    held, every = best.Best(50, 5), []
    most = 0
    for at in range(0, 40_000, 1000):
        scores = rng.integers(-3, 3000, (1000, 50)) / 1000
        every.append(scores)
        held.offer(scores, np.arange(at, at + 1000), np.array([str(i) for i in range(at, at + 1000)], object))
        most = max(most, held.size)
    assert most <= 500_000
    whole, got = np.concatenate(every), {}
    for b in held.rows(pa.array(range(50))):
        for q, o, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            got.setdefault(q, []).append((s, o))
    for q in range(50):
        assert sorted(got[q]) == sorted(sorted(zip(whole[:, q].tolist(), range(len(whole)), strict=True))[-5:])


def test_scan_sums_piece_by_piece(spark, monkeypatch):
    """Sums over pieces of a few entries equal those over all entries at once."""
    rows = spark.createDataFrame([(str(i), i, " ".join(f"w{(i * j) % 11}" for j in range(1, 9))) for i in range(60)], "chunk_id string, ordinal long, text_folded string")
    asked = spark.createDataFrame([(q, f"w{(q * j) % 11} w{j}") for q in range(9) for j in range(3)], "query_id long, question string").groupBy("query_id").agg(F.concat_ws(" ", F.collect_list("question")).alias("question"))
    want = sorted(map(tuple, retrieve.bm25(rows, asked, aliases=None).collect()))
    monkeypatch.setattr(lexical, "CELLS", 7)
    assert sorted(map(tuple, retrieve.bm25(rows, asked, aliases=None).collect())) == want and want


def test_stored_index_of_many_blocks(spark, tmp_path, monkeypatch):
    """A term's chunks of a block are one row of postings; blocks with replaced chunks rank as an index built anew."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "ROWS", 5)
    index = lexical.StoredIndex(spark, f"{tmp_path}/index", buckets=4)
    first = corpus(5, 150)
    index.update(frame(spark, first).coalesce(1))
    pairs = sum(len(set(t.split())) for _, _, t in first)
    rows = spark.read.parquet(f"{tmp_path}/index/postings")
    assert rows.count() < pairs / 2 and rows.select(F.sum(F.size("spots"))).first()[0] == pairs
    second = [(c, o, t + " w59" if o % 3 == 0 else t) for c, o, t in first if o % 7] + [("new", 900, "w58 w59 w3")]
    index.update(frame(spark, second))
    same(rows_of(retrieve.bm25_indexed(index, asked(spark, QUESTIONS), 6, aliases=None)), plain_bm25(second, QUESTIONS, 6))
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lexical, "SCAN_TERMS", 4)
    third = second[5:] + [("last", 901, "w1 w2 w59")]
    index.update(frame(spark, third))
    same(rows_of(retrieve.bm25_indexed(index, asked(spark, QUESTIONS), 6, aliases=None)), plain_bm25(third, QUESTIONS, 6))
