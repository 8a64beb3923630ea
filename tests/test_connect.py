"""Requests to hosted models: batches, retries, pacing, resumed builds."""

import time

import pandas as pd
import pytest

from scriptorium.operators import connect, providers
from scriptorium.sources import tables
from scriptorium.sources.answered import AnsweredRequests

QUICK = {"first_wait": 0.0, "slots": 3}


def flaky(every, calls_in=None, fatal_at=None):
    """A client factory: every `every`-th call of a client is refused; one text kills the build; calls are counted in a folder."""

    def make():
        from scriptorium.operators.connect import Retryable as Again

        class Client:
            n = 0

            def embed(self, texts, kind):
                self.n += 1
                if self.n % every == 0:
                    raise Again("slow down")
                if fatal_at in texts:
                    raise RuntimeError("the service is gone")
                if calls_in:
                    import os
                    import uuid

                    with open(os.path.join(calls_in, uuid.uuid4().hex), "w") as f:
                        f.write("\n".join(texts))
                return [[float(len(t)), 1.0] for t in texts]

        return Client()

    return make


def chunks(spark, n=200):
    return spark.createDataFrame([(f"c{i:03d}", "x" * (i % 37 + 1)) for i in range(n)], "chunk_id string, text string").repartition(5)


def embedder(client, **limits):
    return providers.RemoteEmbedder(client, "m", 2, lambda t: len(t), connect.Limits(**({"tokens": 100} | QUICK | limits)))


def test_batches_cross_frames_and_groups():
    texts = ["aaa", "bb", "cccccccc", "", "d", "e", "f"]
    frames = [pd.DataFrame({"text": texts[:2], "g": [1, 1]}), pd.DataFrame({"text": [], "g": []}), pd.DataFrame({"text": texts[2:], "g": [1, 1, 1, 2, 2]})]
    cut = lambda **k: [list(b["text"]) for b in connect.batches_by_tokens(iter(frames), len, **k)]
    assert cut(limit=6) == [["aaa", "bb"], ["cccccccc"], ["", "d", "e", "f"]]
    assert cut(limit=100, texts=2) == [["aaa", "bb"], ["cccccccc", ""], ["d", "e"], ["f"]]
    assert cut(limit=100, apart="g") == [["aaa", "bb", "cccccccc", "", "d"], ["e", "f"]]
    # The whole is cut alike however it is split into frames.
    whole = pd.DataFrame({"text": [("ab" * (i % 7)) for i in range(100)]})
    want = [list(b["text"]) for b in connect.batches_by_tokens(iter([whole]), len, 20)]
    parts = [whole.iloc[i : i + 9] for i in range(0, 100, 9)]
    assert [list(b["text"]) for b in connect.batches_by_tokens(iter(parts), len, 20)] == want


def test_refusals_change_nothing(spark):
    steady = {(r["chunk_id"], tuple(r["vec"])) for r in embedder(flaky(10**9)).embed(chunks(spark)).collect()}
    refused = {(r["chunk_id"], tuple(r["vec"])) for r in embedder(flaky(3)).embed(chunks(spark)).collect()}
    assert len(steady) == 200 and steady == refused


def test_refusals_end(spark):
    with pytest.raises(Exception, match="slow down"):
        embedder(flaky(1), attempts=3).embed(chunks(spark, 5)).collect()


def test_null_empty_and_no_rows(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], "chunk_id string, text string")
    make = lambda: type("C", (), {"embed": lambda self, texts, kind: [[float(len(t or ""))] for t in texts]})()
    assert sorted((r["chunk_id"], r["vec"]) for r in embedder(make).embed(rows).collect()) == [("a", [0.0]), ("b", [0.0]), ("c", [1.0])]
    assert embedder(make).embed(rows.limit(0)).collect() == []


def test_a_killed_build_goes_on_where_it_was(spark, tmp_path):
    """The request with the fatal text is the last of its stream, so all before it were answered and are kept."""
    path, before, after = str(tmp_path / "store"), tmp_path / "before", tmp_path / "after"
    before.mkdir(), after.mkdir()
    with pytest.raises(Exception, match="gone"):
        providers.build_embeddings(chunks(spark), path, embedder(flaky(3, str(before), "x" * 30), slots=1))
    kept = AnsweredRequests(f"{path}/requests")
    assert not kept.is_empty()
    first = spark.read.parquet(kept.path).count()
    assert 0 < first < 200
    out = providers.build_embeddings(chunks(spark), path, embedder(flaky(3, str(after)), slots=2))
    assert kept.is_empty() and out.count() == 200 and out.select("chunk_id").distinct().count() == 200
    asked = lambda folder: sum(len(f.read_text().split("\n")) for f in folder.iterdir())
    assert asked(after) == 200 - first
    # Nothing is asked for when nothing is new; one changed text is asked for alone.
    third = tmp_path / "third"
    third.mkdir()
    changed = chunks(spark).selectExpr("chunk_id", "if(chunk_id = 'c007', 'new', text) AS text")
    out = providers.build_embeddings(changed, path, embedder(flaky(3, str(third))))
    assert asked(third) == 1 and out.count() == 201
    norm = out.selectExpr("round(aggregate(vec, 0D, (a, x) -> a + x * x), 4) AS n").distinct().collect()
    assert [r["n"] for r in norm] == [1.0]


def test_a_task_that_runs_again_asks_only_for_the_rest(spark, tmp_path):
    """Two builds of the same rows, the first without taking in: requests are known again by their rows."""
    store, calls = AnsweredRequests(str(tmp_path / "requests")), tmp_path / "calls"
    calls.mkdir()
    one = embedder(flaky(10**9, str(calls)))
    got = [sorted(map(repr, one.embed(chunks(spark), "document", store).collect())) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == 200
    assert sum(len(f.read_text().split("\n")) for f in calls.iterdir()) == 200


def test_rerank_asks_once_a_question(spark):
    rows = spark.createDataFrame([(q, f"question {q}", f"t{k}" * k, k) for q in range(6) for k in range(1, 5)], "query_id long, question string, text_raw string, fused_rank int")

    def make():
        class Client:
            def rerank(self, question, texts):
                return [len(t) + len(texts) / 100 for t in texts]

        return Client()

    got = providers.RemoteReranker(make, len, connect.Limits(**QUICK)).score(rows).collect()
    assert len(got) == 24 and all(r["score"] == 2 * r["fused_rank"] + 0.04 for r in got)


def test_budget_is_shared_over_streams():
    pace = connect._Pace(connect.Limits(requests_per_minute=6000, tokens_per_minute=None, slots=5))
    began = time.monotonic()
    for _ in range(4):
        pace.wait(10)
    assert 0.14 <= time.monotonic() - began < 1.0  # three waits of 60 * 5 / 6000 seconds


def test_store_reads_empty_tables(spark, tmp_path):
    assert tables.read_or_empty(spark, f"{tmp_path}/none", tables.EMBEDDING_SCHEMA).collect() == []


def test_a_text_is_counted_once_over_small_requests(spark):
    """Each text's tokens are counted once, and rows of many small requests come out whole and in their requests."""
    counted = spark.sparkContext.accumulator(0)

    def count(said):
        counted.add(1)
        return len(said)

    class Echo:
        def say(self, texts):
            return [t + "!" for t in texts]

    rows = spark.createDataFrame([(i, "x" * (i % 5 + 1)) for i in range(5000)], "id long, text string")
    got = connect.ask_in_requests(rows, Echo, lambda s, b: {"said": s.say(b["text"].tolist())}, "said string", connect.Limits(tokens=7, texts=3, slots=2), count, order=["id"], slot="id", log=True).collect()
    assert counted.value == 5000
    assert {(r["id"], r["said"]) for r in got} == {(i, "x" * (i % 5 + 1) + "!") for i in range(5000)} and len(got) == 5000
    sizes = {}
    for r in got:
        sizes.setdefault((r["slot"], r["request_no"]), []).append((len(r["text"]), r["tokens"]))
    assert all(sum(n for n, _ in v) == t and len(v) <= 3 for v in sizes.values() for _, t in v[:1])
