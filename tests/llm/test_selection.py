"""Resampling, filter audit and mixing against plain versions on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import filter_audit, mixing, registry, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, n int, weight double, rank string, key string, hash string, words long, party int"
NAMES = ["op11_resampling", "op12_filter_audit", "op13_mixing"]


def said(rng, n):
    return " ".join(rng.choice(["Ab", "the", "cats", "DOGS", "é中", "x1", "z#", "and"]) + rng.choice(["", "", "s", "7"]) for _ in range(n))


def odd_rows(n=60):
    """Nulls in any column, empty and long texts, copies, repeated rows and ids, a source with most rows."""
    rng = random.Random(n)
    texts = [None, "", " \n\t ", "w" * 5000 + " b c", said(rng, 30_000)] + [said(rng, rng.choice([3, 19, 20, 21, 199, 200, 240])) for _ in range(n)]
    rows = [(i, t, rng.choice(["hot", "hot", "hot", "a", "", None, "é", "Z"])) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[7 + i % 3], "hot") for i in range(20)] + [(7, texts[7], "hot"), (7, texts[7], "hot"), (7, texts[9], "a"), (None, texts[7], None), (None, texts[7], None), (None, None, "a")]
    return [(i, t, "en", s, 1, "p", 2, 3.0, "r", "k", "h", 4, 5) for i, t, s in rows]


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the cats and dogs é中 x1"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 0, 1), (8, 1, None), (9, 0, 1), (100, 1, 1), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    assert registry.QUERIES[name](spark, write(spark, tmp_path, [])).collect() == []


# 11. Resampling


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def automaton(texts):
    got = [[] for _ in texts]
    for found, place, rows in resampling.word_runs(pa.array(texts, pa.string()), 10000):
        for k in range(resampling.RUN):
            for b, row in zip(found[k][place >= k].tolist(), rows[place >= k].tolist(), strict=True):
                got[row].append(b)
    return [sorted(x) for x in got]


def test_runs_equal_plain_checksums(monkeypatch):
    texts = [r[1] for r in odd_rows()]
    plain = [sorted(buckets_of(t)) for t in texts]
    assert automaton(texts) == plain
    # A long text is cut between words; runs go on across the cut.
    monkeypatch.setattr(resampling, "BLOCK", 64)
    for t, want in zip(texts[:4] + texts[5:40], plain[:4] + plain[5:40], strict=True):
        assert automaton([t]) == [want]


def test_resample_equals_plain_version(spark, tmp_path):
    rows = odd_rows()
    got = registry.QUERIES["op11_resampling"](spark, write(spark, tmp_path, rows)).collect()
    docs = [(r[0], buckets_of(r[1]), len(words_of(r[1]))) for r in rows]
    target = [b for t in ("the cats and dogs é中 x1", None, "") for b in buckets_of(t)]
    s, t = np.bincount([b for _, bs, _ in docs for b in bs], minlength=10000), np.bincount(target, minlength=10000)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + 10000) / ((int(s[b]) + 1) * (int(t.sum()) + 10000)))) for b in range(10000)]

    def score(doc_id, bs):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        return sum(gain[b] for b in bs) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    plain = [(i, len(bs), sum(gain[b] for b in bs), score(i, bs), n) for i, bs, n in docs]
    order = sorted((x for x in plain if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = 5 * len(order) // 100
    assert drawn >= 2
    want = [(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(order)] + [(*x[:4], None) for x in plain if x[4] < 20]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_drawn_documents_keep_all_columns(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    ranked = resampling.resample(docs, spark.createDataFrame([("the cats",)], "text string"), percent=20)
    out = resampling.drawn_documents(docs, ranked)
    assert out.columns == docs.columns
    picked = {(r["doc_id"]) for r in ranked.filter("rank IS NOT NULL").collect()}
    assert {r["doc_id"] for r in out.collect()} == picked


# 12. Filter audit


def test_audit_equals_every_order_by_hand(spark, tmp_path):
    rows = odd_rows()
    got = {(r["part"], r["filter_order"], r["step"]): r for r in registry.QUERIES["op12_filter_audit"](spark, write(spark, tmp_path, rows)).collect()}
    good, toxic = {7, 8, 100}, {7, 9, 100}
    docs = []
    for r in rows:
        doc_id, text, part = r[0], r[1] or "", r[3] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = doc_id is not None and any(x[0] is not None and x[0] < doc_id and (x[1] or "") == text for x in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier}
        docs.append((part, {f for f in "ABCDE" if fails[f]}, doc_id in good, doc_id in toxic))
    parts = {d[0] for d in docs}
    assert len(got) == len(parts) * 600
    for part in parts:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                r = got[part, "".join(order), step]
                failing = sum(f in d[1] for d in mine)
                assert (r["kept"], r["removed"], r["redundant"]) == (len(left), len(here), failing - len(here))
                assert (r["unique_fails"], r["good_lost"], r["toxic_lost"]) == (sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here))
                total[f] += len(here)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                assert got[part, "".join(order), step]["shapley"] == total[f]


def test_polynomial_of_masks():
    counts = np.random.default_rng(5).integers(0, 50, (3, 32))
    poly = filter_audit.removal_polynomial(counts)
    for chosen in range(32):
        assert (filter_audit.corner(poly, chosen) == sum(counts[:, m] * bool(m & chosen) for m in range(32))).all()
    # What all filters remove is shared out in full.
    assert (sum(filter_audit.shapley_of_orders(poly, i) for i in range(5)) == 120 * counts[:, 1:].sum(axis=1)).all()


# 13. Mixing


def test_seats_equal_plain_quotients(spark):
    rng = random.Random(3)
    for _ in range(3):
        parties = [(b, p, float(rng.choice([0, 1, 5, 10, 1000, rng.random() * 50]))) for b in range(4) for p in range(rng.randint(1, 30))]
        seats = [(b, rng.choice([0, 1, 3, 40, 997])) for b in range(4)]
        rows = mixing.sainte_lague(spark.createDataFrame(parties, "g int, party int, votes double"), "g", spark.createDataFrame(seats, "g int, seats long")).collect()
        for b, n in seats:
            mine = [(p, v) for g, p, v in parties if g == b]
            want = dict.fromkeys((p for p, _ in mine), 0)
            for _, p in sorted((-v / (2 * k + 1), p) for p, v in mine if v > 0 for k in range(n))[:n]:
                want[p] += 1
            assert {r["party"]: r["won"] for r in rows if r["g"] == b} == want


def targets(sizes):
    """Targets by sharing again and again, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in open_:
            out[s] += left * weight[s] / total
        for s in list(open_):
            if out[s] >= 2 * sizes[s]:
                over += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = over
    return out


@pytest.mark.parametrize("small_shards", [False, True])
def test_mix_meets_targets(spark, tmp_path, monkeypatch, small_shards):
    if small_shards:
        monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
        monkeypatch.setattr(mixing, "SHARD_ROWS", 4)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r["doc_id"]), repr(r["source"]), r["size"]) for r in got) == sorted((repr(r[0]), repr(r[3]), size(r[1])) for r in rows)
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    want = targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target, rel_tol=1e-9, abs_tol=1e-6) and r["source_size"] == sizes[s] for r in mine)
        shards = max(1, -(-sizes[s] // mixing.SHARD_WORDS), -(-len(mine) // mixing.SHARD_ROWS))
        assert abs(sum(r["taken"] for r in mine) - target) <= mixing.BLOCK * (shards + 1)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        inside = [(x["first"], x["end"]) for x in r["ranges"]]
        assert all(0 <= a < b <= r["size"] for a, b in inside) and all(b <= c for (_, b), (c, _) in zip(inside, inside[1:], strict=False))
        assert r["taken"] == r["passes"] * r["size"] + sum(b - a for a, b in inside)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: repr((r["doc_id"], r["source"], r["size"], r["taken"], r["target"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_quotas_are_whole_blocks_of_each_source(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 160), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert sum(r["n"] for r in got) == 90 * 160 * 1.5 and all(r["n"] % mixing.BLOCK == 0 for r in got)
