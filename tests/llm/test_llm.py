"""Training-data operators against brute force on small fixtures, and their edge cases."""

import decimal
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, assert_same
from pyspark.sql import functions as F

from scriptorium.llm import _links, decontaminate, fingerprint, html_text, licenses, line_dedup, ngram_join, packing, quality, registry, substring_dedup, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
NAMES = ["op1_packing", "op2_ngram_join", "op3_line_dedup", "op4_quality", "op5_fingerprints", "op6_decontamination", "op7_html_text", "op8_licenses", "op9_substring_dedup", "op10_toxicity"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randint(0, 9)) for _ in range(n))


def corpus(spark, texts, extra=True):
    rows = [(i, t, "en", "src0", None if t is None else len(t), "mine", i % 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, start int")
    return df if extra else df.drop("score", "start")


def edge_texts():
    rng = random.Random(4)
    long = prose(rng, 4000)
    return [None, "", " \n ", "one", "one", prose(rng, 40), long, long, long[:-9] + " changed", "é " * 50, "a" * 500]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_its_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, tmp_path, name, empty):
    """Nulls, empty, blank, repeated and long texts, clashing columns and empty tables give one row a document."""
    texts = [] if empty else edge_texts()
    docs = corpus(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(len(texts))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "é " * 12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pages = spark.createDataFrame([] if empty else [(1, None, None), (2, "u", ""), (2, "u", "<p>a"), (None, "v", "<article><p>x &amp; y</article>")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op7_html_text":
        assert len(rows) == (0 if empty else 4)
    elif name == "op1_packing":
        assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    else:
        assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))


def odd_rows():
    """Rows without an id, repeated ids with equal and with other texts, columns named as the operators name theirs."""
    rng = random.Random(14)
    a, b, long = prose(rng, 40), prose(rng, 40), prose(rng, 30_000)
    texts = [(None, a), (None, a), (None, None), (1, a), (1, a), (1, b), (2, "\n".join([a, b, a])), (3, long), (4, ""), (5, None)]
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2.0, True) for i, t in texts]


ODD = "doc_id long, text string, lang string, source string, n_chars long, __gone int, tk string, score double, mask boolean"


@pytest.mark.parametrize("name", [n for n in NAMES if n != "op7_html_text"])
def test_odd_rows(spark, tmp_path, name):
    """Each row gets its own row (op1: pieces of each id), with missing and repeated ids and clashing names."""
    rows = odd_rows()
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r["doc_id"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    order = lambda ids: sorted(ids, key=lambda x: (x is not None, x or 0))
    if name == "op1_packing":
        assert set(got) == {r[0] for r in rows}
    else:
        assert order(got) == order([r[0] for r in rows])


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, tmp_path, empty):
    """All stages keep columns of any name; a null id and a repeated one go by their own texts."""
    import corpus_pipeline

    rows = [] if empty else odd_rows()
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any of these texts at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sum(r["doc_id"] is None for r in docs.collect()) == (0 if empty else 3), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_line_stage_keeps_columns_named_as_its_counts(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "a line that is long enough\nanother line", 77, 5, "r"), (2, "a line that is long enough\nmore", 88, 6, "s"), (None, None, 99, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, n_lines long, row string")
    out = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["n_removed"], r["n_lines"], r["row"]) for r in out.collect()} == {(i, a, b, c) for i, _, a, b, c in rows}
    assert {r["doc_id"]: r["text"] for r in out.collect()}[2] == "more"


# 1. Packing


def test_differencing_keeps_all_items_and_balances():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7):
        sizes = rng.integers(1, 100, 60)
        sums = np.bincount(packing.karmarkar_karp(sizes, n), weights=sizes, minlength=n)
        assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 40
    assert len(packing.karmarkar_karp(np.zeros(0, np.int64), 3)) == 0
    assert sorted(np.bincount(packing.karmarkar_karp(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_windows_hold_each_token_once_within_capacity():
    sizes = np.random.default_rng(1).integers(1, 2047, 300)
    windows = packing.near_equal_windows(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(300))
    assert max(sizes[w].sum() for w in windows) <= 2048
    # The count rises from the least possible one only while differencing leaves a window over capacity.
    for n in range(-(-int(sizes.sum()) // 2048), len(windows)):
        assert np.bincount(packing.karmarkar_karp(sizes, n), weights=sizes).max() > 2048


def test_padding_is_little(spark):
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(12)
    rows = packing.pack_documents(corpus(spark, [prose(rng, rng.randint(1, 900)) for _ in range(1500)]).coalesce(1), P.path("byte_bpe_50k.json"), batch_windows=64).collect()
    windows = {r["sequence_id"] for r in rows}
    assert sum(r["length"] for r in rows) >= 0.98 * 2048 * (len(windows) - 1)


def test_ids_equal_the_tokenizer_and_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*[x or "" for x in edge_texts()], "tab\tand  two\n\nlines \n end ", "don't I'll 'tis 12ab3", "<|endoftext|>", "a <|endoftext|> b", "x  <|endoftext|>\ny", " nbsp em", "日本語 и кириллица\nx"]
    encode = packing.ByteBpe.load(P.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    rows = packing.pack_documents(corpus(spark, texts), P.path("byte_bpe_50k.json")).orderBy("doc_id", "start").collect()
    got, at = {}, {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in enumerate(texts):
        assert np.frombuffer(got[i], "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


# 2. N-gram Jaccard join


def near_copies(rng):
    texts = [prose(rng, rng.choice([3, 5, 6, 7, 8, 9, 12, 20, 60, 200])) for _ in range(40)]
    for i in range(40):
        words = texts[i].split()
        for _ in range(rng.randint(1, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy + ["tail"] * rng.randint(0, 2)))
    rng.shuffle(texts)
    return texts


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in [*range(1, 40), 90, 300, 1100]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            most = size // 4
            drop = int(rng.integers(0, most + 1))
            union = size
            added = int(rng.integers(0, max(1, (4 * (size - drop)) // 3 - union + 1)))
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 62, added).astype(np.uint64))))
            if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            for hot in (None, a[: size // 2], a):
                assert len(np.intersect1d(ngram_join.signatures(a, hot), ngram_join.signatures(b, hot)))


def test_join_equals_brute_force(spark):
    texts = [*near_copies(random.Random(8)), None, "", "  ", "a b", "A  b"]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(corpus(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == root


# 3. Line dedup


def test_near_equal_lines_leave_one(spark):
    rng = random.Random(6)
    lines = [prose(rng, 14) for _ in range(60)]
    texts = []
    for i in range(30):
        fuzzy = lines[(i * 7) % 60][:-6] + "zz9 q"
        texts.append("\n".join([lines[i], "", fuzzy.upper() if i % 2 else fuzzy, lines[2 * i]]))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(corpus(spark, texts)).collect()}

    def grams(s):
        s = s.strip().lower()
        return {s[i : i + 8] for i in range(max(len(s) - 7, 1))}

    seen = [(i, n, line, grams(line)) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if line.strip()]
    root = list(range(len(seen)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(seen)):
        for y in range(x):
            a, b = seen[x][3], seen[y][3]
            if len(a & b) >= 0.75 * len(a | b):
                i, j = sorted((find(x), find(y)))
                root[j] = i
    gone = {(seen[x][0], seen[x][1]) for x in range(len(seen)) if find(x) != x}
    for i, t in enumerate(texts):
        assert out[i]["text"] == "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone)


# 4. Quality and 10. Toxicity


def labelled(spark, mark):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(240):
        bad = i % 3 == 0
        texts.append(mark(prose(rng, rng.randint(20, 60)), bad, rng))
        marks.append(int(bad))
    return corpus(spark, texts), spark.createDataFrame([(i, 1 - b, b) for i, b in enumerate(marks)], "doc_id long, quality int, toxic int"), marks


def accuracy(rows, want, by, rest):
    import zlib

    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % by == rest]
    assert len(held) > 20
    return sum((r["score"] >= 0.5) == want(r["doc_id"]) for r in held) / len(held)


def test_quality_on_held_out_rows(spark):
    docs, labels, marks = labelled(spark, lambda t, bad, rng: re.sub(" ", lambda m: rng.choice(["!! ", "$$$ "]), t).upper() if bad else t)
    rows = quality.fit_and_score(docs, labels).collect()
    assert accuracy(rows, lambda i: not marks[i], 3, 1) >= 0.95


def test_one_label_scores_its_share(spark):
    docs, labels, _ = labelled(spark, lambda t, bad, rng: t)
    rows = quality.fit_and_score(docs, labels.withColumn("quality", F.lit(1))).collect()
    assert len({r["score"] for r in rows}) == 1 and rows[0]["score"] > 0.9


def test_coordinate_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0]), np.array([1])]
    w, bias = quality.dual_coordinate_descent(rows, [np.ones(1)] * 4, np.array([1.0, -1.0, 1.0, -1.0]), np.ones(4), 2)
    assert w[0] + bias > 0 > w[1] + bias


def test_toxicity_on_held_out_rows(spark):
    def mark(t, bad, rng):
        words = t.split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "grumbler", "n4styword", "grumblеr"]))
        return " ".join(words)

    docs, labels, marks = labelled(spark, mark)
    rows = toxicity.fit_and_score(docs, labels).collect()
    assert accuracy(rows, lambda i: bool(marks[i]), 5, 0) >= 0.97


def test_folding_and_exceptions():
    assert toxicity.fold("1d1оt, 1234 c@fé a.b") == " idiot  1234 café a b "
    lexicon = toxicity.Lexicon(((" trash ", 5.0), (" mor", 4.0)))
    assert toxicity.matched("Trash the MORON, trash can", lexicon) == (9.0, 2, 5)
    assert toxicity.matched("amor", lexicon) == (0.0, 0, 1)


def test_toxic_weights_equal_a_plain_search():
    """Hits found by looking at every place for every term, exceptions and ties included."""
    rng = random.Random(17)
    lexicon = toxicity.Lexicon(tuple((p, float(w)) for p, w in ((" al", 2), (" alpha ", 3), (" beta", 1.5), (" gam", 4), (" gammas", 5), (" rho ", 2.5))), ("alpha beta", "gammas pi"))
    for _ in range(200):
        text = " ".join(rng.choice(["alpha", "Beta", "g4mmas", "pi", "rho", "rhos", "аlpha"]) for _ in range(rng.randint(0, 12)))
        folded = toxicity.fold(text)
        excused = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?= {p} )", folded)]
        best = {}
        for pattern, weight in lexicon.terms:
            for at in range(len(folded)):
                if folded.startswith(pattern, at) and not any(a <= at < b for a, b in excused):
                    best[at] = max(best.get(at, 0.0), weight)
        total, hits, words = toxicity.matched(text, lexicon)
        assert (round(total, 9), hits, words) == (round(sum(best.values()), 9), len(best), len(folded.split())), text


def test_coordinate_descent_reaches_the_least_loss():
    """The objective of the fitted weights is near that of plain subgradient descent on the same rows."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    values = [rng.normal(size=4) for _ in rows]
    y = np.sign(rng.normal(size=60))
    x = np.zeros((60, 13))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
    x[:, 12] = 1.0
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    w, bias = quality.dual_coordinate_descent(rows, values, y, np.ones(60), 12, epochs=400)
    plain, best = np.zeros(13), np.inf
    for step in range(1, 20_001):
        plain -= (plain - (x * y[:, None])[y * (x @ plain) < 1].sum(0)) / step
        best = min(best, loss(plain))
    assert loss(np.append(w, bias)) <= best * 1.01


# 5. Fingerprints


def test_fingerprints(spark):
    rng = random.Random(9)
    texts = [prose(rng, 300), prose(rng, 280), prose(rng, 300), None, "", "short one"]
    texts.append(texts[0])
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_with_next(corpus(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["fingerprint"] == fingerprint.encoded(fingerprint.digest(np.frombuffer(t.encode(), np.uint8)))
        assert rows[i]["edited_fingerprint"] == fingerprint.encoded(fingerprint.digest(np.frombuffer(edited.encode(), np.uint8)))
    assert rows[0]["fingerprint"] == rows[6]["fingerprint"] and rows[6]["near_next"] == 1.0
    assert 0.2 < rows[0]["near_edited"] < 0.9 and rows[0]["near_next"] < 0.1


def test_sliding_pair_counts():
    data = np.frombuffer(("abcabcaab " * 20 + "xyz" * 40).encode(), np.uint8)
    assert len(fingerprint.features(data)) >= 2
    assert fingerprint.likeness(fingerprint.digest(data), fingerprint.digest(data[: len(data) // 2])) > 0.1


def test_digest_equals_a_plain_version():
    """Windows, entropy, selection and bits, counted one by one."""

    def rarest(data, window, neighbours):
        possible = window * (window - 1) // 2
        ranks = []
        for at in range(len(data) - window + 1):
            part = data[at : at + window]
            pairs = sum(part[i] == part[j] for i in range(window) for j in range(i))
            hashed = int(fingerprint.SpanHash.of_bytes(np.frombuffer(part, np.uint8))(np.array([0]), np.array([window]))[0])
            rank = (1023 - min(1023, abs(pairs - round(0.0618 * possible)))) << 53 | hashed >> 11
            ranks.append((rank | 1 << 63 if pairs >= 0.5 * possible else rank, hashed))
        width = min(neighbours, len(ranks))
        low = {min(ranks[i : i + width])[0] for i in range(len(ranks) - width + 1)}
        return list(dict.fromkeys(h for r, h in ranks if r in low))

    rng = random.Random(21)
    for text in ("", "short", "x" * 40, prose(rng, 5), prose(rng, 20), prose(rng, 60), prose(rng, 700)):
        data = text.encode()
        if len(data) <= 8:
            found = [int(h) for h in fingerprint.SpanHash.of_bytes(np.frombuffer(data, np.uint8))(np.array([0]), np.array([len(data)]))] if data else []
        else:
            found = rarest(data, 8, 12)
        filters = [0] * -(-len(found) // 512)
        for i, h in enumerate(found):
            for k in range(2):
                filters[i // 512] |= 1 << (2047 - (h >> 11 * k) % 2048)
        want = b"".join(f.to_bytes(256, "big") for f in filters)
        assert fingerprint.digest(np.frombuffer(data, np.uint8)).tobytes() == want, text


def test_likeness_is_continuous_in_length():
    """A text to each of its prefixes, across 256 bytes and all other lengths: one byte more changes little."""
    rng = random.Random(3)
    for n in [200, 255, 256, 257, 300, 511, 512, 700, *(rng.randint(200, 700) for _ in range(12))]:
        for data in (bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n)), prose(rng, 150).encode()[:n]):
            whole = np.frombuffer(data, np.uint8)
            chain = fingerprint.digest(whole)
            like = [fingerprint.likeness(chain, fingerprint.digest(whole[:k])) for k in range(19, n + 1)]
            assert max(abs(a - b) for a, b in zip(like, like[1:])) < 0.1 and min(like) > 0.9


def test_likeness_to_half_does_not_depend_on_length():
    rng = random.Random(8)
    for n in (64, 128, 255, 256, 257, 400, 1000, 5000, 40000):
        one, other = (prose(rng, n // 4).encode()[:n] for _ in range(2))
        one, mixed, other = (fingerprint.digest(np.frombuffer(x, np.uint8)) for x in (one, one[: n // 2] + other[: n - n // 2], other))
        assert 0.2 < fingerprint.likeness(one, mixed) < 0.75
        assert fingerprint.likeness(one, other) < 0.2


# 6. Decontamination


def test_filter_keeps_columns_and_clean_rows(spark):
    rng = random.Random(2)
    item = prose(rng, 14)
    docs = corpus(spark, [prose(rng, 30), prose(rng, 10) + " " + item.upper() + "!", None, " ".join(item.split()[:9])])
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    out = decontaminate.without_contamination(docs, bench)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()} == {0: 0, 1: 14, 2: 0, 3: 0}
    large = decontaminate.contamination(docs, bench, broadcast_rows=0)
    assert {r["doc_id"]: r["n_hit"] for r in large.collect()} == {0: 0, 1: 14, 2: 0, 3: 0}


def test_contaminated_rows_without_or_with_repeated_id_go(spark):
    rng = random.Random(2)
    item = prose(rng, 14)
    clean = prose(rng, 30)
    docs = spark.createDataFrame([(None, item, 1), (None, clean, 2), (5, item, 3), (5, clean, 4), (6, None, 5), (5, item, 6)], "doc_id long, text string, tk int")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    out = decontaminate.without_contamination(docs, bench)
    assert out.columns == docs.columns and sorted(r["tk"] for r in out.collect()) == [2, 4, 5]
    for rows in (200_000, 0):
        found = decontaminate.contamination(docs, bench, broadcast_rows=rows).collect()
        assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"]) for r in found) == [(-1, 14, 14, 1), (-1, 30, 0, 0), (5, 14, 14, 1), (5, 14, 14, 1), (5, 30, 0, 0), (6, 0, 0, 0)]


# 7. Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li>A<li>B</ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<main><article><header><h1>The  title</h1></header><p>First &amp; <b>bold</b>&nbsp;text<br>goes on.<p>Second &#233; line.</p>
<ul><li>one<li>two</ul><form><input><label>Mail</label></form><aside>Side</aside><div class="share-buttons social">Share</div></article>
<section id="comments"><p>Nice post</p></section></main><footer>&copy; me</footer></body></html>"""


def test_article_is_kept_and_the_rest_goes():
    assert html_text.main_text(PAGE) == "The title\nFirst & bold text goes on.\nSecond é line.\none\ntwo"


def test_page_without_article_uses_block_rules():
    good = "This is the text of a page that has many of the words that are used in prose and it goes on for quite a while so that it is long enough to be taken as good text by the rules, which is what we want here to be sure."
    page = f"<body><div><a href=x>Home</a> <a href=y>About us</a></div><h2>Heading</h2><p>{good}</p><p>Short bit.</p><p>{good}</p><div>© 2020 nobody</div></body>"
    assert html_text.main_text(page) == f"Heading\n{good}\nShort bit.\n{good}"


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p>a <math><mi>x</mi></math> b</p>", "a x b"),
        ('<p class="legal">L</p><p class="search-notes">S</p><ul class="tags"><li>T</li></ul>', "L\nS\nT"),
        ('<div class="post-header"><h1>Title</h1></div><p>x</p>', "Title\nx"),
        ("<p><a href=u>only a link</a></p>", "only a link"),
        ('<p>t</p><div class="share-buttons">S</div><div class="ad">B</div><div class="related-posts"><p>R</p></div>', "t"),
        ('<p title="x > y">quoted</p>', "quoted"),
    ],
)
def test_what_stays_in_an_article(inside, text):
    assert html_text.main_text(f"<body><nav>m</nav><article>{inside}</article><footer>f</footer></body>") == text


def test_unmatched_quotes_leave_no_markup():
    assert html_text.main_text('<article><p title="x>hello world</article>') == "hello world"


def test_deep_nesting_is_read(spark):
    assert html_text.main_text("<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>a</b></p>", "<script>x", "a & b", "<!-- open", "</div></p>", "<p>&#x1F600;&bogus;</p>"])
def test_malformed_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


# 8. Licences


def test_every_unit_of_a_known_form_is_found(spark):
    """Against the canonical form of every line and text, with spellings, breaks, marks and copyright lines of all kinds."""
    rng = random.Random(12)
    digests = {licenses.canonical_text(t): n for n, t in licenses.KNOWN}
    back = [("license", "licence"), ("noninfringement", "Non-Infringement"), ("noninfringement", "non\ninfringement"), ("version", "v."), ("version", "Ver"), ("copyright", "Copyrighted"), ("percent", "per cent")]
    rights = ["Copyright (c) 2020 Someone", "Copyright Foo Bar 2020", "Copyright (c) The Authors", "(c) 1999-2003 X", "© Copyright X", "# Copyright: 2011 Y", " * copyright © Z\r", "Neither X 2020", ""]
    texts = ["", "é", "v", "licence v é", "copyright holder"]
    for _ in range(250):
        text = rng.choice(licenses.KNOWN)[1]
        for a, b in rng.sample(back, 3):
            text = text.replace(a, b)
        text = "".join(rng.choice([" ", "\n", ", ", " \t"]) if c == " " and rng.random() < 0.1 else c for c in text) if rng.random() < 0.5 else text
        texts.append("\n".join(rng.sample([rng.choice(rights), text, rng.choice([text, "", "plain words"])], rng.randint(1, 3))))
    got = {(r["doc_id"], r["line"], r["license"]) for r in licenses.license_units(corpus(spark, texts)).collect()}
    want = {(i, at, digests[f]) for i, t in enumerate(texts) for at, u in [(-1, t), *enumerate(t.split("\n"))] if (f := " ".join(licenses.canonical_text(u).split(" "))) in digests}
    assert got == want and len(want) > 250


def test_copyright_lines_and_tags(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)
    texts = [f"{line}\n{mit}" for line in ("Copyright Foo Bar 2020", "Copyright (c) The Authors", "Copyright 2020 X", "(c) 2020 X", "© Copyright X", "Copyright: 2020, X")]
    texts += ["SPDX-License-Identifier: " + n for n in ("BSD-3-Clause", "MIT", "GPL-3.0-only", "CC0-1.0")] + [f"Copyright holders\n{mit}"]
    rows = {r["doc_id"]: (r["is_license"], r["licenses"]) for r in licenses.license_scan(corpus(spark, texts)).collect()}
    assert [rows[i] for i in range(11)] == [(True, "MIT")] * 6 + [(True, "BSD-3-Clause"), (True, "MIT"), (True, "GPL-3.0-only"), (True, "CC0-1.0"), (False, "")]


def test_known_texts_of_a_folder(spark, tmp_path):
    rng = random.Random(13)
    long = "Some Public License\n" + "\n".join(prose(rng, 12) for _ in range(300))
    (tmp_path / "Some-1.0.txt").write_text(long)
    (tmp_path / "Other-2.0").write_text("Other terms, version 2")
    known = licenses.texts_in(spark, str(tmp_path))
    assert [n for n, _ in known] == ["Other-2.0", "Some-1.0"]
    docs = corpus(spark, ["Copyright 2021 Me\n" + long.upper().replace("\n", "\n * "), "OTHER TERMS v 2\nmore", long[:-1]])
    rows = {r["doc_id"]: (r["is_license"], r["n_lines"], r["licenses"]) for r in licenses.license_scan(docs, licenses.KNOWN + known).collect()}
    assert rows == {0: (True, 0, "Some-1.0"), 1: (False, 1, "Other-2.0"), 2: (False, 0, "")}
    with pytest.raises(ValueError):
        licenses.texts_in(spark, str(tmp_path), most=1)


def test_license_forms(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)
    texts = ["Copyright (c) 2020 Someone\n" + mit.replace("license", "LICENCE"), "x\nreleased under the MIT licence\ny", "mit", None]
    rows = {r["doc_id"]: (r["is_license"], r["n_lines"], r["licenses"]) for r in licenses.license_scan(corpus(spark, texts)).collect()}
    assert rows == {0: (True, 0, "MIT"), 1: (False, 1, "MIT"), 2: (False, 0, ""), 3: (False, 0, "")}


# 9. Substring dedup


def brute(texts, length=100):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        marks = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                marks[i : i + length] = True
            seen.add(window)
        out.append((bytes(np.frombuffer(data, np.uint8)[~marks]), int(marks.sum()), int((np.diff(np.concatenate(([0], marks.view(np.int8)))) == 1).sum())))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [None, "", "ab" * 300, "ab" * 400]
    for i in range(40):
        a, b = rng.choice(base), rng.choice(base)
        cut, end = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(prose(rng, 5) + a[cut:] + "é" * rng.randint(0, 3) + b[:end] + prose(rng, rng.randint(0, 30)))
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(corpus(spark, texts)).collect()}
    want = brute(texts)
    assert [(bytes(got[i]["kept"]), got[i]["n_bytes"] - len(got[i]["kept"]), len(got[i]["spans"])) for i in range(len(texts))] == want


def test_repeated_and_missing_ids_keep_one_copy(spark):
    rng = random.Random(13)
    text, other = prose(rng, 120), prose(rng, 40)
    rows = [(1, text), (1, text), (1, other + text[:300]), (None, text), (2, text[50:400]), (2, None)]
    got = [(r["doc_id"], bytes(r["kept"]).decode(), r["n_bytes"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 6 and (None, text, len(text.encode())) in got
    assert sum(t.startswith(text[300:]) or text in t for i, t, _ in got if i == 1) >= 1
    kept = "".join(t for i, t, _ in got if i == 1)
    assert all(text[a : a + 100] in kept for a in (0, 350)) and other in kept
    assert len(kept.encode()) <= len((text + other).encode()) + 200
    assert {t for i, t, _ in got if i == 2} == {""}


def test_index_orders_bounded_strings():


    places = substring_dedup.RunLengthIndex(np.tile(np.arange(20, dtype=np.uint8), 2), np.array([0, 20, 40]), 12).repeats()
    assert sorted(places.tolist()) == list(range(20, 29))


def test_merged_spans():
    s, e = substring_dedup.merged(np.array([5, 0, 3, 20]), np.array([8, 4, 5, 21]))
    assert (s.tolist(), e.tolist()) == ([0, 20], [8, 21])


def test_arrow_lists_are_whole():
    assert line_dedup._code_points(["a", "é"])[1].tolist() == [0, 2, 4]
    assert ngram_join.shingle_sets(pa.array(["a b c d e f", None]))[1].size == 0


# Pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_keep_columns_and_follow_their_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_components_of_more_links_join_known_ones(spark):
    links = [(1, 2), (2, 3), (10, 11), (20, 21), (21, 22), (30, 31)]
    more = [(3, 11), (22, 5), (40, 41), (41, 31), (1, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = _links.components(frame(links))
    whole = {tuple(r) for r in _links.components(frame(links + more)).collect()}
    joined = [tuple(r) for r in _links.joined_components(known, frame(more)).collect()]
    assert len(joined) == len(whole) and set(joined) == whole


def test_lines_of_any_characters_compare_as_sets_of_strings():
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))
    lines = ["abcdefghijkl", "abcdefghijkm", "abc", "abc\0", "a\0bcdefghijkl", "éàü" * 9, "éàü" * 8 + "éà", many, many[1:], many[:200] + "x" + many[200:], "\ud800abcdefghijk", "\U0001f600bcdefghijk", "bcdefghijk\U0001f600"]
    grams = lambda t: {t[i : i + 8] for i in range(max(len(t) - 7, 1))}
    same = line_dedup._Same(0.75)
    for x in lines:
        for y in lines:
            one, two = grams(x), grams(y)
            assert same(x, y) == (len(one & two) >= 0.75 * len(one | two)), (x, y)
    assert isinstance(same._grams(lines[0]), np.ndarray) and same._grams(many) is None


def test_wanted_lines_are_those_of_their_digest(spark):
    texts = ["  First Line here \n\n\u3000Straße ÉÉ \x0b\nΑΣ\nshort", None, "", "\n\nİstanbul ist groß\xa0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.line_classes(docs).collect()
    classes = spark.createDataFrame([(r["node"], decimal.Decimal(r["doc_id"] * 2**31 + r["line"])) for r in lines], "node long, at decimal(38,0)")
    found = line_dedup.line_texts(docs, classes, classes.select("node").distinct()).collect()
    assert sorted(r["words"] for r in found) == sorted(filter(None, (x.strip(" \x0b\u3000\xa0") for t in texts for x in (t or "").lower().split("\n"))))
    # A place whose line has another digest gives nothing.
    wrong = classes.withColumn("node", F.col("node") + 1)
    assert line_dedup.line_texts(docs, wrong, wrong.select("node")).count() == 0
