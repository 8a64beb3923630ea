import random

import pandas as pd
from pyspark.sql import functions as F

from scriptorium.operators import answer, connect, evaluate, ground, providers, retrieve, revise, segment
from scriptorium.sources import paged, tables
from scriptorium.streaming import ingest


def book(spark):
    pages = ["Contents\n1\nFirst things\n2\nSecond\nthings\n3\nlost", "2\nbefore", "3\nFirst things 4\nbody one\nbody two\nSecond things\nbody three"]
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)], "doc_id long, page_idx int, text string")
    return rows, paged.page_lines(rows)


def test_mini_book(spark):
    pages, lines = book(spark)
    toc = paged.parse_toc(lines.filter("page_idx = 0"))
    assert [(r["title"], r["printed"]) for r in toc.orderBy("ord").collect()] == [("First things", 2), ("Second things", 3)]
    assert [r["page_idx"] for r in paged.verify_page_offset(pages, lines, 1).collect()] == []
    stream = paged.line_stream(lines.filter("page_idx > 0"))
    located, unlocated = segment.locate_headings(stream, toc)
    assert [(r["title"], r["pos"]) for r in located.orderBy("ord").collect()] == [("First things", 1), ("Second things", 4)]
    assert unlocated.count() == 0
    chunks = segment.build_chunks(stream, located, segment.group_table(spark), limit=12).orderBy("ordinal").collect()
    assert [(c["section"], c["part"], c["n_parts"]) for c in chunks] == [("First things", 0, 3), ("First things", 1, 3), ("First things", 2, 3), ("Second things", 0, 2), ("Second things", 1, 2)]
    assert chunks[1]["text_raw"] == "First things\nbody one"
    assert chunks[0]["chunk_id"] == "003-first-things-p0"


def test_parts_equal_a_greedy_loop(spark):
    rng = random.Random(5)
    cases = [[rng.randint(0, 12) for _ in range(rng.randint(1, 15))] for _ in range(60)] + [[30], [10, 0, 0], [30, 30, 1], [19, 20, 21, 0], [rng.randint(0, 9) for _ in range(25_000)]]

    def loop(sizes, limit=20):
        out, part, size, held = [], 0, 0, False
        for n in sizes:
            if held and size + n > limit:
                part, size = part + 1, 0
            out.append(part)
            size, held = size + n + 1, True
        return out

    rows = spark.createDataFrame([(k, None if k % 2 else "x", i, 1, "y" * n) for k, c in enumerate(cases) for i, n in enumerate(c)], "doc_id long, title string, pos long, page int, line string").repartition(6)
    got = segment.split_sections(rows, ["doc_id", "title"], 20).collect()
    parts, last = {(r["doc_id"], r["pos"]): r["part"] for r in got}, {r["doc_id"]: r["n_parts"] for r in got}
    for k, c in enumerate(cases):
        want = loop(c)
        assert [parts[k, i] for i in range(len(c))] == want and last[k] == want[-1] + 1


def test_headings_equal_a_plain_search(spark):
    """Titles of one, two and more words, repeated, nested in each other, against lines that begin alike."""
    rng = random.Random(8)
    words = ["fast", "fasting", "of", "the", "rules", "a", "chapter"]
    streams = [[" ".join(rng.choices(words, k=rng.randint(1, 5))) + rng.choice(["", " 12", "."]) for _ in range(80)] for _ in range(12)]
    entries = [[" ".join(rng.choices(words, k=rng.randint(1, 4))).title() for _ in range(15)] + [""] for _ in range(12)]
    lines = spark.createDataFrame([(d, i, i // 9 + 1, x) for d, s in enumerate(streams) for i, x in enumerate(s)], "doc_id long, pos long, page int, line string")
    toc = spark.createDataFrame([(d, i, t, 1) for d, s in enumerate(entries) for i, t in enumerate(s)], "doc_id long, ord int, title string, printed int")
    located, unlocated = segment.locate_headings(lines.repartition(3), toc)
    fold = lambda x: " ".join("".join(c for c in x.lower() if not c.isdigit() and c != ".").split())

    def matches(line, title):
        probe = " ".join(title.split()[:3]) if len(title.split()) >= 3 else None
        return bool(line and title) and (line.startswith(title) or title.startswith(line) or (probe is not None and line.startswith(probe) and abs(len(line) - len(title)) <= 12))

    want, lost = set(), set()
    for d in range(12):
        cursor = -1
        for i, t in enumerate(entries[d]):
            hit = next((p for p, x in enumerate(streams[d]) if p > cursor and matches(fold(x), fold(t))), None)
            if hit is None:
                lost.add((d, i))
            else:
                want.add((d, i, hit, hit // 9 + 1))
                cursor = hit
    assert {(r["doc_id"], r["ord"], r["pos"], r["page"]) for r in located.collect()} == want and want
    assert {(r["doc_id"], r["ord"]) for r in unlocated.collect()} == lost


def test_group_expansion_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    groups = {f"c{i}": (f"g{rng.randint(0, 3)}" if rng.random() < 0.6 else None) for i in range(14)}
    chunks = spark.createDataFrame([(c, i, g) for i, (c, g) in enumerate(groups.items())], "chunk_id string, ordinal long, group_id string")
    order = {c: i for i, c in enumerate(groups)}
    results, want = [], []
    for q in range(25):
        picked = rng.sample(list(groups), 5)
        results += [(q, c, 1.0 / (k + 1), k + 1, "rerank") for k, c in enumerate(picked)]
        done = []
        for k, c in enumerate(picked):
            members = [c] + ([x for x in sorted(groups, key=order.get) if groups[x] == groups[c]] if groups[c] else [])
            for m in members:
                if m not in [d[0] for d in done]:
                    done.append((m, 1.0 / (picked.index(m) + 1), "rerank") if m in picked else (m, 1.0 / (k + 1), "group-expansion"))
        want.append(done)
    got = retrieve.expand_groups(spark.createDataFrame(results, "query_id long, chunk_id string, score double, rank int, source string"), chunks)
    rows = got.orderBy("query_id", "rank").collect()
    assert [[(r["chunk_id"], r["score"], r["source"]) for r in rows if r["query_id"] == q] for q in range(25)] == want


def test_fusion_orders_ties_by_lists(spark):
    lists = "query_id int, chunk_id string, ordinal long, score double, rank int"
    a = spark.createDataFrame([(1, "x", 1, 9.0, 1), (1, "y", 2, 8.0, 2)], lists)
    b = spark.createDataFrame([(1, "z", 3, 0.9, 1), (1, "y", 2, 0.8, 2)], lists)
    assert [r["chunk_id"] for r in retrieve.rrf(a, b).orderBy("rank").collect()] == ["y", "x", "z"]


def test_gate_edges(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = retrieve.gate(asked, spark.createDataFrame([(1, 0.74), (2, 0.73)], "query_id int, score double"))
    assert [(r["top_score"], r["is_confident"]) for r in got.orderBy("query_id").collect()] == [(0.74, True), (0.73, False), (0.0, False)]


def test_items(spark):
    body = "intro line\n1) To wash the whole body once\ncontinued here13\n2 & 3) Short\n10 The footnote text\n4. It is sunnah for someone to sit down properly\n5) Wash the entire face with clean water"
    got = revise.extract_items(spark.createDataFrame([("c", 0, body)], "chunk_id string, ordinal long, text_raw string"))
    assert [(r["item_no"], r["item"]) for r in got.orderBy("item_no").collect()] == [(1, "To wash the whole body once continued here"), (4, "Wash the entire face with clean water")]


def pool(spark):
    rows = [(i, f"item number {i} " + "x" * (i % 17), "c", cat, "k", "s", 1, 2) for i, cat in enumerate(["fard"] * 6 + ["wajib"] * 5 + ["sunnah"] * 2 + ["nullifier"] * 3)]
    return spark.createDataFrame(rows, "item_idx long, item string, chunk_id string, category string, collection string, section string, page_start int, page_end int")


def test_selection_invariants(spark):
    items = pool(spark)
    assert {(r["category"], r["n_correct"], r["n_wrong"]) for r in revise.quiz_targets(items).collect()} == {("fard", 6, 7), ("wajib", 5, 8), ("sunnah", 2, 11)}
    options = revise.shuffle_options(revise.select_items(items, 3, seed=1), seed=1)
    again = revise.shuffle_options(revise.select_items(items.repartition(3), 3, seed=1), seed=1)
    assert sorted(map(tuple, options.collect())) == sorted(map(tuple, again.collect()))
    stems = options.select("collection", "category", "question_no").distinct().withColumn("question", F.lit("Which?")).withColumn("explanation", F.lit(""))
    made, failed = revise.assemble_questions(options, items, stems)
    assert failed.count() == 0
    for q in made.collect():
        assert len(q["options"]) == 4 and 0 <= q["correct_index"] <= 3 and q["category"] not in q["distractor_categories"]
    _, failed = revise.assemble_questions(options, items, stems.withColumn("question", F.lit(" ")))
    assert {r["check"] for r in failed.collect()} == {"empty_stem"}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, "Polarity trap", False, False, "agrees", "v", True, []), (2, "x", False, True, "agrees", "v", None, [3]), (3, "y", True, True, None, None, None, [])], "query_id int, category string, should_abstain boolean, abstained boolean, judged string, variant_group string, recall boolean, unverified_pages array<int>")
    judged = evaluate.verdicts(rows)
    got = {r["metric"]: (r["passed"], r["total"]) for r in evaluate.metrics(judged).collect()}
    assert got == {"behaviour": (2, 3), "ruling agreement": (1, 2), "abstention (should abstain)": (1, 1), "polarity accuracy": (1, 1), "recall@context": (1, 2), "citation validity": (2, 3), "variant agreement": (0, 1)}


def test_citations_outside_the_context_are_dropped(spark):
    context = spark.createDataFrame([(1, "c", 1, 4, 5)], "query_id int, chunk_id string, pos int, page_start int, page_end int")
    cites = spark.createDataFrame([(1, 0, "a"), (1, 7, "b"), (1, -1, "c")], "query_id int, document_index int, cited_text string")
    assert [r["cited_text"] for r in ground.resolve_citations(cites, context).collect()] == ["a"]


def test_batches_by_tokens():
    frame = pd.DataFrame({"text": ["aaa", "bb", "cccccccc", "d", "e"]})
    assert [list(b["text"]) for b in connect.batches_by_tokens(iter([frame]), len, 5)] == [["aaa", "bb"], ["cccccccc"], ["d", "e"]]


def test_labels_prefer_overrides_and_fail_without_any(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    props = spark.createDataFrame([("a", ["p"]), ("b", ["q"])], "id string, chunk_ids array<string>")
    over = spark.createDataFrame([("b", ["o"])], "id string, chunk_ids array<string>")
    assert {r["id"]: r["expected_chunk_ids"] for r in tables.apply_labels(asked, props, over).collect()} == {"a": ["p"], "b": ["o"]}
    try:
        tables.apply_labels(asked, props.filter("id = 'b'"), over).collect()
    except Exception as e:
        assert "no label for question" in str(e)
    else:
        raise AssertionError


def test_stored_embeddings_only_makes_what_is_missing(spark):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_id string, text string")
    embedder = providers.HashedEmbedder(dim=8)
    none = spark.createDataFrame([], tables.EMBEDDING_SCHEMA)
    first = providers.stored_embeddings(chunks, none, embedder)
    assert first.count() == 2
    changed = chunks.withColumn("text", F.when(F.col("chunk_id") == "b", "four").otherwise(F.col("text")))
    assert [r["chunk_id"] for r in providers.stored_embeddings(changed, first, embedder).collect()] == ["b"]


def test_stream_ingests_each_document_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), limit=3).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("part").collect()
    assert [r["text_raw"] for r in rows] == ["a\nb", "c"] or [r["text_raw"] for r in rows] == ["a", "b", "c"]


def test_rewrites_keep_a_backup_and_lose_nothing(spark, tmp_path):
    path, backup = f"{tmp_path}/golden", f"{tmp_path}/golden.bak"
    spark.createDataFrame([("a", "x"), ("b", "y")], "id string, question string").write.json(path)
    labelled = spark.createDataFrame([("a", "x", ["c"]), ("b", "y", None)], "id string, question string, expected_chunk_ids array<string>")
    for again in (False, True):
        tables.rewrite_questions(labelled, path, backup)
        assert {r["id"]: r["expected_chunk_ids"] for r in spark.read.json(path).collect()} == {"a": ["c"], "b": None}
        assert spark.read.json(backup).columns == ["id", "question"]
    for less in (labelled.drop("question"), labelled.filter("id = 'a'")):
        try:
            tables.rewrite_questions(less, path, backup)
        except ValueError as e:
            assert "would be lost" in str(e)
        else:
            raise AssertionError
    assert spark.read.json(path).count() == 2
    tables.write_proposals(labelled.select("id", "expected_chunk_ids"), f"{tmp_path}/proposals")
    assert spark.read.json(f"{tmp_path}/proposals").count() == 2


def test_chunk_tables_and_runs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "chunk_id string, collection string, page int")
    tables.write_chunks(rows, f"{tmp_path}/chunks")
    assert sorted((r["chunk_id"], r["page"]) for r in tables.read_table(spark, f"{tmp_path}/chunks").filter("collection = 'y'").collect()) == [("b", 2)]
    for run in ("r1", "r2"):
        tables.append_run(rows, f"{tmp_path}/runs", run, {"gate": "0.74"})
    last = tables.latest_run(spark.read.parquet(f"{tmp_path}/runs")).collect()
    assert [r["run_id"] for r in last] == ["r2", "r2"] and last[0]["settings"] == {"gate": "0.74"}


def test_correct_texts_are_asked_once(spark):
    items = [(i, f"the very same text number {i // 2}", "fard" if i < 6 else "wajib", "k") for i in range(14)]
    pool = spark.createDataFrame(items, "item_idx long, item string, category string, collection string")
    right = revise.select_items(pool, 5, seed=1).filter("slot = 0 AND category = 'fard'").join(pool.select("item_idx", "item"), "item_idx").collect()
    assert len(right) == len({r["item"] for r in right}) == 3
    missing = revise.no_pool(spark.createDataFrame([("k", "fard"), ("k", "adab")], "collection string, category string"), revise.select_items(pool, 1, seed=1)).collect()
    assert [(r["category"], r["check"]) for r in missing] == [("adab", "no_pool")]


def test_deck_discards_ungrounded_and_repeated_cards(spark):
    text = "purity of water in plain words " * 20
    rows = [("a", 1, "k", "one", text, 1, 2, 0), ("b", 2, "k", "two", text, 3, 3, 0), ("c", 3, "k", "two", "short", 4, 4, 0)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ordinal long, collection string, section string, text_raw string, page_start int, page_end int, part int")

    class Writer:
        def write(self, passages):
            cards = F.array(F.struct(F.lit("Water?").alias("front"), F.lit("purity of water").alias("back")), F.struct(F.lit("Stars?").alias("front"), F.lit("distant galaxies glitter").alias("back")))
            return passages.select("chunk_id", F.posexplode(cards).alias("card_no", "card")).select("chunk_id", "card_no", "card.front", "card.back")

    cards, fails, report, sections = revise.build_deck(chunks, Writer())
    assert [(r["chunk_id"], r["front"], r["source_page"]) for r in cards.collect()] == [("a", "Water?", 1)]
    assert sorted(r["check"] for r in fails.collect()) == ["card_grounding", "card_grounding", "duplicate_front"]
    r = report.collect()[0]
    assert (r["passages"], r["cards"], r["discarded"], r["pages_total"], r["pages_covered"]) == (2, 1, 3, 4, 2)
    assert [(s["section"], s["n"], s["place"]) for s in sections.collect()] == [("one", 1, 1)]


def test_answers_abstain_refuse_and_cite(spark):
    asked = spark.createDataFrame([(1, "what is water"), (2, "which galaxies shine"), (3, "low")], "query_id long, question string")
    ranked = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "b", 0.9, 1), (3, "a", 0.1, 1)], "query_id long, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "one", "k", "water is wet", 1, 2, 0, 0), ("b", "two", "k", "earth is dry", 3, 3, 0, 1)], "chunk_id string, section string, collection string, text_raw string, page_start int, page_end int, part int, ordinal long")
    rows = {r["query_id"]: r for r in answer.answer(asked, ranked, chunks, providers.ExtractiveGenerator(), least=0.5).collect()}
    assert rows[1]["text"].startswith("water is wet") and not rows[1]["abstained"] and rows[1]["unverified_pages"] == []
    assert [(c["chunk_id"], c["section"], c["cited_text"]) for c in rows[1]["citations"]] == [("a", "one", "water is wet")]
    assert (rows[2]["abstain_reason"], rows[2]["text"], rows[2]["citations"]) == ("refusal", answer.REFUSAL, None)
    assert (rows[3]["abstain_reason"], rows[3]["text"]) == ("low-confidence", answer.LOW_CONFIDENCE)


def test_word_for_word_questions_are_found(spark):
    texts = ["so he said and went", "he said", "nothing", None, "she said and went home today"]
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "chunk_id string, ordinal long, text_raw string")
    asked = ["he said and went", "said", "e said and wen", "and", "he sai", "no such words here", "said and went"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    got = {(r["query_id"], r["ordinal"]) for r in retrieve.containing(chunks, queries).collect()}
    assert got == {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if t and q in t}


def test_coverage_ranks_equal_a_plain_version(spark):
    rng = random.Random(4)
    words = ["water", "purity", "stream", "vessel", "garden", "market", "journey", "river"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    asked = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(8)] + ["unknown terms"]
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "chunk_id string, ordinal long, text_raw string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    got = {}
    for r in retrieve.coverage_ranks(chunks, queries, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["ordinal"], r["score"]))
    for i, q in enumerate(asked):
        terms = set(q.split())
        scored = sorted(((round(len(terms & set(t.split())) / len(terms), 6), j) for j, t in enumerate(texts)), key=lambda x: (-x[0], -x[1]))
        assert got[i] == [(j, s) for s, j in scored[:10]]


def test_heading_joins_neither_broadcast_nor_hold_every_beginning(spark, tmp_path):
    """Small files of long titles: before, each title was a row for each of its beginnings, broadcast by the size of its file."""
    spark.range(40).selectExpr("id % 4 AS doc_id", "id div 4 AS pos", "1 AS page", "concat('a heading of many letters and words ', id) AS line").write.parquet(f"{tmp_path}/lines")
    stream = spark.read.parquet(f"{tmp_path}/lines")
    toc = stream.select("doc_id", F.col("pos").cast("int").alias("ord"), F.col("line").alias("title"), F.col("page").alias("printed"))
    lines, titles = segment._heading_keys(stream.select("doc_id", F.col("line").alias("line_key")), toc.select("doc_id", F.col("title").alias("title_key")))
    assert lines.count() <= 3 * 40 and titles.count() <= 3 * 40
    located, unlocated = segment.locate_headings(stream, toc)
    chunks = segment.split_sections(segment.section_lines(stream, located), ["doc_id", "ord"])
    for df in (located, unlocated, chunks):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString()
    assert located.count() == 40 and unlocated.count() == 0


def test_decks_are_planned_without_moving_texts(spark, tmp_path):
    """Before, whole texts went to the one task that orders a collection's passages."""
    spark.range(20).selectExpr("cast(id AS string) AS chunk_id", "'c' AS collection", "'s' AS section", "id AS page_start", "0 AS part", "id AS ordinal", "repeat('word ', 300) AS text_raw").write.parquet(f"{tmp_path}/chunks")
    units = revise.plan_deck(spark.read.parquet(f"{tmp_path}/chunks"))
    plan = spark._jvm.PythonSQLUtils.explainString(units._jdf.queryExecution(), "formatted")
    moved = [block for block in plan.split("\n\n") if "Exchange\n" in block]
    assert moved and not any("text_raw" in block for block in moved)
    assert sorted(r["unit_no"] for r in units.collect()) == list(range(1, 21))


def test_questions_take_a_few_items_of_each_category(spark, monkeypatch):
    """Before, a task ordered all items that a question could take."""
    pool = spark.createDataFrame([(i, f"item number {i:04d}", f"k{i % 2}", ("fard", "wajib", "sunnah")[i % 3]) for i in range(300)], "item_idx long, item string, collection string, category string")
    want = sorted(map(tuple, revise.select_items(pool, 2, seed=3).collect()))
    assert len(want) == 2 * 3 * 2 * 4
    monkeypatch.setattr(revise, "kept", lambda df: df)
    whole = revise.select_items(pool, 2, seed=3)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert any("WindowGroupLimit" in line and "wrong_category" in line for line in plan.splitlines())
    assert sorted(map(tuple, whole.collect())) == want


def test_headings_move_a_line_once_and_no_longer_than_titles(spark, monkeypatch):
    """Before, a line moved whole for each of its keys, here one for each length of a one-word title."""
    rng = random.Random(3)
    titles = ["abcdefghijklmnopqrstuvwxyz"[:n] for n in range(2, 27)] + ["one two three", "one two three four", "zzz", "", None]
    ends = ["", "x" * 12, "x" * 13, " " + "more " * 60]
    lines = [rng.choice(titles[:-3]) + rng.choice(ends) for _ in range(12_000)] + ["one two th", "one two three" + "y" * 13, "one two three" + "y" * 12]
    stream = spark.createDataFrame([(d, i, i // 9 + 1, x) for d, many in ((1, lines), (2, lines[-3:]), (None, lines[:5])) for i, x in enumerate(many)], "doc_id long, pos long, page int, line string")
    toc = spark.createDataFrame([(d, i, t, i) for d in (1, 2, 3, None) for i, t in enumerate(rng.sample(titles, len(titles)))], "doc_id long, ord int, title string, printed int")
    want, lost, cursor = set(), set(), -1
    for d, i, t, _ in sorted((tuple(r) for r in toc.collect()), key=lambda r: (r[0] is None, r[0], r[1])):
        cursor = -1 if i == 0 else cursor
        t, found = t or "", None
        probe = " ".join(t.split()[:3]) if len(t.split()) >= 3 else None
        for p, x in enumerate({1: lines, 2: lines[-3:]}.get(d, [])):
            x = x.strip()
            if p > cursor and t and (x.startswith(t) or t.startswith(x) or (probe and x.startswith(probe) and abs(len(x) - len(t)) <= 12)):
                found = cursor = p
                break
        (want if found is not None else lost).add((d, i, found, found // 9 + 1) if found is not None else (d, i))
    located, unlocated = segment.locate_headings(stream, toc)
    assert {(r["doc_id"], r["ord"], r["pos"], r["page"]) for r in located.collect()} == want and len(want) > 20
    assert {(r["doc_id"], r["ord"]) for r in unlocated.collect()} == lost
    monkeypatch.setattr(segment, "kept", lambda df: df)
    located, _ = segment.locate_headings(stream, toc)
    plan = located._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1 and ", 1, 26) AS key" in plan


def test_text_stream_equals_the_line_stream_and_moves_nothing(spark):
    texts = ["1\na\n\n b \nc\nd\n2\nʧʧʧ\ne\n 3 \n4", "", None, "ṣabc ʧʧ\nx\n\t\ny", "2\n1\n1\n1\n2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for per in (None, 1, 2, 4):
        own = paged.text_stream(docs, per)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, paged.line_stream(paged.text_lines(docs, per)).collect()))
        assert own.dtypes == paged.line_stream(paged.text_lines(docs, per)).dtypes
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()


def test_chunks_equal_a_plain_loop_and_move_texts_once(spark, monkeypatch):
    """Before, lines moved for sections, parts, counts, groups and numbers each."""
    rng = random.Random(6)
    docs = {d: ["w" * rng.randint(0, 9) + str(i) for i in range(n)] for d, n in ((1, 40), (2, 1), (3, 12_500), (4, 7))}
    heads = {d: {p: o for o, p in enumerate(sorted(rng.sample(range(len(x)), min(len(x), 6))))} for d, x in docs.items() if d != 4}
    stream = spark.createDataFrame([(d, i, i // 4 + 1, x) for d, many in docs.items() for i, x in enumerate(many)] + [(None, 0, 1, "x")], "doc_id long, pos long, page int, line string").repartition(3)
    located = spark.createDataFrame([(d, o, f"title {o % 4}", o, p, p // 4 + 1) for d, x in heads.items() for p, o in x.items()], "doc_id long, ord int, title string, printed int, pos long, page int")
    groups = spark.createDataFrame([("title 1", "g", "negative")], "title_folded string, group_id string, polarity string")
    want = []
    for d, lines in docs.items():
        ord_ = None
        for p, line in enumerate(lines):
            if p in heads.get(d, {}):
                ord_, part, size = heads[d][p], 0, 0
                want.append([d, ord_, part, p // 4 + 1, p // 4 + 1, [line]])
            elif ord_ is None:
                continue
            elif size + len(line) > 30:
                part, size = part + 1, 0
                want.append([d, ord_, part, p // 4 + 1, p // 4 + 1, [line]])
            else:
                want[-1][4:] = [p // 4 + 1, [*want[-1][5], line]]
            size += len(line) + 1
    many = {(w[0], w[1]): w[2] + 1 for w in want}
    chunks = segment.build_chunks(stream, located, groups, limit=30)
    got = chunks.orderBy("ordinal").collect()
    assert len(got) == len(want) > 2000 and [r["ordinal"] for r in got] == list(range(len(want)))
    for r, (d, o, part, first, last, lines) in zip(got, want, strict=True):
        title = f"title {o % 4}"
        assert (r["doc_id"], r["section"], r["part"], r["n_parts"], r["page_start"], r["page_end"]) == (d, title, part, many[d, o], first, last)
        assert r["text_raw"] == "\n".join(([title] if part else []) + lines) and r["group_id"] == ("g" if o % 4 == 1 else None)
    monkeypatch.setattr(segment, "kept", lambda df: df)
    plan = spark._jvm.PythonSQLUtils.explainString(segment.build_chunks(stream, located, groups, limit=30)._jdf.queryExecution(), "formatted")
    moved = [block for block in plan.split("\n\n") if "Exchange\n" in block and any(x in block for x in (", line#", "[line#", "body#", "text_raw#"))]
    assert len([block for block in moved if "REPARTITION_BY_NUM" not in block]) == 1
