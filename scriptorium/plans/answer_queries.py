"""Queries of grounding, items, questions, decks and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import answer, evaluate, ground, providers, retrieve, revise, segment
from ..scratch import kept
from . import base, retrieval_queries
from .base import SQL_CHUNKS, sql_words, table
from .text_queries import sql_stem

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer a conversation turn, with pages named in it."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    page = F.col("query_id") % 50 + 1
    said = F.concat("text", F.lit(" See pp. "), page.cast("string"), F.lit("-"), (page + F.col("query_id") % 25).cast("string"), F.lit(" and page "), (page + 3).cast("string"), F.lit("."))
    return turns.select("query_id", said.alias("text"), page.cast("int").alias("page"))


@query("""
WITH a AS (SELECT conv_id * 1000 + turn AS query_id, (conv_id * 1000 + turn) % 50 + 1 AS p, (conv_id * 1000 + turn) % 25 AS w FROM conversations),
claimed AS (SELECT query_id, unnest(CASE WHEN w > 20 THEN [p, p + 3] ELSE list_append(generate_series(p, p + w), p + 3) END) AS page FROM a),
seen AS (SELECT query_id, unnest(generate_series(p, p + 5)) AS page FROM a)
SELECT a.query_id, coalesce((SELECT string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FROM (SELECT page FROM claimed c WHERE c.query_id = a.query_id EXCEPT SELECT page FROM seen s WHERE s.query_id = a.query_id)), '') AS unverified FROM a
""")
def verify_citations(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf)
    context = answers.select("query_id", F.col("page").alias("page_start"), (F.col("page") + 5).alias("page_end"))
    return ground.verify_citations(answers, context).select("query_id", F.array_join(F.col("unverified_pages").cast("array<string>"), ",").alias("unverified"))


@query(f"WITH {SQL_CHUNKS} SELECT collection AS query_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT collection, unnest(generate_series(page_start, page_end)) AS page FROM c) GROUP BY 1")
def pages_covered(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.chunks(spark, sf).select(F.col("collection").alias("query_id"), "page_start", "page_end")
    return ground.pages_covered(rows).select("query_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


_STEMS = f"list_distinct(list_transform({{}}, lambda w: {sql_stem('w')}))"
_BACK, _SOURCE = (_STEMS.format(sql_words(x, rules.STOP_WORDS)) for x in ("back", "source_text"))


@query(f"SELECT card_id, round(CASE WHEN len(b) > 0 THEN len(list_intersect(b, s)) / CAST(len(b) AS DOUBLE) ELSE 0 END, 6) AS overlap FROM (SELECT card_id, {_BACK} AS b, {_SOURCE} AS s FROM (SELECT conv_id * 1000 + turn AS card_id, c.text AS back, d.text AS source_text FROM conversations c JOIN documents d ON d.doc_id = conv_id))")
def grounding_overlap(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("card_id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("back"), F.lit("").alias("front"))
    cards = turns.join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("source_text")), "doc_id")
    return ground.ground_cards(cards).select("card_id", F.round("overlap", 6).alias("overlap"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose lines, but every fifth, begin with their number; the category is that of the document's language."""
    rows = table(spark, sf, "documents")
    said = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 4, x).otherwise(F.concat((i + 1).cast("string"), F.lit(") "), x)))
    category = F.create_map(*[F.lit(x) for x in ("en", "fard", "fr", "wajib", "de", "sunnah", "es", "makruh")])
    return rows.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("ordinal"), F.array_join(said, "\n").alias("text_raw"), F.coalesce(F.try_element_at(category, F.col("lang")), F.lit("general")).alias("category"), F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")).alias("collection"), F.col("source").alias("section"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"))


_ITEMS = f"""
n AS (SELECT doc_id, i, trim(regexp_replace(CASE WHEN (i - 1) % 5 = 4 THEN line ELSE CAST(i AS VARCHAR) || ') ' || line END, '^\\s+|\\s+$', '', 'g')) AS line FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
b AS (SELECT *, regexp_matches(line, '^(\\d{{1,3}})(?:\\s*&\\s*\\d{{1,3}})?[).]\\s*(.+)$') AS begins FROM n WHERE line <> '' AND NOT regexp_matches(line, '^\\d{{1,3}}\\s+[A-Z(‘"]')),
g AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS item_no FROM b),
j AS (SELECT doc_id, item_no, regexp_replace(trim(regexp_replace(string_agg(CASE WHEN begins THEN regexp_extract(line, '^(\\d{{1,3}})(?:\\s*&\\s*\\d{{1,3}})?[).]\\s*(.+)$', 2) ELSE line END, ' ' ORDER BY i), '\\s+', ' ', 'g')), '(\\pL)\\d{{1,2}}\\b', '\\1', 'g') AS item FROM g WHERE item_no > 0 GROUP BY ALL),
it AS (SELECT doc_id, item_no, item FROM j WHERE len(item) BETWEEN 12 AND 220 AND len({_STEMS.format(sql_words("item", rules.STOP_WORDS))}) >= 3 AND NOT regexp_matches(item, '(?i){rules.SELF_DECLARING}')),
pool AS (SELECT row_number() OVER (ORDER BY doc_id, item_no) - 1 AS item_idx, item, it.doc_id, CASE lang WHEN 'en' THEN 'fard' WHEN 'fr' THEN 'wajib' WHEN 'de' THEN 'sunnah' WHEN 'es' THEN 'makruh' ELSE 'general' END AS category, 'k' || CAST(it.doc_id % 3 AS VARCHAR) AS collection FROM it JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr', 'de', 'es'))"""


@query(f"WITH {_ITEMS} SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(item_no AS INT) AS item_no, item FROM it")
def extract_items(spark: SparkSession, sf: str) -> DataFrame:
    return revise.extract_items(_numbered(spark, sf)).select("chunk_id", "item_no", "item")


@query(f"WITH {_ITEMS} SELECT item_idx, item, CAST(doc_id AS VARCHAR) AS chunk_id, category, collection FROM pool")
def item_pool(spark: SparkSession, sf: str) -> DataFrame:
    return revise.item_pool(_numbered(spark, sf)).select("item_idx", "item", "chunk_id", "category", "collection")


@query(f"WITH {_ITEMS}, n2 AS (SELECT collection, category, count(*) AS n_correct FROM pool GROUP BY ALL) SELECT * FROM (SELECT collection, category, n_correct, CAST(sum(n_correct) OVER (PARTITION BY collection) - n_correct AS BIGINT) AS n_wrong FROM n2) WHERE n_wrong >= 3")
def mcq_targets(spark: SparkSession, sf: str) -> DataFrame:
    return revise.quiz_targets(revise.item_pool(_numbered(spark, sf)))


def _selected(n: int) -> str:
    """SQL of revise.select_items with seed 7, as a CTE named sel."""
    return f"""
k AS (SELECT collection, category, item_idx, item, len(item) AS chars FROM pool),
kd AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY collection, category, item ORDER BY md5(concat_ws(':', '7', CAST(item_idx AS VARCHAR))), item_idx) = 1),
cr AS (SELECT collection, category, item_idx AS cidx, chars AS target, row_number() OVER (PARTITION BY collection, category ORDER BY md5(concat_ws(':', '7', CAST(item_idx AS VARCHAR))), item_idx) AS qn FROM kd QUALIFY qn <= {n}),
p AS (SELECT cr.*, k.category AS wc, k.item_idx, k.chars, chars BETWEEN target / 1.6::DOUBLE AND target * 1.6::DOUBLE AS i0, chars BETWEEN target / 2.4::DOUBLE AND target * 2.4::DOUBLE AS i1 FROM cr JOIN k ON k.collection = cr.collection AND k.category <> cr.category),
bd AS (SELECT *, CASE WHEN count_if(i0) OVER q >= 3 THEN 0 WHEN count_if(i1) OVER q >= 3 THEN 1 ELSE 2 END AS band FROM p WINDOW q AS (PARTITION BY collection, category, qn)),
kp AS (SELECT *, md5(concat_ws(':', '7', CAST(cidx AS VARCHAR), CAST(item_idx AS VARCHAR))) AS draw FROM bd WHERE (band = 0 AND i0) OR (band = 1 AND i1) OR band = 2),
sz AS (SELECT *, count(*) OVER (PARTITION BY collection, category, qn, wc) AS size, row_number() OVER (PARTITION BY collection, category, qn, wc ORDER BY draw, item_idx) AS nth FROM kp),
rk AS (SELECT *, row_number() OVER (PARTITION BY collection, category, qn ORDER BY CASE WHEN nth = 1 THEN 0 ELSE 1 END, CASE WHEN nth = 1 THEN -size END NULLS FIRST, CASE WHEN nth = 1 THEN wc END NULLS FIRST, draw, item_idx) AS slot, count(*) OVER (PARTITION BY collection, category, qn) AS n FROM sz),
ch AS (SELECT * FROM rk WHERE n >= 3 AND slot <= 3),
sel AS (SELECT collection, category, CAST(qn AS INT) AS question_no, CAST(slot AS INT) AS slot, item_idx, wc AS item_category FROM ch UNION ALL SELECT collection, category, CAST(qn AS INT), 0, cidx, category FROM ch WHERE slot = 1)"""


@query(f"WITH {_ITEMS}, {_selected(5)} SELECT * FROM sel")
def select_items(spark: SparkSession, sf: str) -> DataFrame:
    return revise.select_items(revise.item_pool(_numbered(spark, sf)), 5, seed=7).select("collection", "category", "question_no", "slot", "item_idx", "item_category")


@query(f"""WITH {_ITEMS}, {_selected(3)},
op AS (SELECT sel.*, row_number() OVER (PARTITION BY sel.collection, sel.category, question_no ORDER BY md5(concat_ws(':', '7', 'shuffle', sel.category, CAST(question_no AS VARCHAR), CAST(item_idx AS VARCHAR))), item_idx) - 1 AS position, regexp_replace(trim(regexp_replace(trim(item), '^To ', '')), '\\d+$', '') AS o, source FROM sel JOIN pool USING (item_idx) JOIN documents USING (doc_id))
SELECT collection, category, question_no, string_agg(upper(left(o, 1)) || substr(o, 2), '|' ORDER BY position) AS options, max(CASE WHEN slot = 0 THEN position END) AS correct_index, 1 AS source_page, max(CASE WHEN slot = 0 THEN source END) AS section, string_agg(DISTINCT CASE WHEN slot > 0 THEN item_category END, ',' ORDER BY CASE WHEN slot > 0 THEN item_category END) AS distractors, 'Which of these is filed under ' || category || '?' AS question
FROM op GROUP BY collection, category, question_no HAVING count(*) = 4""")
def assembled_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with shuffled options and stand-in stems."""
    pool = revise.item_pool(_numbered(spark, sf))
    options = revise.shuffle_options(revise.select_items(pool, 3, seed=7), seed=7)
    stems = options.select("collection", "category", "question_no").distinct().withColumn("question", F.concat(F.lit("Which of these is filed under "), "category", F.lit("?"))).withColumn("explanation", F.lit(""))
    good = revise.assemble_questions(options, pool, stems)[0]
    return good.select("collection", "category", "question_no", F.array_join("options", "|").alias("options"), F.col("correct_index").cast("long").alias("correct_index"), "source_page", "section", F.array_join("distractor_categories", ",").alias("distractors"), "question")


@query(f"WITH {_ITEMS}, {_selected(1)} SELECT collection, category, 'no_pool' AS \"check\" FROM (SELECT collection, category FROM (SELECT DISTINCT collection FROM pool), (VALUES ('adab'), ('fard'), ('sunnah')) v(category) EXCEPT SELECT collection, category FROM sel)")
def no_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Requested questions of three categories in every collection; one of them has no items."""
    pool = revise.item_pool(_numbered(spark, sf))
    requested = pool.select("collection").distinct().select("collection", F.explode(F.array(*map(F.lit, ("adab", "fard", "sunnah")))).alias("category"))
    return revise.no_pool(requested, revise.select_items(pool, 1, seed=7))


@query(f"WITH {_ITEMS}, k AS (SELECT collection, category, len(item) AS chars FROM pool) SELECT x.collection, x.category, y.category AS other, count(*) AS n FROM k x JOIN k y ON y.collection = x.collection AND y.category <> x.category AND y.chars BETWEEN x.chars / 1.6::DOUBLE AND x.chars * 1.6::DOUBLE GROUP BY ALL")
def contrast_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return revise.contrast_pairs(revise.item_pool(_numbered(spark, sf)))


@query(f"WITH {_ITEMS} SELECT category, count(*) AS n, string_agg(DISTINCT collection, ',' ORDER BY collection) AS collections FROM pool GROUP BY 1")
def pool_summary(spark: SparkSession, sf: str) -> DataFrame:
    return revise.pool_summary(revise.item_pool(_numbered(spark, sf))).withColumn("collections", F.array_join("collections", ","))


@query(f"WITH {SQL_CHUNKS} SELECT collection, chunk_id, CAST(row_number() OVER (PARTITION BY collection ORDER BY page_start, part, ordinal) AS INT) AS unit_no, CAST(greatest(2, least(5, len(text_raw) // 750)) AS INT) AS n_cards FROM c WHERE len(text_raw) >= 400")
def plan_deck(spark: SparkSession, sf: str) -> DataFrame:
    return revise.plan_deck(base.chunks(spark, sf))


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.col("text").alias("front"), F.col("text").alias("back"), F.col("conv_id").cast("string").alias("chunk_id"))


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY {base.sql_fold('text')} ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1")
def dedupe_cards(spark: SparkSession, sf: str) -> DataFrame:
    return ground.first_by_front(_cards(spark, sf), "conv_id", "turn").select("conv_id", "turn")


@query(f"""WITH {SQL_CHUNKS}, u AS (SELECT collection, chunk_id FROM c WHERE len(text_raw) >= 400), k AS (SELECT c.collection, c.chunk_id, conv_id, turn, row_number() OVER (PARTITION BY {base.sql_fold('text')} ORDER BY conv_id, turn) AS n FROM conversations JOIN c ON c.doc_id = conv_id),
tp AS (SELECT collection, count(DISTINCT page) AS pages_total FROM (SELECT collection, unnest(generate_series(page_start, page_end)) AS page FROM c) GROUP BY 1),
cp AS (SELECT collection, count(DISTINCT page) AS pages_covered FROM (SELECT collection, unnest(generate_series(page_start, page_end)) AS page FROM c WHERE chunk_id IN (SELECT chunk_id FROM k WHERE n = 1)) GROUP BY 1)
SELECT collection, (SELECT count(*) FROM u WHERE u.collection = tp.collection) AS passages, (SELECT count(*) FROM k WHERE n = 1 AND k.collection = tp.collection) AS cards, (SELECT count(*) FROM k WHERE n > 1 AND k.collection = tp.collection) AS discarded, pages_total, coalesce(pages_covered, 0) AS pages_covered
FROM tp LEFT JOIN cp USING (collection) WHERE collection IN (SELECT collection FROM u)""")
def deck_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.chunks(spark, sf)
    cards = _cards(spark, sf).join(rows.select("chunk_id", "collection"), "chunk_id")
    kept = ground.first_by_front(cards, "conv_id", "turn")
    return revise.deck_report(rows, revise.plan_deck(rows), kept, cards.join(kept, ["conv_id", "turn"], "left_anti"))


_DECK = f"""{SQL_CHUNKS},
u AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY page_start, part, ordinal) AS unit_no, greatest(2, least(5, len(text_raw) // 750)) AS n_cards FROM c WHERE len(text_raw) >= 400),
ln AS (SELECT *, list_filter(string_split(text_raw, chr(10)), lambda x: trim(x) <> '') AS ls FROM u),
cd AS (SELECT collection, section, chunk_id, unit_no, page_start, text_raw AS source_text, unnest(generate_series(0, least(n_cards, len(ls)) - 1)) AS card_no, unnest(ls[1:n_cards]) AS back FROM ln),
fr AS (SELECT *, array_to_string(string_split(back, ' ')[1:4], ' ') AS front, len({_BACK}) AS n_words FROM cd),
ok AS (SELECT *, row_number() OVER (PARTITION BY collection, {base.sql_fold('front')} ORDER BY unit_no, card_no) AS nth FROM fr WHERE n_words > 0)"""


@query(f"WITH {_DECK} SELECT collection, chunk_id, CAST(card_no AS INT) AS card_no, front, page_start AS source_page FROM ok WHERE nth = 1")
def deck_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Grounded cards of all passages, fronts that fold alike once a collection."""
    cards, _, _, _ = revise.build_deck(base.chunks(spark, sf), providers.LineCardWriter())
    return cards.select("collection", "chunk_id", "card_no", "front", "source_page")


@query(f"WITH {_DECK} SELECT collection, 'duplicate_front' AS \"check\", count(*) AS n FROM ok WHERE nth > 1 GROUP BY 1 UNION ALL SELECT collection, 'card_grounding', count(*) FROM fr WHERE n_words = 0 GROUP BY 1")
def deck_failures(spark: SparkSession, sf: str) -> DataFrame:
    _, fails, _, _ = revise.build_deck(base.chunks(spark, sf), providers.LineCardWriter())
    return fails.groupBy("collection", "check").agg(F.count("*").alias("n"))


@query(f"WITH {_DECK}, f AS (SELECT collection, section, count(*) AS n, min((unit_no, card_no)) AS first FROM ok WHERE nth = 1 GROUP BY ALL) SELECT collection, section, n, CAST(row_number() OVER (PARTITION BY collection ORDER BY n DESC, first) AS INT) AS place FROM f")
def deck_sections(spark: SparkSession, sf: str) -> DataFrame:
    return revise.build_deck(base.chunks(spark, sf), providers.LineCardWriter())[3]


@query(f"WITH {SQL_CHUNKS} SELECT conv_id * 1000 + turn AS query_id, coalesce(section, '') AS section FROM conversations LEFT JOIN c ON c.chunk_id = CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'none' END")
def citation_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn cites the chunk of its conversation's number, odd ones a chunk that is none."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).otherwise("none").alias("chunk_id"))
    return ground.citation_sections(turns, base.chunks(spark, sf)).select("query_id", "section")


_PAGE_LIST = "flatten(list_transform(generate_series(1, len(pa)), lambda i: CASE WHEN coalesce(pb[i], '') = '' OR CAST(nullif(pb[i], '') AS INT) < CAST(pa[i] AS INT) OR CAST(nullif(pb[i], '') AS INT) - CAST(pa[i] AS INT) > 20 THEN [CAST(pa[i] AS BIGINT)] ELSE generate_series(CAST(pa[i] AS BIGINT), CAST(pb[i] AS BIGINT)) END))"
_GROUNDED = f"""{SQL_CHUNKS}, {retrieval_queries._BM25},
qt AS (SELECT item_id AS query_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS qt FROM benchmark),
sc2 AS (SELECT query_id, doc_id, rank AS b, CASE WHEN len(qt) > 0 THEN round(len(list_intersect(qt, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}))) / CAST(len(qt) AS DOUBLE), 6) ELSE 0 END AS score FROM bm JOIN qt USING (query_id) JOIN documents USING (doc_id) WHERE rank <= 5),
re2 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b) AS rank FROM sc2),
ga AS (SELECT item_id AS query_id, coalesce(max(score), 0) AS top_score FROM benchmark LEFT JOIN re2 ON query_id = item_id GROUP BY 1),
cx AS (SELECT query_id, rank - 1 AS di, c.* FROM re2 JOIN ga USING (query_id) JOIN c USING (doc_id) WHERE top_score >= 0.5),
li AS (SELECT query_id, di, chunk_id, section, page_start, page_end, unnest(generate_series(0, len(string_split(text_raw, chr(10))) - 1)) AS n, unnest(string_split(text_raw, chr(10))) AS text FROM cx),
sh AS (SELECT li.*, len(list_intersect(qt, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}))) AS shared FROM li JOIN qt USING (query_id)),
be AS (SELECT *, trim(text || ' (Corpus — ' || section || ', ' || CASE WHEN page_start = page_end THEN printf('p%d', page_start) ELSE printf('pp%d-%d', page_start, page_end) END || ')') AS said FROM sh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, di, n) = 1),
pg AS (SELECT query_id, said, regexp_extract_all(said, '(?i){rules.PAGE_MENTION}', 1) AS pa, regexp_extract_all(said, '(?i){rules.PAGE_MENTION}', 2) AS pb FROM be),
cv AS (SELECT query_id, flatten(list(generate_series(page_start, page_end))) AS have FROM cx GROUP BY 1)"""
_GROUNDED_ROWS = f"""SELECT ga.query_id, top_score, top_score < 0.5 OR shared = 0 AS abstained, CASE WHEN top_score < 0.5 THEN 'low-confidence' WHEN shared = 0 THEN 'refusal' END AS abstain_reason,
  CASE WHEN top_score < 0.5 THEN '{answer.LOW_CONFIDENCE}' WHEN shared = 0 THEN '{answer.REFUSAL}' ELSE be.said END AS text, CASE WHEN shared > 0 THEN chunk_id END AS cited, CASE WHEN shared > 0 THEN section END AS section,
  CASE WHEN shared > 0 THEN array_to_string(list_sort(list_filter(list_distinct({_PAGE_LIST}), lambda x: NOT list_contains(have, x))), ',') END AS unverified
FROM ga LEFT JOIN be USING (query_id) LEFT JOIN pg USING (query_id) LEFT JOIN cv USING (query_id)"""
_EVAL = f"""{_GROUNDED}, an AS ({_GROUNDED_ROWS}), {retrieval_queries._ABSTAIN},
ex AS (SELECT item_id AS query_id, min(doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
sa AS (SELECT query_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS said FROM an),
e AS (SELECT query_id, CASE WHEN should_abstain THEN 'Out of scope' WHEN len(qt) % 2 = 0 THEN 'Polarity trap' ELSE 'Straightforward' END AS category, should_abstain, abstained, query_id % 8 AS variant_group,
  CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, said)) / CAST(len(qt) AS DOUBLE) ELSE 0 END AS share,
  CASE WHEN expected IS NOT NULL THEN (query_id, expected) IN (SELECT (query_id, doc_id) FROM re2) END AS recall, coalesce(unverified, '') <> '' AS bad_page, len(an.text) / 100 AS seconds
  FROM an JOIN ab USING (query_id) JOIN qt USING (query_id) JOIN sa USING (query_id) LEFT JOIN ex USING (query_id)),
j AS (SELECT *, CASE WHEN should_abstain THEN CASE WHEN share >= 0.5 THEN 'leaked' ELSE 'declined' END WHEN share >= 0.5 THEN 'agrees' WHEN share >= 0.2 THEN 'incomplete' ELSE 'contradicts' END AS judged FROM e),
v AS (SELECT *, CASE WHEN should_abstain THEN CASE WHEN abstained THEN 'declined' ELSE judged END WHEN abstained THEN 'abstained' ELSE judged END AS verdict FROM j),
r AS (SELECT *, verdict = CASE WHEN should_abstain THEN 'declined' ELSE 'agrees' END AS behaviour_ok FROM v)"""


def _said(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reranked chunks and answers of every question."""
    asked, rows = base.questions(spark, sf), base.chunks(spark, sf)
    best = retrieval_queries._bm25(spark, sf).filter("rank <= 5")
    pairs = best.select("query_id", "chunk_id", F.col("rank").alias("fused_rank")).join(asked, "query_id").join(rows.select("chunk_id", "text_raw"), "chunk_id")
    ranked = kept(retrieve.rerank(providers.CoverageReranker().score(pairs)).select("query_id", "chunk_id", "score", "rank"))
    return ranked, answer.answer(asked, ranked, rows, providers.ExtractiveGenerator(), least=0.5)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every question answered from the corpus and judged; the question is its own reference answer, the first chunk that holds it the expected one, and the length of an answer stands for its time."""
    asked = base.questions(spark, sf)
    found = retrieve.containing(base.chunks(spark, sf), asked).groupBy("query_id").agg(F.min(F.col("chunk_id").cast("long")).cast("string").alias("expected"))
    ranked, said = _said(spark, sf)
    category = F.when(F.col("expected").isNull(), "Out of scope").when(F.size(text.content_terms("question")) % 2 == 0, "Polarity trap").otherwise("Straightforward")
    golden = asked.join(found, "query_id", "left").select(
        "query_id", "question", F.col("question").alias("reference_answer"), category.alias("category"), F.col("expected").isNull().alias("should_abstain"),
        (F.col("query_id") % 8).alias("variant_group"), F.array_compact(F.array("expected")).alias("expected_chunk_ids"),
    )
    return evaluate.judged_answers(golden, said.withColumn("seconds", F.length("text") / 100), ranked, providers.OverlapJudge())


@query(f"""WITH {_EVAL}
SELECT 'behaviour' AS metric, count_if(behaviour_ok) AS passed, count(*) AS total FROM r UNION ALL SELECT 'ruling agreement', count_if(verdict = 'agrees'), count(*) FROM r WHERE NOT should_abstain
UNION ALL SELECT 'abstention (should abstain)', count_if(verdict = 'declined'), count(*) FROM r WHERE should_abstain UNION ALL SELECT 'polarity accuracy', count_if(verdict = 'agrees'), count(*) FROM r WHERE category = 'Polarity trap'
UNION ALL SELECT 'recall@context', count_if(recall), count(*) FROM r WHERE NOT should_abstain UNION ALL SELECT 'citation validity', count_if(NOT bad_page), count(*) FROM r
UNION ALL SELECT 'variant agreement', count_if(n = 1), count(*) FROM (SELECT variant_group, count(DISTINCT verdict) AS n FROM r WHERE variant_group IS NOT NULL GROUP BY 1)""")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(_rows(spark, sf))


@query(f"WITH {_EVAL} SELECT category, count_if(behaviour_ok) AS passed, count(*) AS total FROM r GROUP BY 1")
def eval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.by_category(_rows(spark, sf))


@query(f"WITH {_EVAL} SELECT query_id, verdict FROM r WHERE NOT behaviour_ok OR bad_page")
def eval_failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failures(_rows(spark, sf)).select("query_id", "verdict")


@query(f"WITH {_EVAL} SELECT count_if(abstained) AS n, count(*) AS total, coalesce(string_agg(CASE WHEN abstained THEN CAST(query_id AS VARCHAR) END, ',' ORDER BY CAST(query_id AS VARCHAR)), '') AS ids FROM r WHERE NOT should_abstain")
def false_abstentions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.false_abstentions(_rows(spark, sf))


@query(f"WITH {_EVAL} SELECT round(median(seconds), 6) AS median_seconds, max(seconds) AS max_seconds FROM r")
def eval_latency(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.latency(_rows(spark, sf)).select(F.round("median_seconds", 6).alias("median_seconds"), "max_seconds")


@query(f"WITH {_EVAL} SELECT variant_group, count(DISTINCT verdict) = 1 AS same FROM r WHERE variant_group IS NOT NULL GROUP BY 1")
def variant_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.variant_agreement(_rows(spark, sf))


@query(f"WITH {_EVAL} SELECT query_id FROM r WHERE category = 'Polarity trap' ORDER BY query_id LIMIT 5")
def eval_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The first five questions of a category, named in another case."""
    return evaluate.subset(_rows(spark, sf), "polarity TRAP", 5).select("query_id")


@query(f"WITH {_EVAL} SELECT query_id, seconds, CAST(row_number() OVER (ORDER BY seconds DESC, query_id) AS INT) AS place FROM r QUALIFY place <= 6")
def eval_slowest(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.slowest(_rows(spark, sf)).select("query_id", "seconds", "place")


@query(f"WITH {retrieval_queries._BM25} SELECT item_id % 8 AS variant_group, count(*) AS n, count(DISTINCT coalesce(doc_id, -1)) = 1 AS same_top1 FROM benchmark LEFT JOIN (SELECT query_id, doc_id FROM bm WHERE rank = 1) ON query_id = item_id GROUP BY 1")
def top1_agreement(spark: SparkSession, sf: str) -> DataFrame:
    asked = base.questions(spark, sf).withColumn("variant_group", F.col("query_id") % 8)
    return evaluate.top1_agreement(retrieval_queries._bm25(spark, sf), asked)


@query(f"""WITH {retrieval_queries._BM25}, {retrieval_queries._ABSTAIN}, top AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 5),
s AS (SELECT query_id, doc_id, rank, should_abstain, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt)) / CAST(len(qt) AS DOUBLE) ELSE 0 END, 3) AS cov FROM top JOIN ab USING (query_id) JOIN (SELECT item_id AS query_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS qt FROM benchmark) USING (query_id) JOIN (SELECT doc_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS dt FROM documents) USING (doc_id))
SELECT query_id, CASE WHEN NOT should_abstain THEN CAST(doc_id AS VARCHAR) END AS proposed_chunk_id, cov AS best_coverage, NOT should_abstain AND cov < 0.5 AS weak FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cov DESC, rank) = 1""")
def propose_labels(spark: SparkSession, sf: str) -> DataFrame:
    asked = base.questions(spark, sf).withColumnRenamed("question", "reference_answer").join(retrieval_queries.should_abstain(spark, sf), "query_id")
    return evaluate.propose_labels(retrieval_queries._bm25(spark, sf).filter("rank <= 5"), base.chunks(spark, sf), asked)


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, 'Corpus — ' || section || CASE WHEN doc_id % 2 = 0 THEN ' [fard]' ELSE '' END || ', ' || CASE WHEN page_start = page_end THEN printf('p%d', page_start) ELSE printf('pp%d-%d', page_start, page_end) END AS title FROM c")
def document_titles(spark: SparkSession, sf: str) -> DataFrame:
    category = F.when(F.col("doc_id") % 2 == 0, "fard").otherwise("general")
    return base.chunks(spark, sf).select("chunk_id", text.document_title("Corpus", "section", category, "page_start", "page_end").alias("title"))


@query(f"WITH {_ITEMS} SELECT item_idx, upper(left(o, 1)) || substr(o, 2) AS option FROM (SELECT item_idx, regexp_replace(trim(regexp_replace(trim(item), '^To ', '')), '\\d+$', '') AS o FROM pool)")
def option_texts(spark: SparkSession, sf: str) -> DataFrame:
    return revise.item_pool(_numbered(spark, sf)).select("item_idx", text.option_text("item").alias("option"))


@query(f"WITH {SQL_CHUNKS} SELECT collection, section, min(ordinal) AS ordinal, arg_min(page_start, ordinal) AS page FROM c GROUP BY ALL")
def section_pages(spark: SparkSession, sf: str) -> DataFrame:
    """First page of each section, that of its first chunk."""
    return segment.section_pages(base.chunks(spark, sf))




@query(f"WITH {_GROUNDED} {_GROUNDED_ROWS}")
def grounded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Gate, context, stand-in answer, citations and page check of every question; gated ones reach no generator."""
    _, said = _said(spark, sf)
    first = F.try_element_at("citations", F.lit(1))
    return said.select("query_id", "top_score", "abstained", "abstain_reason", "text", first["chunk_id"].alias("cited"), first["section"].alias("section"), F.array_join(F.col("unverified_pages").cast("array<string>"), ",").alias("unverified"))
