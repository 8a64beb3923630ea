"""Queries of retrieval: term statistics, BM25, dense, fusion, rerank, gate, groups, sections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, vectors
from ..operators import evaluate, lexical, providers, retrieve
from ..scratch import folder, kept
from ..sources import tables
from . import base
from .base import SQL_CHUNKS, sql_fold, sql_words, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOKENS = f"tok AS MATERIALIZED (SELECT doc_id, list_filter(string_split({sql_fold('text')}, ' '), lambda w: w <> '') AS ts FROM documents)"
_WEIGHTS = """
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM tok) GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, (SELECT count(*) AS n FROM documents)),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_TOKENS}, {_WEIGHTS},
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(string_split({sql_fold("text")}, ' '), lambda w: w <> '')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) SEMI JOIN (SELECT term FROM q) USING (term) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(ts)) FROM tok)))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20)"""
_SECOND = f"""
cov AS (SELECT query_id, doc_id, round(len(list_intersect(qt, dt)) / CAST(len(qt) AS DOUBLE), 6) AS score FROM (SELECT item_id AS query_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS qt FROM benchmark), (SELECT doc_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS dt FROM documents) WHERE len(qt) > 0),
sec AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM cov QUALIFY rank <= 20)"""
_FUSED = """
uni AS (SELECT query_id, doc_id, rank AS b, NULL AS d FROM bm UNION ALL SELECT query_id, doc_id, NULL, rank FROM sec),
mer AS (SELECT query_id, doc_id, min(b) AS b, min(d) AS d FROM uni GROUP BY ALL),
fu AS (SELECT query_id, doc_id, b, d, coalesce(1.0::DOUBLE / (60 + b), 0) + coalesce(1.0::DOUBLE / (60 + d), 0) AS score FROM mer),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b ASC NULLS LAST, d ASC NULLS LAST) AS rank FROM fu QUALIFY rank <= 20)"""
_RERANKED = f"""
rr AS (SELECT f.query_id, f.doc_id, f.rank AS fused_rank, CASE WHEN len(qt) > 0 THEN round(len(list_intersect(qt, dt)) / CAST(len(qt) AS DOUBLE), 6) ELSE 0 END AS score FROM fused f
  JOIN (SELECT item_id AS query_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS qt FROM benchmark) USING (query_id) JOIN (SELECT doc_id, list_distinct({sql_words("text", rules.LABEL_STOP_WORDS)}) AS dt FROM documents) USING (doc_id)),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM rr QUALIFY rank <= 5)"""
_ABSTAIN = "ab AS (SELECT item_id AS query_id, NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS should_abstain FROM benchmark b)"


@query(f"WITH {_TOKENS}, {_WEIGHTS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.term_weights(base.folded_chunks(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.bm25(base.folded_chunks(spark, sf), base.questions(spark, sf), aliases=None)


@query(f"WITH {_BM25} SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, rank FROM bm")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, rank FROM bm")
def indexed_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 from a stored index that was built over older texts of every third document and without every fifth, and then updated."""
    rows = kept(base.folded_chunks(spark, sf).select("chunk_id", "ordinal", "text_folded"))
    index = lexical.StoredIndex(spark, f"{folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}", buckets=32)
    older = F.when(F.col("ordinal") % 3 == 0, F.concat("text_folded", F.lit(" older"))).otherwise(F.col("text_folded"))
    index.update(rows.filter("ordinal % 5 <> 0").withColumn("text_folded", older))
    index.update(rows)
    out = kept(retrieve.bm25_indexed(index, base.questions(spark, sf), aliases=None).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank")))
    tables.delete(spark, index.path)
    return out


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: abs(x))), 6) AS l1, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS l2 FROM (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings))")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    rows = table(spark, sf, "embeddings").select("vec_id", unit.alias("u"))
    return rows.select("vec_id", F.round(F.aggregate(F.transform("u", F.abs), F.lit(0.0), lambda a, x: a + x), 6).alias("l1"), F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 6).alias("l2"))


@query("""
WITH u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.u, c.u), 6) AS score FROM u q, u c WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM s QUALIFY rank <= 20
""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors against those whose id is divisible by 20."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vec"))
    batch = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return retrieve.dense(rows, batch).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _second(spark: SparkSession, sf: str) -> DataFrame:
    """Another ranking: term coverage over all documents."""
    return retrieve.coverage_ranks(base.chunks(spark, sf), base.questions(spark, sf), 20)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.rrf(_bm25(spark, sf), _second(spark, sf))


@query(f"WITH {_BM25}, {_SECOND}, {_FUSED} SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, round(score, 9) AS score, rank FROM fused")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _fused(spark, sf).select("query_id", "chunk_id", F.col("rank").alias("fused_rank")).join(base.questions(spark, sf), "query_id").join(base.chunks(spark, sf).select("chunk_id", "text_raw"), "chunk_id")
    return retrieve.rerank(providers.CoverageReranker().score(pairs)).select("query_id", "chunk_id", "score", "rank", "fused_rank")


@query(f"WITH {_BM25}, {_SECOND}, {_FUSED}, {_RERANKED} SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, rank, fused_rank FROM re")
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.col("fused_rank").cast("long").alias("fused_rank"))


@query(f"WITH {_BM25}, {_SECOND}, {_FUSED}, {_RERANKED} SELECT item_id AS query_id, coalesce(max(score), 0) AS top_score, coalesce(max(score), 0) >= 0.74 AS is_confident, CASE WHEN coalesce(max(score), 0) < 0.74 THEN 'low-confidence' END AS abstain_reason FROM benchmark LEFT JOIN re ON query_id = item_id GROUP BY 1")
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.gate(base.questions(spark, sf), _reranked(spark, sf))


def should_abstain(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, should_abstain: no document holds the question word for word."""
    asked = base.questions(spark, sf)
    found = retrieve.containing(base.chunks(spark, sf), asked).select("query_id").distinct().withColumn("there", F.lit(True))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.col("there").isNull().alias("should_abstain"))


@query(f"WITH {_BM25}, {_SECOND}, {_FUSED}, {_RERANKED}, {_ABSTAIN}, s AS (SELECT ab.query_id, should_abstain, coalesce(max(score), 0) AS t FROM ab LEFT JOIN re USING (query_id) GROUP BY ALL), h AS (SELECT x / 100 AS threshold FROM (SELECT unnest(generate_series(50, 95, 5)) AS x)) SELECT threshold, count_if(NOT should_abstain AND t < threshold) AS false_abstain, count_if(should_abstain AND t >= threshold) AS missed_abstain, count_if(should_abstain = (t < threshold)) AS correct FROM s, h GROUP BY 1")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scores = retrieve.gate(base.questions(spark, sf), _reranked(spark, sf)).join(should_abstain(spark, sf), "query_id")
    return evaluate.threshold_sweep(scores)


@query(f"WITH {_BM25}, {_SECOND}, {_FUSED}, {_RERANKED}, {_ABSTAIN}, s AS (SELECT ab.query_id, should_abstain, coalesce(max(score), 0) AS t FROM ab LEFT JOIN re USING (query_id) GROUP BY ALL) SELECT should_abstain, count(*) AS n, min(t) AS low, list_sort(list(t))[count(*) // 2 + 1] AS upper_median, max(t) AS high FROM s GROUP BY 1")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calibration(retrieve.gate(base.questions(spark, sf), _reranked(spark, sf)).join(should_abstain(spark, sf), "query_id"))


@query(f"WITH {_BM25}, {_SECOND}, {_FUSED}, {_RERANKED}, {_ABSTAIN}, s AS (SELECT ab.query_id, should_abstain, coalesce(max(score), 0) AS t FROM ab LEFT JOIN re USING (query_id) GROUP BY ALL), m AS (SELECT min(t) FILTER (NOT should_abstain) AS low, max(t) FILTER (should_abstain) AS high FROM s) SELECT low > high AS separable, CASE WHEN low IS NULL OR high IS NULL THEN 0.0 ELSE greatest(CAST(high - low AS DOUBLE), 0.0) END AS overlap FROM m")
def separable(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.separable(retrieve.gate(base.questions(spark, sf), _reranked(spark, sf)).join(should_abstain(spark, sf), "query_id"))


@query(f"WITH {_BM25}, {_ABSTAIN}, e AS (SELECT item_id AS query_id, min(doc_id) AS want FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1) SELECT ab.query_id, CASE WHEN want IS NOT NULL THEN coalesce(bool_or(doc_id = want AND rank <= 5), false) END AS recall FROM ab LEFT JOIN e USING (query_id) LEFT JOIN bm USING (query_id) GROUP BY ab.query_id, want")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    asked = base.questions(spark, sf)
    expected = retrieve.containing(base.chunks(spark, sf), asked).groupBy("query_id").agg(F.array(F.min("ordinal").cast("string")).alias("expected_chunk_ids"))
    return evaluate.recall_at(_bm25(spark, sf), asked.select("query_id").join(expected, "query_id", "left"), 5)


_EXPANDED = """
g AS (SELECT doc_id, doc_id AS ordinal, CASE WHEN doc_id % 3 = 0 THEN doc_id // 30 END AS group_id FROM documents),
o AS (SELECT re.query_id, re.doc_id, re.score, re.rank, g.group_id FROM re JOIN g USING (doc_id)),
t AS (SELECT query_id, group_id, min(rank) AS r, arg_min(score, rank) AS lent FROM o WHERE group_id IS NOT NULL GROUP BY ALL),
k AS (SELECT query_id, doc_id, rank AS a, 0 AS b, 0 AS c, score AS own, NULL AS lent FROM o UNION ALL SELECT t.query_id, g.doc_id, t.r, 1, g.ordinal, NULL, t.lent FROM t JOIN g USING (group_id)),
m AS (SELECT query_id, doc_id, min((a, b, c)) AS place, coalesce(max(own), max(lent)) AS score, CASE WHEN max(own) IS NULL THEN 'group-expansion' ELSE 'rerank' END AS source FROM k GROUP BY ALL),
fin AS (SELECT query_id, doc_id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM m)"""


@query(f"WITH {_BM25}, {_SECOND}, {_FUSED}, {_RERANKED}, {_EXPANDED} SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, source, rank FROM fin")
def expand_groups(spark: SparkSession, sf: str) -> DataFrame:
    grouped = base.chunks(spark, sf).withColumn("group_id", F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("doc_id") / 30)))
    results = _reranked(spark, sf).withColumn("source", F.lit("rerank"))
    return retrieve.expand_groups(results, grouped).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {SQL_CHUNKS}, w AS (SELECT doc_id AS query_id, chunk_id FROM c WHERE doc_id % 20 = 0) SELECT query_id, s.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s.part, s.ordinal) AS pos FROM w JOIN c USING (chunk_id) JOIN c s ON s.section = c.section AND s.collection = c.collection")
def get_section(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of the chunks whose id is divisible by 20, over all chunks."""
    rows = base.chunks(spark, sf)
    wanted = rows.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "chunk_id")
    return retrieve.get_section(rows, wanted).withColumn("pos", F.col("pos").cast("long"))


_LISTS = "q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'List the conditions: ' || text ELSE text END AS question FROM benchmark)"


@query(f"WITH {_LISTS} SELECT query_id, regexp_matches(question, '(?i){rules.LIST_CUES}') AND regexp_matches(question, '(?i){rules.CATEGORY_CUES}') AS is_list FROM q")
def enumeration_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("query_id", text.is_enumeration_question("question").alias("is_list"))


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return base.questions(spark, sf).select("query_id", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("List the conditions: "), "question")).otherwise(F.col("question")).alias("question"))


@query(f"""WITH {SQL_CHUNKS}, {_BM25}, top AS (SELECT * FROM bm WHERE rank <= 5),
sect AS (SELECT t.query_id, s.chunk_id, row_number() OVER (PARTITION BY t.query_id ORDER BY s.part, s.ordinal) AS pos FROM top t JOIN c ON c.doc_id = t.doc_id JOIN c s ON s.section = c.section AND s.collection = c.collection WHERE t.rank = 1 AND t.query_id % 2 = 0),
both_ AS (SELECT query_id, chunk_id, 0 AS lead, pos FROM sect UNION ALL SELECT query_id, CAST(doc_id AS VARCHAR), 1, rank FROM top WHERE (query_id, CAST(doc_id AS VARCHAR)) NOT IN (SELECT (query_id, chunk_id) FROM sect))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY lead, pos) AS pos FROM both_""")
def enumeration_context(spark: SparkSession, sf: str) -> DataFrame:
    best = _bm25(spark, sf).filter("rank <= 5")
    return retrieve.answer_context(_lists(spark, sf), best, best, base.chunks(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


def _sql_vector(ts: str) -> str:
    """SQL of providers.hashed_terms with 32 slots."""
    slots = f"list_transform({ts}, lambda w: CAST('0x' || left(md5(w), 4) AS INT) % 32)"
    return f"list_transform(generate_series(0, 31), lambda i: CAST(len(list_filter({slots}, lambda s: s = i)) AS DOUBLE))"


_UNIT = "list_transform({0}, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform({0}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12))"
_DENSE = f"""
qt_ AS MATERIALIZED (SELECT item_id AS query_id, list_filter(string_split({sql_fold('text')}, ' '), lambda w: w <> '') AS ts FROM benchmark),
dv AS MATERIALIZED (SELECT doc_id, {_sql_vector('ts')} AS v FROM tok), qv AS MATERIALIZED (SELECT query_id, {_sql_vector('ts')} AS v FROM qt_),
df_ AS MATERIALIZED (SELECT doc_id, list_transform({_UNIT.format('v')}, lambda x: CAST(x AS FLOAT)) AS v FROM dv), qf AS MATERIALIZED (SELECT query_id, list_transform({_UNIT.format('v')}, lambda x: CAST(x AS FLOAT)) AS v FROM qv),
du AS MATERIALIZED (SELECT doc_id, {_UNIT.format('v')} AS u FROM df_), qu AS MATERIALIZED (SELECT query_id, {_UNIT.format('v')} AS u FROM qf),
sec AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM (SELECT query_id, doc_id, round(list_dot_product(qu.u, du.u), 6) AS score FROM qu, du) QUALIFY rank <= 20)"""
_STAGE = "SELECT query_id, '{0}' AS stage, rank, CAST(doc_id AS VARCHAR) AS chunk_id, round(score, 9) AS score, {1} AS source FROM {2}"


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED}, {_RERANKED}, {_EXPANDED} " + " UNION ALL ".join(_STAGE.format(name, "source" if name == "final" else f"'{name}'", of) for name, of in (("bm25", "bm"), ("dense", "sec"), ("rrf", "fused"), ("rerank", "re"), ("final", "fin"))))
def search_stages(spark: SparkSession, sf: str) -> DataFrame:
    """All stages over all documents with the offline stand-ins."""
    rows = base.chunks(spark, sf).withColumn("group_id", F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("doc_id") / 30).cast("string"))).withColumn("text_folded", text.fold("text_raw"))
    embedder = providers.HashedEmbedder(dim=32)
    vecs = embedder.embed(rows.select("chunk_id", "ordinal", F.col("text_raw").alias("text"))).select("chunk_id", "ordinal", "vec")
    asked = base.questions(spark, sf)
    found = retrieve.search(rows, vecs, asked, embedder.embed(asked.select("query_id", F.col("question").alias("text")), "query").select("query_id", "vec"), providers.CoverageReranker().score, aliases=None)
    return found.select("query_id", "stage", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 9).alias("score"), "source")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256(concat_ws(chr(31), 'stand-in:64', CAST(doc_id AS VARCHAR), text)) AS fingerprint FROM documents")
def embed_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return base.chunks(spark, sf).select("chunk_id", vectors.fingerprint("stand-in", 64, F.col("chunk_id"), F.col("text_raw")).alias("fingerprint"))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id % 4 = 1 OR doc_id % 6 = 0")
def incremental_embed_todo(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth chunk was never stored and every sixth had another text."""
    rows = base.chunks(spark, sf)
    old = F.when(F.col("doc_id") % 6 == 0, F.concat("text_raw", F.lit("!"))).otherwise(F.col("text_raw"))
    stored = rows.filter("doc_id % 4 <> 1").select("chunk_id", vectors.fingerprint("stand-in", 64, F.col("chunk_id"), old).alias("fingerprint"))
    return tables.to_embed(rows, stored, vectors.fingerprint("stand-in", 64, F.col("chunk_id"), F.col("text_raw"))).select("chunk_id")
