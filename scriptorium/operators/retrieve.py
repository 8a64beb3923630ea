"""Hybrid retrieval for batches of queries: BM25, dense, fusion, rerank, gate, groups."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, text, vectors
from ..scratch import kept
from . import lexical
from .best import CELLS, Best
from .lexical import top

BROADCAST_ROWS = 1_000_000
#: Query vectors that a scan holds at once, in doubles; a larger batch takes several scans.
DENSE_BYTES = 32_000_000
#: Questions that a scan for their wording holds at once.
CONTAINED = 200_000


def tokens(folded: Column | str) -> Column:
    """White-space tokens of folded text."""
    return F.filter(F.split(F.col(folded) if isinstance(folded, str) else folded, " "), lambda w: w != "")


def term_statistics(chunks: DataFrame) -> DataFrame:
    """term, df over (chunk_id, text_folded); terms are distinct in a chunk before the shuffle."""
    return chunks.select(F.explode(F.array_distinct(tokens("text_folded"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_weights(chunks: DataFrame, epsilon: float = rules.EPSILON) -> DataFrame:
    """term, df, idf: ln(N - df + 0.5) - ln(df + 0.5); where that is negative, epsilon times its mean over all terms."""
    n = chunks.agg(F.count("*").alias("n"))
    raw = term_statistics(chunks).crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, aliases: Mapping[str, str] | None = rules.ALIASES) -> DataFrame:
    """query_id, term, qtf of expanded folded queries; a repeated token counts each time."""
    form = text.expand_aliases("question", aliases) if aliases else text.fold("question")
    return queries.select("query_id", F.explode(tokens(form)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int = rules.CANDIDATES, aliases: Mapping[str, str] | None = rules.ALIASES) -> DataFrame:
    """query_id, chunk_id, ordinal, score, rank: BM25 over (chunk_id, ordinal, text_folded), positive scores only.

    The chunks are split and counted once, for this batch alone; `bm25_indexed` asks an
    index that is there already.
    """
    return lexical.bm25_of(lexical.ForwardIndex.of(chunks), query_terms(queries, aliases), k)


def bm25_indexed(index: lexical.StoredIndex, queries: DataFrame, k: int = rules.CANDIDATES, aliases: Mapping[str, str] | None = rules.ALIASES) -> DataFrame:
    """`bm25` over the chunks of a stored index."""
    return lexical.bm25_of(index, query_terms(queries, aliases), k)


def coverage_ranks(chunks: DataFrame, queries: DataFrame, k: int = rules.CANDIDATES) -> DataFrame:
    """query_id, chunk_id, ordinal, score, rank: the share of the query's content terms that a chunk (chunk_id, ordinal, text_raw) has.

    One scan of the chunks, from which k rows a query and task come; a query whose k-th
    best would share no term is filled up with the last chunks at score 0.
    """
    asked = kept(queries.select("query_id", F.explode(text.content_terms("question")).alias("term")))
    size = asked.groupBy("query_id").agg(F.count("*").cast("double").alias("by"))
    have = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "ordinal", text.content_terms("text_raw").alias("terms"))
    best = lexical.scan(have, asked.withColumn("weight", F.lit(1.0)), k, size).drop("rank")
    last = chunks.select("chunk_id", "ordinal").orderBy(F.desc("ordinal")).limit(2 * k)
    rest = size.select("query_id").crossJoin(F.broadcast(last)).withColumn("score", F.lit(0.0))
    return top(best.unionByName(rest).groupBy("query_id", "chunk_id", "ordinal").agg(F.max("score").alias("score")), k, F.desc("score"), F.desc("ordinal"))


def containing(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, ordinal of chunks (chunk_id, ordinal, text_raw) that hold a question word for word.

    A chunk with the question has all of its words but the first and the last as whole
    words between spaces, a word that ends with the first and one that begins with the
    last. The rarest inner word in the corpus, or where there is none the longer end,
    tells a task which chunks to look at; texts stay where they are read. Blank questions
    are compared with every chunk, null questions and texts with none.
    """
    pieces = F.split("question", " ")
    inner = F.array_distinct(F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != ""))
    asked = kept(queries.filter("question IS NOT NULL").select("query_id", "question", inner.alias("inner")))
    words = asked.select(F.explode("inner").alias("word")).distinct()
    sized = F.broadcast if words.count() <= BROADCAST_ROWS else (lambda df: df)
    counts = chunks.select(F.explode(F.array_distinct(F.split("text_raw", " "))).alias("word")).join(sized(words), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    each = asked.select("query_id", "question", F.size("inner").alias("n"), F.explode_outer("inner").alias("word"))
    rare = each.join(counts, "word", "left").groupBy("query_id", "question", "n").agg(F.min_by("word", F.struct("df", "word")).alias("word"), F.count("df").alias("found"))
    # A question with an inner word that no chunk has is in none.
    open_ = kept(rare.filter("found = n").select("query_id", "question", F.when(F.col("n") > 0, F.col("word")).alias("word")))
    kind = queries.schema["query_id"].dataType.simpleString()
    name = chunks.schema["chunk_id"].dataType.simpleString()
    groups = max(1, -(-open_.count() // CONTAINED))
    out = None
    for i in range(groups):
        # Bounded by the number of groups.
        some = open_.filter(F.pmod(F.xxhash64("query_id", "question"), F.lit(groups)) == i).toArrow()
        found = chunks.filter("text_raw IS NOT NULL").select("chunk_id", "ordinal", "text_raw").mapInArrow(_containing_task(some), f"query_id {kind}, chunk_id {name}, ordinal {chunks.schema['ordinal'].dataType.simpleString()}")
        out = found if out is None else out.unionByName(found)
    return out


def _containing_task(questions: pa.Table):
    said, keys = questions.column("question").to_pylist(), questions.column("word").to_pylist()
    ids = questions.column("query_id").combine_chunks()
    by_word: dict[str, list[int]] = {}
    ends: dict[tuple[str, str], list[int]] = {}
    every: list[int] = []
    for i, (text_, word) in enumerate(zip(said, keys, strict=True)):
        first, *_, last = text_.split(" ") if " " in text_ else (text_, "", "")
        if word is not None:
            by_word.setdefault(word, []).append(i)
        elif not text_.strip(" "):
            every.append(i)
        elif " " not in text_:
            ends.setdefault(("in", text_), []).append(i)
        elif len(first) >= len(last):
            ends.setdefault(("end", first), []).append(i)
        else:
            ends.setdefault(("begin", last), []).append(i)
    sizes = {way: sorted({len(w) for k, w in ends if k == way}) for way in ("in", "end", "begin")}

    def of_word(word: str) -> list[int]:
        """The questions that a chunk with this word may hold."""
        parts = {("end", word[len(word) - n :]) for n in sizes["end"] if n <= len(word)} | {("begin", word[:n]) for n in sizes["begin"] if n <= len(word)}
        parts |= {("in", word[at : at + n]) for n in sizes["in"] for at in range(len(word) - n + 1)}
        return by_word.get(word, []) + [q for part in parts for q in ends.get(part, [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        none: list[int] = []
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows, found = [], []
                for row, text_ in enumerate(batch.column("text_raw").to_pylist()):
                    maybe = set(every)
                    for word in set(text_.split(" ")):
                        if (hit := seen.get(word)) is None:
                            if len(seen) > 100_000:
                                seen.clear()
                            hit = seen[word] = of_word(word) or none
                        if hit:
                            maybe.update(hit)
                    held = [q for q in maybe if said[q] in text_]
                    rows += [row] * len(held)
                    found += held
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found, pa.int64())), batch.column("chunk_id").take(at), batch.column("ordinal").take(at)], ["query_id", "chunk_id", "ordinal"])

    return run


def dense(embeddings: DataFrame, queries: DataFrame, k: int = rules.CANDIDATES) -> DataFrame:
    """query_id, chunk_id, ordinal, score, rank: every vector (chunk_id, ordinal, vec) against a batch (query_id, vec), by cosine.

    One pass over the vectors for all queries whose vectors fill `DENSE_BYTES`: slices of
    vectors are multiplied with blocks of queries, and at most k rows a query leave a
    task. Null vectors are no candidates, null query vectors find nothing; a vector of
    another length than the queries' is an error.
    """
    unit = kept(queries.filter("vec IS NOT NULL").select("query_id", vectors.l2_normalize(F.col("vec")).alias("q")))
    n, dim = unit.agg(F.count("*"), F.max(F.size("q"))).first()
    groups = max(1, -(-n * (dim or 1) * 8 // DENSE_BYTES))
    kind = queries.schema["query_id"].dataType.simpleString()
    given = embeddings.filter("vec IS NOT NULL").select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("vec").cast("array<double>").alias("vec"))
    out = None
    for i in range(groups):
        # Bounded by the number of groups.
        some = unit.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == i).toArrow()
        found = given.mapInArrow(_dense_task(some, dim or 0, k), f"query_id {kind}, chunk_id string, ordinal long, score double")
        out = found if out is None else out.unionByName(found)
    best = top(out, k, F.desc("score"), F.desc("ordinal"))
    return best.withColumn("chunk_id", F.col("chunk_id").cast(embeddings.schema["chunk_id"].dataType))


def _dense_task(queries: pa.Table, dim: int, k: int):
    """Scores of vector batches against all `queries` (query_id, q)."""
    ids = queries.column("query_id").combine_chunks()
    many = len(ids)
    matrix = queries.column("q").combine_chunks().flatten().to_numpy().reshape(many, dim) if many else np.zeros((0, dim))
    block = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(min(block, many - at), k) for at in range(0, many, block)]
        step = max(1, CELLS // max(1, min(block, many)))
        for whole in batches:
            for at in range(0, whole.num_rows if many else 0, step):
                batch = whole.slice(at, step)
                rows = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, dim)
                rows = rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)
                names, ordinals = np.array(batch.column("chunk_id").to_pylist(), object), batch.column("ordinal").to_numpy()
                for i, held in enumerate(best):
                    held.offer(rows @ matrix[i * block : (i + 1) * block].T, ordinals, names)
        for i, held in enumerate(best):
            yield from held.rows(ids.slice(i * block, block))

    return run


def rrf(lexical: DataFrame, vector: DataFrame, k: int = rules.CANDIDATES, constant: int = rules.RRF_K) -> DataFrame:
    """query_id, chunk_id, ordinal, score, rank, bm25_rank, dense_rank: sum of 1 / (constant + rank) over both lists."""
    named = lexical.select("query_id", "chunk_id", "ordinal", F.col("rank").alias("b"), F.lit(None).cast("int").alias("d"))
    both = named.unionByName(vector.select("query_id", "chunk_id", "ordinal", F.lit(None).cast("int").alias("b"), F.col("rank").alias("d")))
    merged = both.groupBy("query_id", "chunk_id", "ordinal").agg(F.min("b").alias("bm25_rank"), F.min("d").alias("dense_rank"))
    one = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    scored = merged.withColumn("score", one("bm25_rank") + one("dense_rank"))
    return top(scored, k, F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"))


def rerank(scored: DataFrame, k: int = rules.TOP_K) -> DataFrame:
    """The k best candidates by a scorer's `score`, ties by `fused_rank`, with `rank`."""
    return top(scored, k, F.desc("score"), F.asc("fused_rank"))


def gate(queries: DataFrame, reranked: DataFrame, least: float = rules.MIN_CONFIDENCE) -> DataFrame:
    """query_id, top_score, is_confident, abstain_reason; a query without results scores 0."""
    best = reranked.groupBy("query_id").agg(F.max("score").alias("m"))
    score = F.coalesce("m", F.lit(0.0))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", score.alias("top_score"), (score >= least).alias("is_confident"), F.when(score < least, F.lit("low-confidence")).alias("abstain_reason"))


def expand_groups(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, source, rank: results, each followed by the siblings of its group in corpus order.

    A chunk's place is the least of its own (rank, 0, 0) and (least rank of a result of
    its group, 1, ordinal). Siblings that are no results take the score of the result
    that brought them in and the source "group-expansion".
    """
    grouped = chunks.select("chunk_id", "ordinal", "group_id")
    results = kept(results)
    own = results.join(grouped.select("chunk_id", "group_id", F.col("ordinal").alias("o")), "chunk_id").select("query_id", "chunk_id", "score", "source", "group_id", "rank")
    triggers = own.filter("group_id IS NOT NULL").groupBy("query_id", "group_id").agg(F.min(F.struct("rank", "score")).alias("t"))
    place = lambda *c: F.struct(*(x.cast("long").alias(n) for x, n in zip(c, ("a", "b", "c"), strict=True)))
    selves = own.select("query_id", "chunk_id", place(F.col("rank"), F.lit(0), F.lit(0)).alias("place"), F.col("score").alias("own"), "source", F.lit(None).cast("double").alias("lent"))
    siblings = triggers.join(grouped, "group_id").select("query_id", "chunk_id", place(F.col("t.rank"), F.lit(1), F.col("ordinal")).alias("place"), F.lit(None).cast("double").alias("own"), F.lit(None).cast("string").alias("source"), F.col("t.score").cast("double").alias("lent"))
    merged = selves.unionByName(siblings).groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"), F.coalesce(F.max("own"), F.max("lent")).alias("score"), F.coalesce(F.max("source"), F.lit("group-expansion")).alias("source"))
    order = Window.partitionBy("query_id").orderBy("place")
    return merged.select("query_id", "chunk_id", "score", "source", F.row_number().over(order).alias("rank"))


def get_section(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (query_id, chunk_id) -> query_id, chunk_id, pos: all parts of that chunk's section, by part, then corpus order."""
    keyed = wanted.join(chunks.select("chunk_id", "section", "collection"), "chunk_id").select("query_id", "section", "collection")
    order = Window.partitionBy("query_id").orderBy("part", "ordinal")
    return keyed.join(chunks.select("chunk_id", "section", "collection", "part", "ordinal"), ["section", "collection"]).select("query_id", "chunk_id", F.row_number().over(order).alias("pos"))


def answer_context(questions: DataFrame, reranked: DataFrame, expanded: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, pos: expanded results; for a question that asks for a list, the best chunk's whole section first."""
    lists = questions.filter(text.is_enumeration_question("question")).select("query_id")
    best = reranked.filter("rank = 1").join(lists, "query_id", "left_semi").select("query_id", "chunk_id")
    section = get_section(chunks, best).withColumn("lead", F.lit(0))
    rest = expanded.select("query_id", "chunk_id", F.col("rank").alias("pos")).join(section.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("lead", F.lit(1))
    order = Window.partitionBy("query_id").orderBy("lead", "pos")
    return section.unionByName(rest).select("query_id", "chunk_id", F.row_number().over(order).alias("pos"))


def search(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, query_vectors: DataFrame, score, k: int = rules.TOP_K, candidates: int = rules.CANDIDATES, expand: bool = True, aliases: Mapping[str, str] | None = rules.ALIASES) -> DataFrame:
    """All stages in long form: query_id, stage, rank, chunk_id, score, source.

    `score(pairs)` is the reranker: it adds `score` to (query_id, question, chunk_id, text_raw, fused_rank).
    The lists of each stage are small and written once, so no stage is planned twice.
    """
    lexical = kept(bm25(chunks, queries, candidates, aliases))
    vector = kept(dense(embeddings, query_vectors, candidates))
    fused = kept(rrf(lexical, vector, candidates))
    pairs = fused.select("query_id", "chunk_id", F.col("rank").alias("fused_rank")).join(queries.select("query_id", "question"), "query_id").join(chunks.select("chunk_id", "text_raw"), "chunk_id")
    best = kept(rerank(score(pairs), k).select("query_id", "chunk_id", "score", "rank", F.lit("rerank").alias("source")))
    staged = [("bm25", lexical), ("dense", vector), ("rrf", fused), ("rerank", best)]
    if expand:
        staged.append(("final", expand_groups(best, chunks)))
    out = None
    for name, df in staged:
        source = F.col("source") if "source" in df.columns else F.lit(name)
        rows = df.select("query_id", F.lit(name).alias("stage"), "rank", "chunk_id", F.col("score").cast("double").alias("score"), source.alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out
