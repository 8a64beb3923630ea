"""Model providers and their deterministic offline stand-ins.

Embedders, rerankers, generators and judges are objects whose methods take and return
DataFrames, so a hosted model is a `mapInPandas` over batches in the same place. The
stand-ins reproduce no hosted model's scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..sources import tables
from ..sources.answered import AnsweredRequests
from .connect import Limits, ask_in_requests


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: DataFrame, kind: str) -> DataFrame:
        """texts with `vec` from `text`; kind is "document" or "query"."""


class Reranker(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame:
        """(question, text_raw, ...) with `score`."""


class Generator(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame:
        """(query_id, question, context: array of (title, text)) with `text`, `stop_reason` ("refusal" if the model declines) and `cited` (array of document_index, cited_text)."""


def hashed_terms(folded: Column, dim: int) -> Column:
    """Unit vectors of hashed term counts: a term's slot is the number of the first four digits of its MD5, modulo `dim`."""

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}  # of the words of one batch
        out = []
        for said in texts:
            words = [w for w in (said or "").split(" ") if w]
            for w in words:
                if w not in slots:
                    slots[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim
            counts = np.bincount([slots[w] for w in words], minlength=dim).astype(np.float64)
            out.append((counts / max(float(np.sqrt((counts * counts).sum())), 1e-12)).astype(np.float32))
        return pd.Series(out)

    return vector(folded)


@dataclass(frozen=True)
class HashedEmbedder:
    """Unit vectors of hashed term counts, one pass over a batch of texts."""

    model: str = "hashed-terms"
    dim: int = 64

    def embed(self, texts: DataFrame, kind: str = "document") -> DataFrame:
        return texts.withColumn("vec", hashed_terms(text.fold("text"), self.dim))


@dataclass(frozen=True)
class CoverageReranker:
    """Score: the share of the question's content terms that the text has."""

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", F.round(text.coverage(text.content_terms("question"), text.content_terms("text_raw")), 6))


@dataclass(frozen=True)
class ExtractiveGenerator:
    """Quotes the line of the context that shares most terms with the question; declines if none shares any."""

    def answer(self, prompts: DataFrame) -> DataFrame:
        asked = text.content_terms("question")
        lines = prompts.select("query_id", asked.alias("asked"), F.posexplode("context").alias("document_index", "doc")).select("query_id", "asked", "document_index", "doc.title", F.posexplode(F.split("doc.text", "\n")).alias("n", "line"))
        shared = F.size(F.array_intersect("asked", text.content_terms("line")))
        best = lines.groupBy("query_id").agg(F.max_by(F.struct("document_index", "title", "line"), F.struct(shared, -F.col("document_index"), -F.col("n"))).alias("best"), F.max(shared).alias("shared"))
        cited = F.array(F.struct(F.col("best.document_index").alias("document_index"), F.col("best.line").alias("cited_text")))
        stop = F.when(F.col("shared") > 0, F.lit("end_turn")).otherwise(F.lit("refusal"))
        return prompts.join(best.select("query_id", F.concat("best.line", F.lit(" ("), "best.title", F.lit(")")).alias("text"), stop.alias("stop_reason"), cited.alias("cited")), "query_id", "left")


@dataclass(frozen=True)
class LineCardWriter:
    """Cards of the first lines of a passage: the first four words ask for the whole line."""

    def write(self, passages: DataFrame) -> DataFrame:
        lines = F.filter(F.split("text_raw", "\n"), lambda x: F.trim(x) != "")
        cards = passages.select("chunk_id", F.posexplode(F.slice(lines, F.lit(1), F.col("n_cards"))).alias("card_no", "back"))
        return cards.select("chunk_id", "card_no", F.array_join(F.slice(F.split("back", " "), 1, 4), " ").alias("front"), "back")


@dataclass(frozen=True)
class OverlapJudge:
    """Verdicts of two kinds by shares of terms: a ruling against its reference answer, and whether an answer where none should be leaks what was asked."""

    agrees: float = 0.5
    incomplete: float = 0.2

    def judge(self, answers: DataFrame) -> DataFrame:
        share = text.coverage(text.content_terms("reference_answer"), text.content_terms("answer"))
        return answers.withColumn("judged", F.when(share >= self.agrees, "agrees").when(share >= self.incomplete, "incomplete").otherwise("contradicts"))

    def judge_abstention(self, answers: DataFrame) -> DataFrame:
        share = text.coverage(text.content_terms("question"), text.content_terms("answer"))
        return answers.withColumn("judged", F.when(share >= self.agrees, "leaked").otherwise("declined"))


@dataclass(frozen=True)
class RemoteEmbedder:
    """A hosted embedder. `client()` gives, in a task, an object whose `embed(texts, kind)` returns a vector a text or raises `Retryable`."""

    client: Callable[[], Any]
    model: str
    dim: int
    count: Callable[[str], int]
    limits: Limits = Limits()

    def embed(self, texts: DataFrame, kind: str = "document", store: AnsweredRequests | None = None) -> DataFrame:
        ask = lambda session, batch: {"vec": session.embed(batch["text"].tolist(), kind)}
        return ask_in_requests(texts, self.client, ask, "vec array<float>", self.limits, self.count, store=store)


@dataclass(frozen=True)
class RemoteReranker:
    """A hosted reranker: a request holds the texts of one question. `client().rerank(question, texts)` returns a score a text."""

    client: Callable[[], Any]
    count: Callable[[str], int]
    limits: Limits = Limits()

    def score(self, pairs: DataFrame) -> DataFrame:
        ask = lambda session, batch: {"score": session.rerank(batch["question"].iloc[0], batch["text_raw"].tolist())}
        # Pairs of a question share a slot.
        slot = F.pmod(F.xxhash64("query_id"), F.lit(self.limits.slots))
        keyed = pairs.withColumn("slot_of_question", slot)
        return ask_in_requests(keyed, self.client, ask, "score double", self.limits, self.count, "text_raw", ["query_id", "fused_rank"], "slot_of_question", "query_id").drop("slot_of_question")


@dataclass(frozen=True)
class RemoteGenerator:
    """A hosted language model: one request a prompt. `client().generate(prompt)` returns the model's text."""

    client: Callable[[], Any]
    limits: Limits = Limits(texts=1)

    def generate(self, prompts: DataFrame) -> DataFrame:
        """prompts (prompt, ...) with `raw`, the model's text."""
        ask = lambda session, batch: {"raw": [session.generate(p) for p in batch["prompt"]]}
        return ask_in_requests(prompts, self.client, ask, "raw string", self.limits, len, "prompt")


def stored_embeddings(chunks: DataFrame, stored: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, fingerprint, model, dim, vec) of chunks that `stored` lacks or has for another text."""
    todo = tables.to_embed(chunks, stored, vectors.fingerprint(embedder.model, embedder.dim, F.col("chunk_id"), F.col("text")))
    return _as_rows(embedder.embed(todo.select("chunk_id", "fingerprint", "text"), "document"), embedder)


def _as_rows(embedded: DataFrame, embedder: Embedder) -> DataFrame:
    return embedded.select("chunk_id", "fingerprint", F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), "vec")


def build_embeddings(chunks: DataFrame, path: str, embedder: RemoteEmbedder, force: bool = False) -> DataFrame:
    """The table of unit vectors under `path`, after all chunks (chunk_id, text) that it lacks have been embedded.

    Answered requests wait in `path`/requests until the build ends and are then appended to
    `path`/rows in files of Spark's size. A build that was killed anywhere leaves them
    there: the next one takes them in first and asks only for the rest. A row is taken in
    once, whatever was killed when. `force` asks for every chunk again.
    """
    spark = chunks.sparkSession
    store, rows = AnsweredRequests(f"{path.rstrip('/')}/requests"), f"{path.rstrip('/')}/rows"

    def known() -> DataFrame:
        return tables.read_or_empty(spark, rows, tables.EMBEDDING_SCHEMA)

    def take_in() -> None:
        if not store.is_empty():
            answered = spark.read.parquet(store.path).select("chunk_id", "fingerprint", "vec").dropDuplicates(["chunk_id", "fingerprint"])
            unit = answered.withColumn("vec", vectors.l2_normalize(F.col("vec")).cast("array<float>"))
            new = unit.join(known().select("chunk_id", "fingerprint"), ["chunk_id", "fingerprint"], "left_anti")
            tables.append_embeddings(_as_rows(new, embedder), rows)
            store.clear()

    if force:
        store.clear()
        tables.delete(spark, rows)
    take_in()
    todo = tables.to_embed(chunks, known(), vectors.fingerprint(embedder.model, embedder.dim, F.col("chunk_id"), F.col("text")))
    embedder.embed(todo.select("chunk_id", "fingerprint", "text"), "document", store).select("chunk_id").write.format("noop").mode("overwrite").save()
    take_in()
    return known()
