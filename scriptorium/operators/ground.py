"""Checks of answers and cards against the text they were given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text


def pages_covered(context: DataFrame) -> DataFrame:
    """query_id, pages (sorted): pages of all chunks of a context (query_id, page_start, page_end)."""
    spans = context.select("query_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return spans.groupBy("query_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def verify_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, unverified_pages: pages that an answer (query_id, text) names and no chunk of its context covers."""
    seen = answers.join(pages_covered(context), "query_id", "left")
    missing = F.array_except(text.pages_mentioned("text"), F.coalesce("pages", F.array().cast("array<int>")))
    return seen.select("query_id", F.sort_array(missing).alias("unverified_pages"))


def resolve_citations(citations: DataFrame, context: DataFrame) -> DataFrame:
    """Citations (query_id, document_index, cited_text) with their chunk; an index outside the context is dropped."""
    placed = context.select("query_id", (F.col("pos") - 1).alias("document_index"), "chunk_id", "page_start", "page_end")
    return citations.join(placed, ["query_id", "document_index"])


def citation_sections(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (chunk_id, ...) with the section of their chunk; an empty string if no chunk has the id."""
    return citations.join(chunks.select("chunk_id", "section"), "chunk_id", "left").withColumn("section", F.coalesce("section", F.lit("")))


def ground_cards(cards: DataFrame, least: float = rules.MIN_GROUNDING) -> DataFrame:
    """Cards (front, back, source_text) with overlap and grounded."""
    overlap = text.coverage(text.content_words("back"), text.content_words("source_text"))
    return cards.withColumn("overlap", overlap).withColumn("grounded", F.col("overlap") >= least)


def first_by_front(cards: DataFrame, *order: str) -> DataFrame:
    """Of cards whose fronts fold alike the first in `order`."""
    from pyspark.sql.window import Window

    keyed = cards.withColumn("__front", text.fold("front"))
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__front").orderBy(*order))).filter("__n = 1").drop("__front", "__n")
