"""Answers from retrieved chunks: gate, context, generation, refusals, citations, page check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..scratch import kept
from . import ground, retrieve

# Texts of abstentions by reason.
LOW_CONFIDENCE = "The passages found do not settle this question."
REFUSAL = "This question is outside what the corpus covers."


def context_of(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """query_id, pos, chunk_id, section, category, text_raw, page_start, page_end: the chunks given for each question, in order."""
    places = retrieve.answer_context(questions, ranked, ranked if expanded is None else expanded, chunks)
    category = F.col("category") if "category" in chunks.columns else F.lit(rules.NO_CATEGORY)
    return places.join(chunks.select("chunk_id", "section", category.alias("category"), "text_raw", "page_start", "page_end"), "chunk_id")


def answer(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, generator, expanded: DataFrame | None = None, least: float = rules.MIN_CONFIDENCE, work: str = "Corpus") -> DataFrame:
    """query_id, top_score, abstained, abstain_reason, enumeration, text, citations, unverified_pages of every question.

    `ranked` (query_id, chunk_id, score, source, rank) are the reranked chunks and
    `expanded` those with their groups. Questions whose best score is under `least` abstain
    before any model is asked; one that asks for a list gets the whole section of the
    best chunk first. `generator.answer` gives text, stop_reason and `cited`; a refusal
    abstains too. Citations (array of chunk_id, section, cited_text, pages) outside the
    context are dropped; pages that the text names and no chunk covers are unverified.
    """
    gated = kept(retrieve.gate(questions, ranked, least))
    passed = questions.join(gated.filter("is_confident").select("query_id"), "query_id", "left_semi")
    only = lambda df: df.join(passed.select("query_id"), "query_id", "left_semi")
    context = kept(context_of(passed, only(ranked), chunks, None if expanded is None else only(expanded)))
    title = text.document_title(work, "section", "category", "page_start", "page_end")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", title.alias("title"), F.col("text_raw").alias("text")))), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    prompts = context.groupBy("query_id").agg(listed.alias("context")).join(passed.select("query_id", "question"), "query_id")
    said = kept(generator.answer(prompts).select("query_id", "text", "stop_reason", "cited"))
    given = said.filter("stop_reason <> 'refusal'")
    cited = given.select("query_id", F.inline("cited"))
    found = ground.resolve_citations(cited, context).join(context.select("query_id", "chunk_id", "section"), ["query_id", "chunk_id"])
    citations = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("document_index", "chunk_id", "section", "cited_text", "page_start", "page_end"))).alias("citations"))
    checked = ground.verify_citations(given.select("query_id", "text"), context)
    rows = gated.join(said, "query_id", "left").join(citations, "query_id", "left").join(checked, "query_id", "left").join(questions.select("query_id", text.is_enumeration_question("question").alias("asks_list")), "query_id")
    refused = F.coalesce(F.col("stop_reason") == "refusal", F.lit(False))
    reason = F.when(~F.col("is_confident"), F.lit("low-confidence")).when(refused, F.lit("refusal"))
    shown = F.when(~F.col("is_confident"), F.lit(LOW_CONFIDENCE)).when(refused, F.lit(REFUSAL)).otherwise(F.trim("text"))
    return rows.select("query_id", "top_score", reason.isNotNull().alias("abstained"), reason.alias("abstain_reason"), (F.col("is_confident") & F.col("asks_list")).alias("enumeration"), shown.alias("text"), "citations", "unverified_pages")
