"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage keeps rows with a null doc_id or text unless its decision takes them, goes by
each row's own text where ids repeat, keeps all columns whatever their names, and gives no
rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from scriptorium.llm._spark import drop_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below one half; null and empty texts have no hits and stay."""
    return toxicity.learned_without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a near-equal earlier line repeats; one that is left blank by this goes."""
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", row))
    kept = kept.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    own = lambda c: F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c)
    return kept.select(*[F.col("text") if c == "text" else own(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; documents without words or without an id are in no group and stay, as do all rows of the id that stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have no words and stay."""
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; null and empty texts give their closing token."""
    from public_tokenizers import path

    pieces = packing.pack_documents(docs, path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned and fuzzy stages have no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's table goes when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
