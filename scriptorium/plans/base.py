"""Inputs of the catalogue's queries and the SQL fragments that their oracles share.

`documents` stand for sections: doc_id is id and corpus order, source the collection,
the first line the title. `benchmark` items are questions, `labels` give polarity,
`conversations` question and answer turns. Rule tables that would match nothing in
these texts are replaced by ones for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import spread

#: Word -> canonical word for these texts.
ALIASES = {"ththe": "thing", "onan": "with", "inan": "the", "thin": "thin", "erst": "first", "des": "les", "que": "qui"}
CATEGORIES = ((r"\bthe (in|on)\b|\bnicht", "non-nullifier"), (r"\bthe\b|\bder\b", "nullifier"), (r"\band\b|\bund\b", "fard"), (r"\bof\b|\bla\b", "wajib"), (r"\bde\b|\bdie\b", "sunnah"))
RANGES = ((0, 4, "first"), (5, 9, "second"), (10, 14, "third"))

PUNCT = r"[’''‘`ʾʿ\"“”.,:;()\[\]{}!?…—–\-/]"
ORDINALS = tuple(range(4))


def sql_fold(x: str, digits: bool = False) -> str:
    """SQL of text.fold for texts without characters beyond Latin Extended-A."""
    inner = f"strip_accents({x})"
    if digits:
        inner = f"regexp_replace({inner}, '\\d+', '', 'g')"
    return f"lower(trim(regexp_replace(regexp_replace({inner}, '{PUNCT}', '', 'g'), '\\s+', ' ', 'g')))"


def sql_words(x: str, stop: tuple[str, ...]) -> str:
    stops = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter(regexp_extract_all({sql_fold(x)}, '[a-z]+'), lambda w: len(w) > 2 AND NOT list_contains([{stops}], w))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, one chunk a document."""
    docs = table(spark, sf_dir, "documents")
    page = (F.col("doc_id") % 160 + 1).cast("int")
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        "doc_id",
        F.col("source").alias("collection"),
        F.element_at(F.split("text", "\n"), 1).alias("section"),
        page.alias("page_start"),
        (page + (F.col("n_chars") / 2500).cast("int")).cast("int").alias("page_end"),
        (F.col("doc_id") % 3).cast("int").alias("part"),
        F.col("text").alias("text_raw"),
        F.col("doc_id").cast("long").alias("ordinal"),
    )


#: The same table in SQL, as a CTE named c.
SQL_CHUNKS = "c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id, source AS collection, string_split(text, chr(10))[1] AS section, CAST(doc_id % 160 + 1 AS INT) AS page_start, CAST(doc_id % 160 + 1 + n_chars // 2500 AS INT) AS page_end, CAST(doc_id % 3 AS INT) AS part, text AS text_raw, doc_id AS ordinal FROM documents)"


def folded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "ordinal", "section", "text_raw", text.fold("text_raw").alias("text_folded"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
