"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the SQL that each must equal."""

from __future__ import annotations

from . import answer_queries, provider_queries, retrieval_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **retrieval_queries.QUERIES, **answer_queries.QUERIES, **provider_queries.QUERIES}
ORACLE_SQL: dict = {**text_queries.ORACLE_SQL, **retrieval_queries.ORACLE_SQL, **answer_queries.ORACLE_SQL, **provider_queries.ORACLE_SQL}
