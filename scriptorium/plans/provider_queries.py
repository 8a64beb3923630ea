"""Queries of the connector to hosted models: requests, resumed builds, structured output."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import connect, providers, structured
from ..scratch import folder, kept
from ..sources import tables
from .base import table

QUERIES, ORACLE_SQL = {}, {}
SLOTS, REQUEST_TOKENS = 4, 2000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def count_words(said: str) -> int:
    return len([w for w in said.split(" ") if w])


class SizeService:
    """Stands in for a hosted embedder: a text's vector is its numbers of characters and words, and every third call is refused."""

    def __init__(self) -> None:
        self.calls = 0

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        self.calls += 1
        if self.calls % 3 == 0:
            raise connect.Retryable("slow down")
        return [[float(len(t)), float(count_words(t))] for t in texts]


_LIMITS = connect.Limits(tokens=REQUEST_TOKENS, texts=100, first_wait=0.0, slots=SLOTS)
_WORDS = "len(list_filter(string_split(text, ' '), lambda w: w <> ''))"


@query(f"""
WITH RECURSIVE t AS (SELECT doc_id, doc_id % {SLOTS} AS slot, row_number() OVER (PARTITION BY doc_id % {SLOTS} ORDER BY doc_id) AS i, {_WORDS} AS n FROM documents),
f AS (SELECT slot, i, 1 AS request_no, n AS total, 1 AS held, n FROM t WHERE i = 1
  UNION ALL SELECT slot, i, request_no + opens, CASE WHEN opens = 1 THEN n ELSE total + n END, CASE WHEN opens = 1 THEN 1 ELSE held + 1 END, n
  FROM (SELECT t.slot, t.i, t.n, f.request_no, f.total, f.held, CASE WHEN (f.total > 0 AND f.total + t.n > {REQUEST_TOKENS}) OR f.held = 100 THEN 1 ELSE 0 END AS opens FROM f JOIN t ON t.slot = f.slot AND t.i = f.i + 1))
SELECT CAST(slot AS INT) AS slot, request_no, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS tokens, CASE WHEN request_no >= 3 AND request_no % 2 = 1 THEN 2 ELSE 1 END AS calls FROM f GROUP BY slot, request_no
""")
def embed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that embedding all documents takes, with the calls of each, against a service that refuses every third call of a stream."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    ask = lambda session, batch: {"vec": session.embed(batch["text"].tolist(), "document")}
    log = connect.ask_in_requests(rows, SizeService, ask, "vec array<float>", _LIMITS, count_words, order=["doc_id"], slot="doc_id", log=True)
    return log.groupBy("slot", "request_no").agg(F.count("*").alias("n_texts"), F.max("tokens").alias("tokens"), F.max("calls").alias("calls"))


@query(f"SELECT chunk_id, round(CAST(CAST(CAST(CAST(c AS FLOAT) AS DOUBLE) / s AS FLOAT) AS DOUBLE), 4) AS x, round(CAST(CAST(CAST(CAST(w AS FLOAT) AS DOUBLE) / s AS FLOAT) AS DOUBLE), 4) AS y FROM (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, len(text) AS c, {_WORDS} AS w, greatest(sqrt(len(text) * len(text) + {_WORDS} * {_WORDS}), 1e-12) AS s FROM documents)")
def embed_build(spark: SparkSession, sf: str) -> DataFrame:
    """The stored vectors of all documents after two builds, the second of which asks only for what the first, over every other document, lacks."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text")
    embedder = providers.RemoteEmbedder(SizeService, "sizes", 2, count_words, _LIMITS)
    path = f"{folder(spark).rstrip('/')}/build-{uuid.uuid4().hex}"
    providers.build_embeddings(rows.filter("doc_id % 2 = 0").select("chunk_id", "text"), path, embedder)
    stored = providers.build_embeddings(rows.select("chunk_id", "text"), path, embedder)
    out = kept(stored.select("chunk_id", F.round(F.col("vec")[0].cast("double"), 4).alias("x"), F.round(F.col("vec")[1].cast("double"), 4).alias("y")))
    tables.delete(spark, path)
    return out


class CardService:
    """Stands in for a language model that writes cards as JSON, with a fault by the number in the prompt; odd numbers are right when told of it."""

    def generate(self, prompt: str) -> str:
        asked, end = json.JSONDecoder().raw_decode(prompt)
        said, again = asked.get("text", ""), end < len(prompt)
        card = {"front": " ".join(said.split(" ")[:4]), "back": said}
        whole = json.dumps({"cards": [card]}, ensure_ascii=False)
        fault = asked["id"] % 7
        if fault == 5 or (again and asked["id"] % 2):
            return f"```json\n{whole}\n```"
        return {0: whole[:-3], 1: json.dumps({"cards": [{"front": card["front"]}]}), 2: json.dumps({"cards": [card | {"front": ""}]}), 3: json.dumps({"cards": said}), 4: "I would rather not.", 6: whole}[fault]


_FRONT = "array_to_string(string_split(text, ' ')[1:4], ' ')"


@query(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, text, trim({_FRONT}) <> '' AS has FROM conversations),
f AS (SELECT id, text, has, CASE id % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'missing' WHEN 2 THEN 'empty_front' WHEN 3 THEN 'malformed' WHEN 4 THEN 'malformed' ELSE CASE WHEN has THEN 'ok' ELSE 'empty_front' END END AS first_try FROM t),
g AS (SELECT *, CASE WHEN id % 2 = 1 THEN CASE WHEN has THEN 'ok' ELSE 'empty_front' END ELSE first_try END AS second_try FROM f)
SELECT id, 1 AS attempt, first_try AS outcome, false AS final, CASE WHEN first_try = 'ok' THEN {_FRONT} ELSE '' END AS front FROM g
UNION ALL SELECT id, 2, second_try, second_try <> 'ok', CASE WHEN second_try = 'ok' THEN {_FRONT} ELSE '' END FROM g WHERE first_try <> 'ok'
""")
def structured_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a card from JSON with planted faults: each attempt's outcome, and the front of what passed."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    prompts = turns.select("id", F.to_json(F.struct("id", "text")).alias("prompt"))
    checks = {"empty_front": lambda v: F.forall(v["cards"], lambda c: F.trim(c["front"]) != "")}
    generator = providers.RemoteGenerator(CardService, connect.Limits(texts=1, slots=SLOTS))
    good, failures = structured.generated(prompts, generator, structured.CARDS, checks)
    passed = good.select("id", "attempt", F.lit("ok").alias("outcome"), F.lit(False).alias("final"), F.col("value.cards")[0]["front"].alias("front"))
    return passed.unionByName(failures.select("id", "attempt", F.col("check").alias("outcome"), "final", F.lit("").alias("front")))
