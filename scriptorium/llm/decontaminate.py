"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every benchmark item is a set of windows of `size` consecutive words (a shorter
item is one window). The words of a window are ordered by rarity in the documents;
its rarest word is its prefix, which any document with the window must contain.
Prefix words are joined with document positions, the offset of the word in the
window gives the one possible start, bounds on start and length discard starts
outside the document, and the words there are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes runs of digits, letters a-z and characters beyond ASCII; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, _SEPARATORS), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, w (the words) of every distinct window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (size - 1))))
    return items.select("item_id", "ws", starts.alias("at")).select("item_id", F.slice("ws", F.col("at"), size).alias("w")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tk, ws: a hash of the text tells rows of one doc_id, or of none, apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("tk"), words(F.col("text")).alias("ws"))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tk"] == right["tk"])


def _spans(docs: DataFrame, benchmark: DataFrame, size: int, broadcast_rows: int) -> DataFrame:
    """doc_id, tk, start, length (in words), item_id of every occurrence of every window.

    The prefix table has one row a distinct window; it is broadcast only where a
    count shows at most `broadcast_rows`. Beyond, words are shuffled with their place
    alone, and the starts that come of this meet each text once.
    """
    windows = item_windows(benchmark, size).groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = _spark.written(windows)
    small = windows.count() <= broadcast_rows
    sized = F.broadcast if small else (lambda df: df)
    tokens = _keyed(docs)

    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    counts = tokens.select(F.explode("ws").alias("word")).join(sized(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    ranked = windows.select("w", "items", F.posexplode("w").alias("at", "word")).join(sized(vocabulary.join(counts, "word", "left")), "word")
    rarest = F.min_by(F.struct("at", "word"), F.struct(F.coalesce("n", F.lit(0)), "word", "at"))
    prefix = ranked.groupBy("w").agg(F.first("items").alias("items"), rarest.alias("rare")).select("w", "items", F.col("rare.at").alias("at"), F.col("rare.word").alias("word"))
    prefix = _spark.written(prefix)

    start = F.col("pos") - F.col("at")
    if small:
        placed = tokens.select("doc_id", "tk", "ws", F.posexplode("ws").alias("pos", "word"))
        bounds = (start >= 0) & (start + F.size("w") <= F.size("ws"))
        hit = placed.join(sized(prefix), "word").filter(bounds).filter(F.slice("ws", start + 1, F.size("w")) == F.col("w"))
        return hit.select("doc_id", "tk", start.alias("start"), F.size("w").alias("length"), F.explode("items").alias("item_id"))
    placed = tokens.select("doc_id", "tk", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "word"))
    starts = placed.join(prefix, "word").filter((start >= 0) & (start + F.size("w") <= F.col("n"))).select("doc_id", "tk", start.alias("start"), "w", "items")
    # Starts of one text in one row: bounded by its words and the windows of one prefix word.
    asked = starts.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "w", "items")).alias("asked"))
    once = tokens.dropDuplicates(["doc_id", "tk"])
    met = asked.join(once, _same_row(asked, once)).select(asked["doc_id"], asked["tk"], F.filter("asked", lambda x: F.slice(F.col("ws"), x["start"] + 1, F.size(x["w"])) == x["w"]).alias("found"))
    hit = met.select("doc_id", "tk", F.inline("found"))
    return hit.select("doc_id", "tk", "start", F.size("w").alias("length"), F.explode("items").alias("item_id"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, start, length (in words), item_id of every occurrence of every window.

    Null and empty texts have none; equal rows are one. A null doc_id is kept, and rows
    that repeat a doc_id with different texts have each their own. Empty tables give no rows.
    """
    return _spans(docs, benchmark, size, broadcast_rows).drop("tk").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids) of every document.

    Null and empty texts have no words and no hits; an item without words has no
    window; an empty benchmark hits nothing. Hits belong to a doc_id and its text, so
    rows without a doc_id or with a repeated one get those of their own text. Only doc_id,
    text and item_id are read. Long texts are scanned whole.
    """
    found = _spans(docs, benchmark, size, broadcast_rows)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    hits = found.groupBy("doc_id", "tk").agg(spans.alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")),
        lambda acc: acc["n"],
    )
    hits = hits.select("doc_id", "tk", covered.cast("long").alias("hit"), "items")
    sizes = _keyed(docs).select("doc_id", "tk", F.size("ws").cast("long").alias("n_words"))
    empty = F.array().cast("array<string>")
    return sizes.join(hits, _same_row(sizes, hits), "left").select(sizes["doc_id"], "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"), F.size(F.coalesce("items", empty)).cast("long").alias("n_items"), F.coalesce("items", empty).alias("items"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, with their columns, whose names cannot clash.

    Rows without a doc_id, and rows that repeat one, go by their own text; null and
    empty texts stay; an empty benchmark leaves all rows, an empty table gives none.
    """
    hit = _spans(docs.select("doc_id", "text"), benchmark, size, 200_000).select("doc_id", "tk").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("tk"))
    return rows.join(hit, _same_row(rows, hit), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same result by comparing all windows, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, w, len(w) AS n FROM (SELECT item_id, list_slice(ws, i, i + 9) AS w FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0))),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS w FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.w = win.w),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
