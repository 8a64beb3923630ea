"""Importance resampling towards a target distribution of hashed word runs.

Features are all runs of one to three consecutive words, each counted; a run's bucket is the
CRC-32 of its bytes modulo the number of buckets. Tasks see texts as Arrow buffers: a lookup
table folds and classifies bytes, differences give the word boundaries, and table-driven CRCs
advance one byte at a time for all words at once. A run of two words goes on from the state
that its first word left, one of three words from that of its first two.

Two passes read the texts: one counts buckets (at most `buckets` rows leave a task), one
weighs documents by the gains of the buckets, an array of that many entries. Scores are
ordered by ranges, never in one task.

Edge cases: null and empty texts have no words, no features and weight 0; a null doc_id
hashes as the empty string and loses ties; rows that repeat a doc_id are documents of their
own; an empty corpus gives no rows, an empty target makes every gain that of t = T = 0;
other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import numbered
from ._arrays import bounded, release, spans, text_buffer
from ._spark import written

RUN = 3
#: Bytes of a text whose words are held at once; a longer text is cut between words.
BLOCK = 2_000_000
#: With so few words left that are longer than the steps made, each is finished by itself.
FEW = 16

_SPACE = 0x20


def _fold_table() -> np.ndarray:
    """Byte -> itself in a word, its lower case for A-Z, a space outside words."""
    table = np.full(256, _SPACE, np.uint8)
    for low, high, shift in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
        table[low : high + 1] = np.arange(low, high + 1) + shift
    return table


def _crc_table() -> np.ndarray:
    """Remainders of all bytes by the reflected polynomial of CRC-32."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & np.uint32(1), (rest >> np.uint32(1)) ^ np.uint32(0xEDB88320), rest >> np.uint32(1))
    return rest


_FOLD, _CRC = _fold_table(), _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


class _Runs:
    """CRC states of the runs that end at each word of one block; texts may go on in the next one."""

    def __init__(self) -> None:
        self.states = np.zeros(RUN, np.uint32)  # of the last word so far
        self.words = 0  # of the open text so far

    def close(self) -> None:
        self.words = 0

    def add(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(crcs, place): crcs[k - 1][w] of the k words up to w, place[w] the number of words before w in its text.

        Words of row 0 go on from those of the last call unless it was closed.
        """
        n = len(starts)
        first = np.searchsorted(rows, rows, side="left")
        place = np.arange(n) - first + np.where(rows == 0, self.words, 0)
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        # active[j]: words longer than j bytes; they are the first ones in `order`.
        active = n - np.cumsum(np.bincount(lengths))
        crcs = np.empty((RUN, n), np.uint32)
        before = np.full(n, 0xFFFFFFFF, np.uint32)
        for k in range(RUN):
            if k:
                before = np.concatenate((self.states[k - 1 : k], crcs[k - 1][:-1]))
                before = _step(before, np.uint32(_SPACE))
            state, at = before[order], starts[order]
            for j, m in enumerate(active.tolist()):
                if m <= FEW:
                    for i in range(m):
                        rest = folded[at[i] : ends[order[i]]].tobytes()
                        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
                    break
                state[:m] = _step(state[:m], folded[at[:m]])
                at[:m] += 1
            crcs[k][order] = state
        self.states, self.words = crcs[:, -1].copy(), int(place[-1]) + 1
        return crcs, place


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(from, to, last) of the parts of a buffer: whole where it is small, else of its one text, cut before a word."""
    if len(offsets) > 2 or len(data) <= BLOCK:
        yield 0, len(data), True
        return
    start = 0
    while start < len(data):
        end = start + BLOCK
        while end < len(data):
            gap = np.flatnonzero(_FOLD[data[end : end + BLOCK]] == _SPACE)
            if len(gap):
                end += int(gap[0])
                break
            end += BLOCK
        end = min(end, len(data))
        yield start, end, end == len(data)
        start = end


def word_runs(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, place, row) of the runs that end at each word of a column of texts: buckets[k - 1] of k words, where place >= k - 1."""
    data, offsets = text_buffer(column)
    runs = _Runs()
    for start, end, last in _blocks(data, offsets):
        folded = _FOLD[data[start:end]]
        inside = offsets if last and not start else np.array([0, end - start])
        begin, stop, rows = spans(folded != _SPACE, inside)
        if len(begin):
            crcs, place = runs.add(folded, begin, stop, rows)
            yield (~crcs % np.uint32(buckets)).astype(np.int64), place, rows


def bucket_counts(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """bucket, `name`: the runs of `text` by bucket; a task gives each bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in bounded(batches, "text"):
            for found, place, _ in word_runs(batch.column("text"), buckets):
                for k in range(RUN):
                    total += np.bincount(found[k][place >= k], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", name])

    counted = texts.select("text").mapInArrow(count, f"bucket long, `{name}` long")
    return counted.groupBy("bucket").agg(F.sum(name).alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket; s of S runs of `docs`, t of T of `target`."""
    both = bucket_counts(docs, buckets, "s").join(bucket_counts(target, buckets, "t"), "bucket", "full")
    # At most `buckets` rows.
    s, t = np.zeros((2, buckets), np.int64)
    for row in both.collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"] or 0, row["t"] or 0
    whole, aimed = int(s.sum()), int(t.sum())
    ratio = lambda a, b: float((b + 1) * (whole + buckets)) / float((a + 1) * (aimed + buckets))
    return [math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]


def weighed(docs: DataFrame, gains: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight of every row: the sum of its runs' gains."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.float64)  # sums stay exact far below 2^53
        for batch in bounded(batches, "text"):
            n = batch.num_rows
            words, features, weight = np.zeros((3, n))
            for found, place, rows in word_runs(batch.column("text"), buckets):
                words += np.bincount(rows, minlength=n)
                for k in range(RUN):
                    has = place >= k
                    features += np.bincount(rows[has], minlength=n)
                    weight += np.bincount(rows[has], weights=gain[found[k][has]], minlength=n)
            numbers = [pa.array(x.astype(np.int64)) for x in (words, features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *numbers], ["doc_id", "text_hash", "n_words", "n_features", "weight"])
        release()

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(weigh, f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, rank of every row of (doc_id, text).

    `target` (text) shows the distribution aimed at. A score is the weight plus Gumbel noise
    of a thousandth's grain that `seed` and doc_id fix, so the highest scores are a draw
    without replacement. Of the rows with `least_words` words, the `percent` hundredths of
    highest score are drawn and have ranks from 1, ties by smaller doc_id; `rank` is null
    for all others.
    """
    gains = bucket_gains(docs, target, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(name.cast("binary"), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, gains).withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    keyed = able.withColumns({"_score": -F.col("score"), "_none": F.col("doc_id").isNull()})
    place = numbered(keyed, "rank", "_score", "_none", "doc_id", "text_hash").drop("_score", "_none")
    ranked = place.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of `docs` that `ranked` (of `resample`) drew, all columns; an equal row goes with the one drawn."""
    chosen = ranked.filter("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(chosen["_id"]) & (F.xxhash64(docs["text"]) == chosen["_hash"])
    return docs.join(chosen, same, "left_semi")


def _sql(buckets: int = 10_000) -> str:
    """DuckDB SQL of `resample` with its defaults; CRCs step through the bytes of each distinct run."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    codes = "list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST(('0x' || x) AS UBIGINT))"
    ones = "CAST(4294967295 AS UBIGINT)"
    return f"""
WITH RECURSIVE bits AS (SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS r, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS UBIGINT)) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT i, r FROM bits WHERE k = 8),
tables AS MATERIALIZED (SELECT list(r ORDER BY i) AS tab FROM crc),
w AS MATERIALIZED (SELECT kind, id, ws FROM (SELECT 0 AS kind, doc_id AS id, {words} AS ws FROM documents UNION ALL SELECT 1, item_id, {words} FROM benchmark)),
g AS (SELECT kind, id, unnest(list_concat(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w),
n AS MATERIALIZED (SELECT kind, id, f, count(*) AS n FROM g GROUP BY ALL),
b AS MATERIALIZED (SELECT f, CAST(xor(list_reduce({codes}, lambda c, y: xor(c >> 8, tab[CAST(xor(c, y) & 255 AS INT) + 1]), {ones}), {ones}) % {buckets} AS INT) AS bucket FROM (SELECT DISTINCT f FROM n), tables),
c AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM n JOIN b USING (f) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + {buckets}) AS DOUBLE) / CAST((s + 1) * (tt + {buckets}) AS DOUBLE))) AS BIGINT) AS gain FROM c, (SELECT sum(s) AS ss, sum(t) AS tt FROM c)),
wt AS (SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN b USING (f) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY 1),
sc AS (SELECT w.id AS doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || CAST(w.id AS VARCHAR)), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN wt ON wt.doc_id = w.id WHERE kind = 0),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sc WHERE n_words >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN r <= 5 * (SELECT count(*) FROM rk) // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)
"""


SQL = _sql()
