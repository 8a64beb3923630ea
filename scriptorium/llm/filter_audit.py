"""How quality filters act on each other, for every order of applying them and every part of a corpus.

A document's mask says which filters it fails, so 32 mask counts hold all that any order can
do to a part. From them each part gets its removal polynomial, the multilinear extension of
"how many documents does this set of filters remove": its coefficient at a set of filters
comes from the counts by Moebius inversion, its value at a corner is what that set removes,
and a filter's Shapley value is the integral of its partial derivative along the diagonal.

Texts are read once. What leaves a task is a row of some sixty bytes a document, and equal
texts meet by partial aggregation; counts are summed before their shuffle. A part is one row
of 32 counts, whatever its size.

Edge cases: a null text counts as empty, a null source as the empty string; a null doc_id is
neither smaller nor larger than any other, so such a row never fails E and has no label;
rows that repeat a doc_id and a text do not make each other fail E; a label row repeated for
a doc_id counts if any of its rows is 1; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import drop_written, written

FILTERS = "ABCDE"
LEAST_WORDS = 200
_MASKS = 1 << len(FILTERS)
_SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: few words (A), repeated words (B), capitals (C), symbols (D)."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < LEAST_WORDS, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail, and of these the labelled ones.

    `docs` (doc_id, text, source), `labels` (doc_id, quality, toxic).
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("hash"), text_mask(text).alias("mask"))
    rows = written(own.groupBy("doc_id", "part", "hash", "mask").agg(F.count("*").alias("n")))
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    known = rows.join(firsts, ["hash", "doc_id"], "left").join(marked, "doc_id", "left")
    repeats = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("mask") + F.when(repeats, F.lit(1 << 4)).otherwise(F.lit(0))
    some = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    counts = written(known.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), some("g").alias("good"), some("t").alias("toxic")))
    drop_written(rows)
    return counts


def removal_polynomial(counts: np.ndarray) -> np.ndarray:
    """Coefficients (parts x 32) of the removal polynomials from mask counts (parts x 32).

    A set of filters removes all documents but those whose mask lies in its complement;
    Moebius inversion over subsets turns these corner values into coefficients.
    """
    inside = counts.copy()
    for i in range(len(FILTERS)):
        with_i = [m for m in range(_MASKS) if m >> i & 1]
        inside[:, with_i] += inside[:, [m ^ (1 << i) for m in with_i]]
    values = counts.sum(axis=1, keepdims=True) - inside[:, ::-1]
    for i in range(len(FILTERS)):
        with_i = [m for m in range(_MASKS) if m >> i & 1]
        values[:, with_i] -= values[:, [m ^ (1 << i) for m in with_i]]
    return values


def corner(polynomial: np.ndarray, chosen: int) -> np.ndarray:
    """Documents of each part that the filters in `chosen` remove: the terms whose variables are all 1."""
    return polynomial[:, [m for m in range(_MASKS) if m & chosen == m]].sum(axis=1)


def shapley_of_orders(polynomial: np.ndarray, i: int) -> np.ndarray:
    """Filter i's removals summed over all orders: the diagonal integral of its partial derivative, times their number.

    A term of k variables with x_i among them has the derivative of k - 1 others, whose
    integral over the diagonal is 1 / k.
    """
    total = factorial(len(FILTERS))
    out = np.zeros(len(polynomial), np.int64)
    for m in range(_MASKS):
        if m >> i & 1:
            scaled = Fraction(1, m.bit_count()) * total
            assert scaled.denominator == 1
            out += polynomial[:, m] * scaled.numerator
    return out


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of (part, mask, n, good, toxic).

    Every part gives one row for each order of the filters and each step of it.
    """
    names = ("n", "good", "toxic")
    slots = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for c in names for m in range(_MASKS)]
    wide = counts.groupBy("part").agg(F.array(*slots).alias("counts"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = [[FILTERS.index(x) for x in order] for order in orders]
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                parts = batch.slice(at, 64)
                table = np.array(parts.column("counts").to_pylist(), np.int64).reshape(-1, len(names), _MASKS)
                all_, good, toxic = (removal_polynomial(table[:, c]) for c in range(len(names)))
                whole = table[:, 0].sum(axis=1)
                gone = {s: [corner(p, s) for p in (all_, good, toxic)] for s in range(_MASKS)}
                shares = [shapley_of_orders(all_, i) for i in range(len(FILTERS))]
                out: list[np.ndarray] = []
                for order in bits:
                    before = 0
                    for i in order:
                        after = before | 1 << i
                        removed, lost_good, lost_toxic = (gone[after][c] - gone[before][c] for c in range(3))
                        out.append(np.stack([whole - gone[after][0], removed, gone[1 << i][0] - removed, table[:, 0, 1 << i], lost_good, lost_toxic, shares[i]]))
                        before = after
                values = np.stack(out)  # steps x columns x parts
                n = values.shape[2]
                part = pa.array(np.repeat(np.arange(n), len(out)))
                arrays = [parts.column("part").take(part), pa.array(np.tile(np.repeat(orders, len(FILTERS)), n)), pa.array(np.tile(np.arange(len(out)) % len(FILTERS) + 1, n), pa.int32())]
                arrays += [pa.array(values[:, c].T.reshape(-1)) for c in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", *columns])

    return wide.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`audit` of `mask_counts`."""
    return audit(mask_counts(docs, labels))


#: DuckDB SQL of `filter_audit`: applies all orders document by document, and sums the removals of each filter.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
  WHEN 'A' THEN len(ws) < 200 WHEN 'B' THEN 100 * len(list_distinct(ws)) < 50 * len(ws) WHEN 'C' THEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text)
  WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE coalesce(w.doc_id > least_id, false) END) AS fails
  FROM w JOIN (SELECT text, min(doc_id) AS least_id FROM w GROUP BY 1) USING (text) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
v(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM v a, v b, v c, v d, v e WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, n, good, toxic, len(fails) AS n_fails, list_contains(fails, substr(filter_order, step, 1)) AS hit, coalesce(list_bool_or(list_transform(fails, lambda x: position(x IN left(filter_order, step - 1)) > 0)), false) AS gone FROM c, o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (hit AND n_fails = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
