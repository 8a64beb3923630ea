"""A mix of sources to target weights, in blocks of equal token counts.

Sources get targets by weight, at most `most` times their own size, and whole passes of their
documents as far as the target holds them. What a target has beyond is taken in blocks:
Sainte-Laguë apportionment (highest quotients of votes and 1, 3, 5, ...) gives each source
its number of blocks, and again each shard of a source its integer quota. A shard lays its
documents on a line in seeded order; its quota of equal blocks is chosen at equal steps from
a seeded start, so a document knows its share from its place alone.

Quotients are not listed seat by seat: a divisor that is surely too large gives most seats at
once, and only the quotients down to a divisor that is surely too small, at most two a party
and a few in all, are ordered, by ranges. No step holds a source or the sources in one task:
a shard has about `SHARD_WORDS` words and `SHARD_ROWS` rows, and equal rows travel as one.

Edge cases: null and empty texts have size 0 and nothing is taken of them; a null source is a
source of its own, after all others; rows that repeat an id and all else are told apart by
nothing, so any of them may have any of their shares; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import numbered
from ._spark import drop_written, written

BLOCK = 16
SHARD_WORDS = 1 << 16
SHARD_ROWS = 1 << 10
#: Tables of at most so many rows are broadcast; a count decides.
BROADCAST_ROWS = 200_000


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def capped_shares(sources: DataFrame, total: float, most: float = 2.0) -> DataFrame:
    """`sources` (size, weight, ...) with `target`: shares of `total` by weight, at most `most` times the size, the excess shared again.

    Each round is one sum over the sources; shares only grow, so a source that has
    reached its bound stays there.
    """
    level = 0.0
    while True:
        # Exact sums: sizes and weights are integers.
        open_ = F.lit(level) * F.col("weight") <= most * F.col("size")
        row = sources.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(~open_, F.col("size"))), F.lit(0)).alias("full")).first()
        if not row["w"]:
            break
        higher = (total - most * row["full"]) / row["w"]
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), most * F.col("size")))


def sainte_lague(parties: DataFrame, by: str, seats: DataFrame) -> DataFrame:
    """`parties` (`by`, party, votes, ...) with `won`, the seats of each by highest quotients, ties by party.

    `seats` has (`by`, seats), once each. A party without votes wins none.
    """
    voting = F.col("votes") > 0
    sums = parties.groupBy(by).agg(F.sum(F.when(voting, F.col("votes"))).alias("_all"), F.count_if(voting).alias("_n")).join(seats, by)
    # Rounding moves a party by half a seat at most, so these divisors give too few and enough.
    half = F.col("_n") / 2 + 1
    large = F.when(F.col("seats") > half, F.col("_all") / (F.col("seats") - half))
    small = F.col("_all") / (F.col("seats") + half)
    known = written(sums.select(by, F.col("seats").alias("_seats"), large.alias("_large"), small.alias("_small")))
    at = lambda divisor: F.coalesce(F.floor(F.col("votes") / F.col(divisor) + 0.5), F.lit(0))
    given = written(parties.join(_sized(known), by, "left").withColumns({"_sure": F.when(voting, at("_large")).otherwise(F.lit(0)), "_may": F.when(voting, at("_small")).otherwise(F.lit(0))}))
    left = given.groupBy(by).agg(F.first("_seats").alias("_seats"), F.sum("_sure").alias("_sure")).select(by, (F.col("_seats") - F.col("_sure")).alias("_left"))
    asked = given.filter(F.col("_may") > F.col("_sure")).select(by, "party", "votes", F.explode(F.sequence(F.col("_sure") + 1, F.col("_may"))).alias("_seat"))
    quotient = F.col("votes") / (2 * F.col("_seat") - 1)
    placed = numbered(asked.select(by, "party", (-quotient).alias("_order"), "_seat"), "_place", by, "_order", "party", "_seat")
    first = placed.groupBy(by).agg(F.min("_place").alias("_first")).join(left, by)
    ranked = placed.join(_sized(first), by).filter(F.col("_place") - F.col("_first") < F.col("_left"))
    more = ranked.groupBy(by, "party").agg(F.count("*").alias("_more"))
    won = (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias("won")
    return given.join(more, [by, "party"], "left").select(*parties.columns, won)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _chosen_to(k: Column) -> Column:
    """How many of the first `k` blocks of a shard are chosen: at equal steps, `won` in all."""
    return _div(k * F.col("won") + F.col("start"), F.col("blocks"))


def _chosen_before(x: Column, block: int) -> Column:
    """Words of the chosen blocks among the first `x` words of a shard."""
    whole = _div(x, F.lit(block))
    return block * _chosen_to(whole) + x % block * (_chosen_to(whole + 1) - _chosen_to(whole))


def _ranges(at: Column, size: Column, block: int) -> Column:
    """(first, end) word numbers of a document, at place `at` of its shard, that lie in chosen blocks."""
    blocks = F.when(size > 0, F.sequence(_div(at, F.lit(block)), _div(at + size - 1, F.lit(block)))).otherwise(F.array().cast("array<long>"))
    chosen = F.filter(blocks, lambda k: _chosen_to(k + 1) > _chosen_to(k))
    return F.transform(chosen, lambda k: F.struct(F.greatest(k * block - at, F.lit(0)).alias("first"), F.least((k + 1) * block - at, size).alias("end")))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, passes, ranges, taken of every row of (doc_id, text, source).

    Sources in order of code points, null last, have `weights` in turn and share
    `share` times all words. The mix takes a document `passes` times whole and then the
    words of `ranges` (array of first, end) once more, `taken` words in all.
    """
    # Equal rows meet before anything else; cut in groups of about a shard, they stay rows.
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = written(docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    sized = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows")).withColumn("none", F.col("source").isNull())
    given = numbered(sized, "number", "none", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = written(given.select("number", "source", F.col("words").alias("size"), "rows", weight.alias("weight")))
    total = sources.agg(F.sum("size")).first()[0] or 0
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0))
    split = F.greatest(F.lit(1), F.ceil(F.col("size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS))
    aimed = capped_shares(sources, share * total, most).withColumns({"passes": passes.cast("long"), "shards": split.cast("long")})
    aimed = written(aimed.withColumn("votes", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("size"))))

    # Seats of sources, then of their shards.
    every = F.lit(0).alias("all")
    # Targets add up to this total, so the blocks are counted from exact numbers.
    whole = aimed.agg(F.sum(F.col("passes") * F.col("size"))).first()[0] or 0
    seats = max(0, math.floor((min(share, most) * total - whole) / block + 0.5))
    blocks = docs.sparkSession.range(1).select(every, F.lit(seats).cast("long").alias("seats"))
    parties = aimed.select(every, F.col("number").alias("party"), "votes")
    quotas = sainte_lague(parties, "all", blocks).select(F.col("party").alias("number"), F.col("won").alias("seats"))
    small = _sized(aimed.select("number", "source", F.col("size").alias("source_size"), "target", "passes", "shards"))
    same = rows["source"].eqNullSafe(small["source"])
    known = rows.join(small, same).select(rows["doc_id"], rows["source"], rows["size"], "n", "number", "source_size", "target", "passes", "shards")
    step = F.greatest(F.lit(1), F.floor(F.lit(SHARD_WORDS // 16) / F.greatest(F.col("size"), F.lit(1)))).cast("long")
    dealt = known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step))).withColumn("n", F.least(step, F.col("n") - F.col("copy")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string")).cast("binary"))
    dealt = dealt.withColumn("key", key).withColumn("shard", F.conv(F.left("key", F.lit(12)), 16, 10).cast("long") % F.col("shards"))
    line = Window.partitionBy("number", "shard").orderBy("key", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    laid = written(dealt.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(line), F.lit(0))))
    shards = laid.groupBy("number", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("votes"))
    won = sainte_lague(shards.withColumnRenamed("shard", "party"), "number", quotas).withColumnRenamed("party", "shard")
    start = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), "number", "shard").cast("binary")), F.lit(8)), 16, 10).cast("long")
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("votes") / block)).cast("long")
    ready = won.select("number", "shard", blocks_of.alias("blocks"), start.alias("start"), "won").withColumns({"won": F.least("won", "blocks"), "start": F.col("start") % F.col("blocks")})

    # Copies of one row lie one after the other.
    single = laid.join(_sized(ready), ["number", "shard"]).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.col("before") + F.col("i") * F.col("size")
    taken = F.col("passes") * F.col("size") + _chosen_before(at + F.col("size"), block) - _chosen_before(at, block)
    drop_written(rows, sources)
    return single.select("doc_id", "source", "size", "source_size", "target", "passes", _ranges(at, F.col("size"), block).alias("ranges"), taken.cast("long").alias("taken"))


#: DuckDB SQL of `mix` with its defaults, for tables without equal rows: all quotients of all seats are listed.
SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY 1)),
o AS (SELECT *, sum(weight) OVER u AS open_weight, coalesce(sum(source_size) OVER f, 0) AS full_size FROM s WINDOW u AS (ORDER BY source_size / CAST(weight AS DOUBLE), number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), f AS (ORDER BY source_size / CAST(weight AS DOUBLE), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max(level) AS level FROM (SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - 2 * full_size) / open_weight AS level, weight, source_size FROM o) WHERE level * weight <= 2 * source_size),
t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes, greatest(1, ceil(source_size / {SHARD_WORDS}::DOUBLE), ceil(n / {SHARD_ROWS}::DOUBLE)) AS shards FROM (SELECT s.*, least(coalesce(level, 'inf'::DOUBLE) * weight, 2.0::DOUBLE * source_size) AS target FROM s, lv)),
v AS (SELECT *, greatest(0, target - passes * source_size) AS votes FROM t),
m AS (SELECT CAST(greatest(0, floor((1.5::DOUBLE * sum(source_size) - sum(passes * source_size)) / {BLOCK} + 0.5)) AS BIGINT) AS seats FROM v),
w1 AS (SELECT number, count(*) AS seats FROM (SELECT number FROM (SELECT number, votes / (2 * k - 1) AS q, k FROM v, m, range(1, seats + 1) r(k) WHERE votes > 0) ORDER BY q DESC, number, k LIMIT (SELECT seats FROM m)) GROUP BY 1),
k AS (SELECT d.*, source_size, target, passes, number, shards, md5('7:' || CAST(doc_id AS VARCHAR) || ':' || CAST(size AS VARCHAR) || ':0') AS key FROM d JOIN v ON v.source IS NOT DISTINCT FROM d.source),
p AS (SELECT *, CAST(CAST('0x' || left(key, 12) AS BIGINT) % shards AS BIGINT) AS shard FROM k),
l AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY number, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM p),
h AS (SELECT number, shard, CAST(sum(size) AS BIGINT) AS words FROM l GROUP BY ALL),
w2 AS (SELECT number, shard, count(*) AS won FROM (SELECT number, shard, seats, row_number() OVER (PARTITION BY number ORDER BY CAST(words AS DOUBLE) / (2 * k - 1) DESC, shard, k) AS place FROM h JOIN w1 USING (number), range(1, seats + 1) r(k) WHERE words > 0) WHERE place <= seats GROUP BY ALL),
b AS (SELECT number, shard, blocks, least(coalesce(won, 0), blocks) AS won, CAST('0x' || left(md5('7:' || CAST(number AS VARCHAR) || ':' || CAST(shard AS VARCHAR)), 8) AS BIGINT) % blocks AS start FROM (SELECT *, CAST(greatest(1, ceil(words / {BLOCK}::DOUBLE)) AS BIGINT) AS blocks FROM h) LEFT JOIN w2 USING (number, shard)),
c AS (SELECT *, unnest([before, before + size]) AS x, unnest([-1, 1]) AS sign FROM l JOIN b USING (number, shard)),
f AS (SELECT *, ((x // {BLOCK}) * won + start) // blocks AS done, ((x // {BLOCK} + 1) * won + start) // blocks AS next FROM c)
SELECT doc_id, size, source_size, target, CAST(passes * size + sum(sign * ({BLOCK} * done + x % {BLOCK} * (next - done))) AS BIGINT) AS taken FROM f GROUP BY doc_id, size, source_size, target, passes, number
"""
