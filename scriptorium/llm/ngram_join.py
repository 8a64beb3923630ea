"""N-gram Jaccard join by PartEnum signatures.

A document is the set of hashes of its 5-word shingles; equal sets are one class. Sets are
put into size bands, and a pair of similarity 3/4 or more lies in one band or across the
boundary of two neighbouring ones. For its band, and for each boundary that a partner of it
could lie across, a set emits signatures of parts of the feature domain. Two such sets differ
in at most k features, k being 2/7 of the largest size of a band or of the mean of the two
largest sizes at a boundary:

- k <= 3: the domain is cut into k + 3 parts, of which at most k differ, and every
  subset of 3 parts is a signature;
- larger k: the domain is cut into k + 1 + t parts of which at least t + 1 agree, and
  every part is a signature.

A part without features says nothing. A set with at most t such parts leaves them out
and keeps one that agrees; a set with more emits signatures of a fresh partition too,
as does any set it could match there, and only the last of four partitions keeps empty
parts. Features found in several sampled documents are left out of the first partition,
which cannot raise the distance. So similar sets always share a signature.

Signatures travel as packed arrays, dealt by a range of their hash. Sets that share one are
paired in small buckets; in a large bucket each is paired with a few members, and members that
are then still in different components are compared block by block. A pair goes to the exact
check of its whole texts, there or after a join, only if sizes and sketches allow it: a sketch holds the parity of
the features at each of its bits, so that differing bits cannot outnumber differing features.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _links, _spark
from ._arrays import SpanHash, bounded, mix, ragged, spans, text_buffer

WIDTH, TIERS, SLACK = 5, 4, 0.3
#: Buckets of more sets are not paired at once; there each set meets so many members first.
SMALL, PIVOTS = 4, 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HOT_BITS = 22


def _tops() -> np.ndarray:
    """Largest sizes of the bands; each is at least 4/3 of the one before."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * 17 // 10))
    return np.array(tops)


_TOPS = _tops()


def feature_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets): the sorted distinct shingle hashes of each text; of fewer than 5 words, one hash of them all; none without words."""
    data, offsets = text_buffer(column)
    data = _LOWER[data]
    starts, ends, rows = spans(~_SPACE[data], offsets)
    words = SpanHash.of_bytes(data)(starts, ends)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    n_words = np.diff(first)
    counts = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    at = ragged(first[:-1], counts)
    row = np.repeat(np.arange(len(counts)), counts)
    found = SpanHash(words)(at, at + np.minimum(WIDTH, n_words)[row])
    bounds = np.concatenate(([0], np.cumsum(counts)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(counts)))))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sets of `feature_sets`, one array each."""
    features, offsets = feature_sets(column)
    return np.split(features, offsets[1:-1])


def digests(features: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit digest of each set: the sum of its mixed features."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(features, seed))))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def hot_table(hot: np.ndarray) -> np.ndarray:
    """Marks of the leading bits of frequent features; a feature that shares them with one counts as frequent too."""
    table = np.zeros(1 << _HOT_BITS, bool)
    table[(hot >> np.uint64(64 - _HOT_BITS)).astype(np.int64)] = True
    return table


def set_signatures(features: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of all sets under their band and boundaries; `hot` is a `hot_table`."""
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    band = np.searchsorted(_TOPS, sizes)
    top, below = _TOPS[band], np.where(band > 0, _TOPS[band - 1], 0)
    cool = ~hot[(features >> np.uint64(64 - _HOT_BITS)).astype(np.int64)] if hot is not None else np.ones(len(features), bool)
    out_rows, out = [], []
    for label, k, who in (
        (2 * band, 2 * top // 7, sizes > 0),
        (2 * band + 1, (top + 4 * top // 3) // 7, (sizes > 0) & (4 * sizes >= 3 * (top + 1))),
        (2 * band - 1, (below + 4 * below // 3) // 7, (sizes > 0) & (3 * sizes <= 4 * below)),
    ):
        slack = np.where(k <= 3, 0, np.ceil(SLACK * (k + 1)).astype(np.int64))
        parts = np.where(k <= 3, k + 3, k + 1 + slack)
        active = who
        for tier in range(TIERS):
            if not active.any():
                break
            used = active[rows] & cool if tier == 0 else active[rows]
            row, f = rows[used], features[used]
            base = np.concatenate(([0], np.cumsum(np.where(active, parts, 0))))
            part = ((mix(f, 2 * tier + 1) >> np.uint64(32)) * parts[row].astype(np.uint64)) >> np.uint64(32)
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, base[row] + part.astype(np.int64), mix(f, 2 * tier + 2))
            silent = np.zeros(len(sizes), np.int64)

            def emit(of: np.ndarray, place: np.ndarray, content: np.ndarray, says: np.ndarray) -> None:
                silent[:] += np.bincount(of[~says], minlength=len(sizes))
                keep = says if tier < TIERS - 1 else np.ones(len(says), bool)
                tag = (label[of[keep]].astype(np.uint64) * np.uint64(TIERS) + np.uint64(tier) << np.uint64(40)) | place[keep].astype(np.uint64)
                out_rows.append(of[keep])
                out.append(mix(content[keep] ^ mix(tag)))

            wide = np.flatnonzero(active & (k > 3))
            if len(wide):
                cells = ragged(base[wide], parts[wide])
                of = np.repeat(wide, parts[wide])
                emit(of, cells - base[of], sums[cells], sums[cells] != 0)
            for few in range(4):
                if len(some := np.flatnonzero(active & (k == few))):
                    subsets = np.array(list(combinations(range(few + 3), 3)))
                    cells = sums[base[some][:, None] + np.arange(few + 3)]
                    content = mix(cells)[:, subsets].sum(2, dtype=np.uint64)
                    emit(np.repeat(some, len(subsets)), np.tile(np.arange(len(subsets)), len(some)), content.ravel(), (cells != 0)[:, subsets].any(2).ravel())
            active = active & (silent > slack)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out)


def signatures(features: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """The signatures of one set; `hot` are frequent features."""
    return set_signatures(features, np.array([0, len(features)]), None if hot is None else hot_table(hot))[1]


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set; null if it is empty), sketch."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 500_000):
            features, offsets = feature_sets(batch.column("text"))
            sizes = np.diff(offsets)
            digest = [pa.array(digests(features, offsets, seed).view(np.int64), mask=sizes == 0) for seed in (11, 12)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *digest, pa.array(_links.sketches(features, offsets), pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return docs.mapInArrow(measured, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary")


def frequent_features(docs: DataFrame, sample_rows: int, least: int) -> np.ndarray:
    """The `hot_table` of features of `least` or more of `sample_rows` documents, chosen by a hash of doc_id.

    A guess here costs time, never links. The table has a fixed size.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 500_000):
            found, counts = np.unique(feature_sets(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["feature", "n"])

    prefix = F.shiftrightunsigned("feature", 64 - _HOT_BITS).alias("prefix")
    often = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(exploded, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    table = np.zeros(1 << _HOT_BITS, bool)
    table[[r["prefix"] for r in often.select(prefix).distinct().collect()]] = True
    return table


def _packed_signatures(docs: DataFrame, hot: np.ndarray, parts: int, held: int = 500_000) -> DataFrame:
    """PACKED signatures of the distinct sets of a task in packed arrays, `held` at once; a node is the digest d1."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        seen: set[bytes] = set()  # 16 bytes a distinct set of this task
        nodes, sigs, total = [], [], 0
        for batch in bounded(batches, "text", 500_000):
            features, offsets = feature_sets(batch.column("text"))
            both = np.stack([digests(features, offsets, seed) for seed in (11, 12)], 1)
            keys = [x.tobytes() for x in both]
            fresh = []
            for i, key in enumerate(keys):
                if key not in seen and offsets[i + 1] - offsets[i] > 2:  # only equal sets are similar to smaller ones
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            sizes = np.diff(offsets)[fresh]
            row, sig = set_signatures(features[ragged(offsets[fresh], sizes)], np.concatenate(([0], np.cumsum(sizes))), table)
            nodes.append(both[fresh, 0][row])
            sigs.append(sig)
            total += len(sig)
            if total >= held:
                yield from _links.packed_rows(np.concatenate(nodes), np.concatenate(sigs), parts)
                nodes, sigs, total = [], [], 0
        if total:
            yield from _links.packed_rows(np.concatenate(nodes), np.concatenate(sigs), parts)

    return docs.select("text").mapInArrow(signed, _links.PACKED)


def plausible_pairs(pairs: DataFrame) -> DataFrame:
    """Of `pairs` (a, b, na, nb, sa, sb; sizes and sketches) those (a, b) whose sizes and sketches allow a similarity of 3/4."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                size = min(len(sa), len(sb))
                differ = int(np.bitwise_count(_links.folded(sa, size) ^ _links.folded(sb, size)).sum())
                keep.append(7 * differ <= na + nb)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fit = F.least("na", "nb") * 4 >= F.greatest("na", "nb") * 3
    return pairs.filter(fit).mapInArrow(tested, "a long, b long")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, packed: the compressed whole texts of `ids` (doc_id), written."""

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in bounded(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "packed"])

    return _spark.written(_links.by_ids(docs.select("doc_id", "text"), ids).mapInArrow(compressed, "doc_id long, packed binary"))


class _Same:
    """Whether 100 * intersection >= 75 * union for two packed texts; sets of 500 000 features, or of one larger text, are kept."""

    def __init__(self) -> None:
        self.made: dict[bytes, set[int]] = {}
        self.kept = 0

    def features(self, packed: bytes) -> set[int]:
        if (found := self.made.get(packed)) is None:
            if self.kept > 500_000:
                self.made.clear()
                self.kept = 0
            text = zstandard.ZstdDecompressor().decompress(packed).decode()
            found = self.made[packed] = set(feature_sets(pa.array([text]))[0].tolist())
            self.kept += len(found)
        return found

    def __call__(self, x: bytes, y: bytes) -> bool:
        one, two = self.features(x), self.features(y)
        common = len(one & two)
        return common > 0 and 100 * common >= 75 * (len(one) + len(two) - common)


def similar_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) with 100 * intersection >= 75 * union; whole texts travel compressed."""
    pairs = _spark.written(pairs)
    texts = packed_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = _Same()
        for batch in batches:
            keep = [same(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(compared, "a long, b long").distinct()


def similar_links(docs: DataFrame, classes: DataFrame, sample_rows: int = 8000, hot_count: int = 2) -> DataFrame:
    """Links (a, b) that connect the similar ones of `classes` (class_id, n_shingles, d1, sketch); see the module."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _spark.written(_links.met(_packed_signatures(docs, frequent_features(docs, sample_rows, hot_count), parts), parts, SMALL, PIVOTS), free=True)
    side = lambda x, d: classes.select(F.col("d1").alias(d), F.col("class_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    nodes = met.filter("g IS NULL").select(F.col("a").alias("da"), F.col("b").alias("db")).distinct()
    pairs = nodes.join(side("x", "da"), "da").join(side("y", "db"), "db")
    swap = F.col("x") <= F.col("y")
    pick = lambda one, two, name: F.when(swap, F.col(one)).otherwise(F.col(two)).alias(name)
    pairs = pairs.filter("x <> y").select(pick("x", "y", "a"), pick("y", "x", "b"), pick("nx", "ny", "na"), pick("ny", "nx", "nb"), pick("sx", "sy", "sa"), pick("sy", "sx", "sb"))
    tried = _spark.written(plausible_pairs(pairs).distinct(), free=True)
    links = _spark.settled(lambda: similar_pairs(docs, tried).select("a", "b"))
    groups = _spark.written(met.filter("g IS NOT NULL").select("g", F.col("a").alias("d1")).distinct().join(classes.select("d1", F.col("class_id").alias("node")), "d1").select("g", "node").distinct())
    _spark.drop_written(met)
    if not groups.isEmpty():
        mixed = _links.mixed_members(groups, _links.components(links))
        texts = packed_texts(docs, mixed.select(F.col("node").alias("doc_id")).distinct())
        known = classes.select(F.col("class_id").alias("node"), F.col("n_shingles").alias("size"), "sketch").join(texts.select(F.col("doc_id").alias("node"), F.col("packed").alias("words")), "node").distinct()
        more = _spark.written(_links.crossing_pairs(mixed, known, _Same()), free=True)
        links = links.unionByName(more)
        _spark.drop_written(mixed, texts)
    _spark.drop_written(groups, tried)
    return links


def near_duplicates(docs: DataFrame, sample_rows: int = 8000, hot_count: int = 2) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id (smallest reachable).

    Null, empty and blank texts have an empty set, class and component their own id;
    rows with a null doc_id are kept with null class and component and link with
    nothing; rows that repeat a doc_id are one node, linked through any of their texts;
    an empty table gives no rows. Only doc_id and text are read, texts whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.filter("doc_id IS NOT NULL")
    sets = _spark.written(document_sets(docs))
    firsts = sets.filter("d1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    of_class = _spark.written(sets.join(firsts, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), "d1", F.when(F.col("class_id") == F.col("doc_id"), F.col("sketch")).alias("sketch")), free=True)
    _spark.drop_written(sets)
    classes = of_class.filter("sketch IS NOT NULL").select("class_id", "n_shingles", "d1", "sketch")
    links = similar_links(named, classes, sample_rows, hot_count)
    # A doc_id with several texts links their classes.
    several = of_class.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("hi")).filter("a <> hi").select("doc_id", "a")
    own = of_class.select("doc_id", F.col("class_id").alias("b")).join(several, "doc_id").filter("a <> b").select("a", "b")
    roots = _links.components(links.unionByName(own))
    return of_class.join(roots, of_class["class_id"] == roots["node"], "left").select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose document is the smallest doc_id of its component, with their columns.

    Rows without an id or without words are in no component and stay; all rows of an id
    that stays stay; an empty table gives no rows.
    """
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: The same result by comparing all pairs that share a shingle, for DuckDB.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM r JOIN both_ways b ON b.a = r.root)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

CLASS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST(doc_id AS VARCHAR) WHEN len(ws) < 5 THEN ' ' || array_to_string(ws, ' ')
  ELSE ' ' || array_to_string(list_sort(list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))), chr(10)) END AS key FROM w)
SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS class_id FROM k
"""
