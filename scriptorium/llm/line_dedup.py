"""Fuzzy line deduplication by MinHash.

A line, lower-cased and trimmed, is the set of its 8-character shingles (one shingle
if it is shorter). Equal lines are one class. A class has a one-permutation MinHash of 48
bins, empty bins filled from the next full one, in 12 bands of 4; lines that share a band
and have an exact Jaccard similarity of shingles of 0.75 or more are linked, and no pair
of lines that shares a band is left out: small buckets are paired, in larger ones each line
meets two of its members, and members that are then in different components are compared
block by block, first by sketches of their shingles, then exactly. Of every
connected component of lines the first occurrence, in order of doc_id and line number,
stays. Blank lines are no candidates and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _links, _spark
from ._arrays import SpanHash, bounded, distinct, list_column, mix, ragged

WIDTH, BANDS, ROWS = 8, 12, 4
BINS = BANDS * ROWS
#: Buckets of more lines are not paired at once; there each line meets so many members first.
SMALL, PIVOTS = 4, 2
_LINES = "doc_id long, tk long, line int, n1 long, n2 long, " + _links.PACKED


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of lower-cased texts, each followed by a line feed."""
    low = [t.lower() + "\n" for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


#: Symbols of the code points of the basic plane, by seed.
_SYMBOLS = {seed: mix(np.arange(1 << 16, dtype=np.uint64), seed) for seed in (1, 2)}


def _symbols(points: np.ndarray, seed: int) -> np.ndarray:
    """mix(points, seed), looked up where all code points are of the basic plane."""
    return _SYMBOLS[seed][points] if points.max(initial=0) < 1 << 16 else mix(points.astype(np.uint64), seed)


def line_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number) of each line that is not blank, without white space at its ends."""
    breaks = np.flatnonzero(points == 10)
    starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else np.zeros(0, np.int64)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    numbers = np.arange(len(rows)) - first[rows]
    full = np.flatnonzero(~((points <= 32) | (points == 0xA0) | (points == 0x3000)))
    lo, hi = np.searchsorted(full, starts), np.searchsorted(full, breaks)
    some = hi > lo
    return full[lo[some]], full[hi[some] - 1] + 1, rows[some], numbers[some]


def shingle_hashes(hasher: SpanHash, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each shingle of each line, in order."""
    counts = np.maximum(ends - starts - WIDTH + 1, 1)
    line = np.repeat(np.arange(len(starts)), counts)
    at = ragged(starts, counts)
    every = hasher.windows(WIDTH)
    short = np.flatnonzero(ends - starts < WIDTH)
    if len(short):
        every = np.append(every, np.zeros(WIDTH, np.uint64))
    values = every[at]
    if len(short):
        values[(np.cumsum(counts) - counts)[short]] = hasher(starts[short], ends[short])
    return line, values


def min_hashes(hasher: SpanHash, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 [lines, BINS]: least shingle hash of each bin, empty bins filled by rotation."""
    n = len(starts)
    line, values = shingle_hashes(hasher, starts, ends)
    table = np.full(n * BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    bins = (values >> np.uint64(40)).astype(np.uint32)
    bins -= bins // np.uint32(BINS) * np.uint32(BINS)
    line *= BINS
    line += bins
    np.minimum.at(table, line, values)
    table = table.reshape(n, BINS)
    empty = table == np.uint64(0xFFFFFFFFFFFFFFFF)
    distance = 1
    while distance < BINS and empty.any():
        moved, moved_empty = np.roll(table, -distance, 1), np.roll(empty, -distance, 1)
        fill = empty & ~moved_empty
        table[fill] = mix(moved[fill], distance)
        empty &= moved_empty
        distance *= 2
    return table


class _Lines:
    """Lines of a column of texts: row and number of each, two digests, the first of equal lines and the bands of those."""

    def __init__(self, column: pa.Array):
        points, offsets = _code_points([t or "" for t in column.to_pylist()])
        starts, ends, self.rows, self.numbers = line_spans(points, offsets)
        hasher = SpanHash(_symbols(points, 1))
        self.digest = np.stack([hasher(starts, ends, 21), SpanHash(_symbols(points, 2))(starts, ends, 22)], 1)
        self.first = np.sort(np.unique(self.digest[:, 0], return_index=True)[1])
        table = min_hashes(hasher, starts[self.first], ends[self.first]).reshape(-1, BANDS, ROWS)
        bands = np.zeros(table.shape[:2], np.uint64)
        for i in range(ROWS):
            bands = mix(bands ^ table[:, :, i], i)
        self.bands = mix(bands ^ np.arange(BANDS, dtype=np.uint64), 9)


def line_classes(docs: DataFrame) -> DataFrame:
    """doc_id, line, node (digest), bands (of the first of equal lines in a batch, else empty) of each line that is not blank."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 400_000):
            x = _Lines(batch.column("text"))
            sizes = np.zeros(len(x.rows), np.int64)
            sizes[x.first] = BANDS
            lists = list_column(x.bands.ravel().view(np.int64), np.concatenate(([0], np.cumsum(sizes))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(x.rows)), pa.array(x.numbers, pa.int32()), pa.array(x.digest[:, 0].copy().view(np.int64)), lists], names=["doc_id", "line", "node", "bands"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, line int, node long, bands array<long>")


def _signed_lines(docs: DataFrame, parts: int, held: int = 400_000) -> DataFrame:
    """From (doc_id, tk, text) in one scan: a row for each line that is not blank, part null, and PACKED rows of the bands of distinct lines."""
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("line", pa.int32()), ("n1", pa.int64()), ("n2", pa.int64()), ("part", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("sigs", pa.binary())])

    def rows(own: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sigs, total = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for x in _links.packed_rows(np.concatenate(nodes), np.concatenate(sigs), parts):
                yield rows(dict(zip(x.schema.names, x.columns, strict=True)), x.num_rows)

        for batch in bounded(batches, "text", 400_000):
            x = _Lines(batch.column("text"))
            if not len(x.rows):
                continue
            at = pa.array(x.rows)
            whole = {"doc_id": batch.column("doc_id").take(at), "tk": batch.column("tk").take(at), "line": pa.array(x.numbers, pa.int32()), "n1": pa.array(x.digest[:, 0].copy().view(np.int64)), "n2": pa.array(x.digest[:, 1].copy().view(np.int64))}
            for i in range(0, len(x.rows), 50_000):
                yield rows({k: v.slice(i, 50_000) for k, v in whole.items()}, min(50_000, len(x.rows) - i))
            nodes.append(np.repeat(x.digest[x.first, 0], BANDS))
            sigs.append(x.bands.ravel())
            total += len(sigs[-1])
            if total >= held:
                yield from flush()
                nodes, sigs, total = [], [], 0
        if total:
            yield from flush()

    return docs.select("doc_id", "tk", "text").mapInArrow(signed, _LINES)


#: White space at the ends of a line, as `line_spans` leaves it out.
_BLANK = "".join(map(chr, range(33))) + "\xa0\u3000"


def line_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame, most: int = 1_000_000) -> DataFrame:
    """node, words, size, sketch (of the shingles) of `nodes` (node), written; `classes` (node, at) has the place of one line of each class.

    A line is taken only if its digest is the node, so rows that repeat a doc_id cannot
    give another text. At most `most` lines in all are broadcast to the scan.
    """
    places = classes.select("node", "at").join(nodes, "node").select("node", F.expr("(at - pmod(at, 2147483648)) div 2147483648").alias("doc_id"), F.expr("pmod(at, 2147483648)").cast("int").alias("line"))
    # All lines wanted of a document in one row: bounded by its text.
    wanted = _spark.written(places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "node")).alias("wanted")))
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= most

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 400_000):
            words, node = [], []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                some = [x for x in asked if x["line"] < len(lines)]
                words += [lines[x["line"]].lower().strip(_BLANK) for x in some]
                node += [x["node"] for x in some]
            # Only the lines asked for are hashed, side by side.
            edges = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
            starts, ends = edges[:-1], edges[1:]
            node = np.array(node, np.int64)
            hasher = SpanHash(_symbols(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), 1))
            right = np.flatnonzero((hasher(starts, ends, 21).view(np.int64) == node) & (ends > starts))
            starts, ends, node, words = starts[right], ends[right], node[right], [words[i] for i in right.tolist()]
            for i in range(0, len(node), 1 << 19):
                some = slice(i, i + (1 << 19))
                line, values = shingle_hashes(hasher, starts[some], ends[some])
                # A line's number and 44 bits of a shingle's hash in one key: one sort tells shingles of a line apart.
                keys = distinct((line.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
                bounds = np.concatenate(([0], np.cumsum(np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=len(node[some])))))
                drawn = _links.sketches(keys & np.uint64((1 << 44) - 1), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(node[some], pa.int64()), pa.array(words[some], pa.string()), pa.array(np.diff(bounds)), pa.array(drawn, pa.binary())], names=["node", "words", "size", "sketch"])

    joined = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id")
    return _spark.written(joined.select("text", "wanted").mapInArrow(taken, "node long, words string, size long, sketch binary").dropDuplicates(["node"]))


class _Same:
    """Whether two lines have a Jaccard similarity of shingles of `threshold`; shingle sets of 400 000 characters, or of one longer line, are kept.

    The first 255 different characters that come have a byte each, so a shingle of them is
    one number of 8 bytes and the numbers of a line are compared as they are, exactly.
    Lines with other characters are compared by sets of strings.
    """

    def __init__(self, threshold: float):
        self.threshold, self.made, self.chars = threshold, {}, 0
        self.codes, self.known = None, 0

    def _bytes(self, text: str) -> np.ndarray | None:
        """A byte for each character; None where there are too many different ones."""
        if self.codes is None:  # not before, so that a task is sent without it
            self.codes = np.zeros(0x110000, np.uint8)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        coded = self.codes[points]
        if not coded.all():
            new = np.unique(points[coded == 0])[: 255 - self.known]
            self.codes[new] = np.arange(self.known + 1, self.known + len(new) + 1)
            self.known += len(new)
            coded = self.codes[points]
        return coded if coded.all() else None

    def _grams(self, text: str) -> np.ndarray | None:
        """The distinct shingles of a line of at least a shingle, in order; None where there are too many different characters."""
        if text in self.made:
            return self.made[text]
        if self.chars > 400_000:
            self.made.clear()
            self.chars = 0
        if (found := self._bytes(text)) is not None:
            found = distinct(np.ndarray(len(found) - WIDTH + 1, np.uint64, found.tobytes(), 0, (1,)))
        self.made[text] = found
        self.chars += len(text)
        return found

    def __call__(self, x: str, y: str) -> bool:
        if min(len(x), len(y)) < WIDTH:  # one shingle, shorter than any other line's
            return x == y
        one, two = self._grams(x), self._grams(y)
        if one is None or two is None:
            one, two = ({t[i : i + WIDTH] for i in range(len(t) - WIDTH + 1)} for t in (x, y))
        if min(len(one), len(two)) < self.threshold * max(len(one), len(two)):
            return False
        if isinstance(one, set):
            both = len(one & two)
        else:
            merged = np.sort(np.concatenate((one, two)))
            both = int(np.count_nonzero(merged[1:] == merged[:-1]))
        return both > 0 and both >= self.threshold * (len(one) + len(two) - both)


def similar_lines(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) of nodes whose `line_texts` have a Jaccard similarity of 0.75; sizes and sketches rule out most others first."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = _Same(0.75)
        for batch in batches:
            keep = []
            for na, nb, sa, sb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb", "x", "y")), strict=True):
                width = min(len(sa), len(sb))
                differ = int.from_bytes(_links.folded(sa, width).tobytes()) ^ int.from_bytes(_links.folded(sb, width).tobytes()) if len(sa) != len(sb) else int.from_bytes(sa) ^ int.from_bytes(sb)
                keep.append(7 * differ.bit_count() <= na + nb and same(x, y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda d, n, s, t: texts.select(F.col("node").alias(d), F.col("size").alias(n), F.col("sketch").alias(s), F.col("words").alias(t))
    both = pairs.join(side("a", "na", "sa", "x"), "a").join(side("b", "nb", "sb", "y"), "b")
    fit = F.least("na", "nb") * 4 >= F.greatest("na", "nb") * 3
    return both.filter(fit).select("a", "b", "na", "nb", "sa", "sb", "x", "y").mapInArrow(compared, "a long, b long")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tk, lines (numbers from 0, sorted) of every text with lines to remove, from (doc_id, tk, text); tk tells texts of one doc_id apart.

    A null text and blank lines have nothing to remove; doc_id must not be null. Lines
    at the same number of rows that repeat a doc_id are one place. Should two different
    lines have one 64-bit digest, which a second one tells, both stay.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = _spark.written(_signed_lines(docs, parts))
    lines = table.filter("part IS NULL").select("doc_id", "tk", "line", F.col("n1").alias("node"), "n2")
    # doc_id and line as one number: its minimum is taken by hash aggregation.
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")).cast("decimal(38,0)")
    found = lines.groupBy("node").agg(F.min(place).alias("at"), F.count("*").alias("n"), F.min("n2").alias("lo"), F.max("n2").alias("hi"))
    classes = _spark.written(found.filter("lo = hi").select("node", "at", "n"))
    packed = table.filter("part IS NOT NULL").select("part", "nodes", "counts", "sigs")
    met = _spark.written(_links.met(packed, parts, SMALL, PIVOTS), free=True)

    pairs = _spark.written(met.filter("g IS NULL").select("a", "b").distinct())
    texts = line_texts(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = _spark.written(similar_lines(texts, pairs), free=True)
    _spark.drop_written(texts)
    groups = _spark.written(met.filter("g IS NOT NULL").select("g", F.col("a").alias("node")).distinct())
    _spark.drop_written(met)
    roots = _spark.written(_links.components(links))
    if not groups.isEmpty():
        mixed = _links.mixed_members(groups, roots)
        texts = line_texts(docs, classes, mixed.select("node").distinct())
        more = _spark.written(_links.crossing_pairs(mixed, texts, _Same(0.75)), free=True)
        _spark.drop_written(mixed, texts)
        if not more.isEmpty():
            roots = _spark.written(_links.joined_components(roots, more))
    _spark.drop_written(groups, pairs)
    rooted = classes.join(roots, "node", "left")
    # Classes that stand alone keep their one line; the others meet the first line of their component.
    keep = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("at").alias("keep"))
    many = rooted.filter("root IS NOT NULL OR n > 1").join(keep, "root", "left").select("node", F.coalesce("keep", "at").alias("keep"))
    gone = lines.join(many, "node").filter(place != F.col("keep"))
    return gone.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, broadcast_lines: int = 2_000_000) -> DataFrame:
    """The rows of `docs` with all columns, `text` without its repeated lines, and n_lines, n_removed.

    Null and empty texts have no line to remove and stay as they are; rows with a null
    doc_id are kept unchanged; rows that repeat a doc_id with one text lose the same lines,
    with different texts each its own; an empty table gives no rows. Columns named n_lines
    or n_removed are replaced; no other name can clash. A text whose lines all go becomes
    empty. At most `broadcast_lines` line numbers are broadcast.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for lines in batch.column("lines"):
                mask = np.zeros(lines[-1].as_py() + 1, bool)
                mask[lines.values.to_numpy(zero_copy_only=False)] = True
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(masks, pa.list_(pa.bool_())), pa.array([int(m.sum()) for m in masks], pa.int64())], names=["doc_id", "tk", "mask", "gone"])

    gone = _spark.written(removed_lines(rows.filter("doc_id IS NOT NULL").select("doc_id", "tk", "text")).mapInArrow(masked, "doc_id long, tk long, mask array<boolean>, gone long"), free=True)
    few = (gone.agg(F.sum(F.size("mask") + 4)).first()[0] or 0) <= broadcast_lines
    joined = rows.join(F.broadcast(gone) if few else gone, ["doc_id", "tk"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get("mask", i), F.lit(False))), "\n")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return joined.select(*[F.col("row").getField(c).alias(c) if c != "text" else F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text") for c in docs.columns if c not in ("n_lines", "n_removed")], (F.coalesce(breaks, F.lit(0)) + 1).cast("long").alias("n_lines"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"))
