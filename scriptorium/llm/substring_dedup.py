"""Removal of long repeated byte strings over a whole corpus.

Every string of `length` bytes has one anchor, the least hash among its 32-byte
grams (the leftmost of equals), and neighbouring strings with the same anchor form a
run. Runs with equal bytes around equal anchors are one class, found by one shuffle
of hashes; all but the first run of a class are repeats as a whole. Strings that
several classes of one anchor share are found by a run-length index of the classes'
bytes: their Burrows-Wheeler order to the depth of `length`, cut into runs of equal
matching statistics, whose first row is sampled: the earliest occurrence. Every
further row of a run that matches `length` bytes marks a repeat. Since equal strings
have equal anchors, indexes of different anchors need never meet, and any number of
tasks can build theirs apart. The README says where this leaves the named method.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _spark
from ._arrays import SpanHash, bounded, list_column, mix, text_buffer

GRAM = 32
_PLACE = np.uint64((1 << 28) - 1)


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor place, anchor hash, class hash) of each run; places count from the start of the buffer."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n > int(_PLACE):
        raise ValueError("a text of more than 256 MB has to be cut before its repeats are looked for")
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = SpanHash.of_bytes(data)
    at = np.arange(n - GRAM + 1)
    grams = hasher(at, at + GRAM)
    low = (grams & ~_PLACE) | at.astype(np.uint64)
    have, width = 1, length - GRAM + 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(low)) + length <= ends[: len(low)])
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (low[starts] & _PLACE).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(fresh)
    first, last, place = starts[head], starts[np.append(head[1:], len(starts)) - 1], anchor[head]
    second = SpanHash(mix(data.astype(np.uint64), 3))
    kind = mix(second(first, last + length, 5) ^ mix((place - first).astype(np.uint64)))
    return np.searchsorted(offsets, first, side="right") - 1, first, last, place, grams[place], kind


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of the union of spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[head], reach[np.append(head[1:], len(starts)) - 1]


class RunLengthIndex:
    """Order of all strings of `length` bytes within byte segments, equal ones by segment order, run-compressed.

    `segments` are concatenated; ranks of strings of 8, 16, 32, 64 and `length` bytes
    come from each other by pairs. Rows of the order with equal ranks form a run; the
    row where a run begins is sampled and gives its earliest place.
    """

    def __init__(self, text: np.ndarray, offsets: np.ndarray, length: int):
        n = len(text)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        eight = np.zeros(n, np.uint64)
        for i in range(8):
            byte = np.zeros(n, np.uint64)
            byte[: n - i] = text[i:]
            eight = (eight << np.uint64(8)) | np.where(np.arange(n) + i < ends, byte, 0).astype(np.uint64)
        rank, depth = np.unique(eight, return_inverse=True)[1].astype(np.int64), 8
        while depth < length:
            step = min(depth, length - depth)
            shifted = np.full(n, -1)
            shifted[: n - step] = rank[step:]
            shifted[np.arange(n) + step >= ends] = -1
            rank = np.unique((rank << np.int64(32)) + shifted + 1, return_inverse=True)[1].astype(np.int64)
            depth += step
        places = np.flatnonzero(np.arange(n) + length <= ends)
        self.order = places[np.argsort(rank[places], kind="stable")]
        ranks = rank[self.order]
        self.run_heads = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))[: len(ranks)]
        self.samples = self.order[self.run_heads]

    def repeats(self) -> np.ndarray:
        """Places whose string also occurs at an earlier place."""
        later = np.ones(len(self.order), bool)
        later[self.run_heads] = False
        return self.order[later]


_RUNS = "anchor long, kind long, doc_id long, start int, bytes int"


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """One row a run: of equal ones in a batch only the first; the others come merged, with a null kind and any anchor."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 2_000_000):
            data, offsets = text_buffer(batch.column("text"))
            row, first, last, _, anchor, kind = anchored_runs(data, offsets, length)
            if not len(row):
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((first - offsets[row], ids, kind, anchor))
            again = np.zeros(len(row), bool)
            again[order[1:]] = (kind[order[1:]] == kind[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
            start, size = (first - offsets[row]).astype(np.int32), (last - first + length).astype(np.int32)
            one = ~again
            s, e = merged(first[again], last[again] + length)
            # Spans of neighbouring texts can touch: cut them at text ends.
            cuts = offsets[np.searchsorted(offsets, s, side="right")]
            while len(s) and (e > cuts).any():
                over = e > cuts
                s, e, cuts = np.concatenate((s, cuts[over])), np.concatenate((np.minimum(e, cuts), e[over])), None
                cuts = offsets[np.searchsorted(offsets, s, side="right")]
            r = np.searchsorted(offsets, s, side="right") - 1
            whole_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[r]
            blank = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(anchor[one].view(np.int64)), pa.array(mix(whole_ids.astype(np.uint64)).view(np.int64))]),
                    pa.concat_arrays([pa.array(kind[one].view(np.int64)), blank]),
                    pa.array(np.concatenate((ids[one], whole_ids)), pa.int64()),
                    pa.array(np.concatenate((start[one], s - offsets[r])).astype(np.int32)),
                    pa.array(np.concatenate((size[one], e - s)).astype(np.int32)),
                ],
                names=["anchor", "kind", "doc_id", "start", "bytes"],
            )

    return docs.mapInArrow(found, _RUNS)


def _shared_strings(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """doc_id, start, bytes of strings that occur earlier in another class of the same anchor."""
    wanted = _spark.written(classes.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "bytes")).alias("wanted")))
    with_text = docs.join(wanted.hint("merge"), "doc_id")  # grows with the corpus at every size

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            out = []
            for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                out += [(x["anchor"], doc_id, x["start"], data[x["start"] : x["start"] + x["bytes"]]) for x in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "doc_id", "start", "data"])

    def indexed(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda x: (x[1], x[2]))
        offsets = np.concatenate(([0], np.cumsum([len(x[3]) for x in rows]))).astype(np.int64)
        places = np.sort(RunLengthIndex(np.frombuffer(b"".join(x[3] for x in rows), np.uint8), offsets, length).repeats())
        row = np.searchsorted(offsets, places, side="right") - 1
        fresh = np.ones(len(places), bool)
        fresh[1:] = (places[1:] != places[:-1] + 1) | (row[1:] != row[:-1])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(places))[: len(head)] - 1
        ids, begins = np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64)
        start = begins[row[head]] + places[head] - offsets[row[head]]
        return pa.RecordBatch.from_arrays([pa.array(ids[row[head]]), pa.array(start.astype(np.int32)), pa.array((places[tail] - places[head] + length).astype(np.int32))], names=["doc_id", "start", "bytes"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "data")), strict=True):
                if row[0] != current and size > 1_000_000:
                    yield indexed(held)
                    held, size = [], 0
                current = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield indexed(held)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_text.select("doc_id", "text", "wanted").mapInArrow(taken, "anchor long, doc_id long, start int, data binary").repartition(partitions, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(marked, "doc_id long, start int, bytes int")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, spans (array of start, bytes; not merged) of every document with bytes to remove.

    Ids must not be null or repeat; texts must not be null; an empty table gives no rows.
    """
    runs = _runs(docs, length)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(partitions, "anchor")
    by_kind = Window.partitionBy("anchor").orderBy("kind", "doc_id", "start")
    ranked = dealt.select("*", F.lag("kind").over(by_kind).alias("before"), F.lead("kind").over(by_kind).alias("after"))
    # A run is a repeat if the one before it is of its class; a class has company if its anchor has another.
    state = F.when(F.col("kind").isNull() | (F.col("kind") == F.col("before")), F.lit(0)).when(F.col("before").isNotNull() | (F.col("after") != F.col("kind")), F.lit(1)).otherwise(F.lit(2))
    kept = ranked.select("anchor", "kind", "doc_id", "start", "bytes", state.alias("state"), F.col("after").isNotNull().alias("more")).filter("state < 2 OR more")
    table = _spark.written(kept)
    # The first class of an anchor is followed by its own repeats: it has company if any other class begins.
    others = table.filter("state = 1").select("anchor").distinct()
    classes = table.filter("state = 1").select("anchor", "doc_id", "start", "bytes").unionByName(table.filter("state = 2").join(others, "anchor", "left_semi").select("anchor", "doc_id", "start", "bytes"))
    shared = _shared_strings(docs, classes, length)
    marks = table.filter("state = 0").select("doc_id", "start", "bytes").unionByName(shared)
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "bytes")).alias("spans"))


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own) where ids repeat: rows in order of id and text get numbers of their own as doc_id, written once."""
    keyed = docs.withColumn("tk", F.xxhash64("text"))
    rows = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "tk").orderBy("text")))
    key = ["doc_id", "tk", "nth"]
    order = _spark.written(rows.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).withColumn("number", F.monotonically_increasing_id()))
    return _spark.written(rows.join(order, key).select(F.col("number").alias("doc_id"), "text", F.col("doc_id").alias("own")))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans (start, bytes of each maximal removed run).

    Null counts as empty; texts shorter than `length` bytes lose nothing; rows with a
    null doc_id are returned whole; of rows that repeat a doc_id each is a document, in
    order of a hash of their texts, so that one of equal rows keeps its text; an
    empty table gives no rows. Only doc_id and text are read. Texts are read whole, up
    to 256 MB each; a longer one is an error.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.filter("doc_id IS NOT NULL")
    if not named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        numbered = _numbered(named)
        cut = _removed(numbered.select("doc_id", "text"), length).withColumnRenamed("doc_id", "number")
        own = cut.join(numbered.select(F.col("doc_id").alias("number"), F.col("own").alias("doc_id")), "number").drop("number")
        return own.select("doc_id", "n_bytes", "kept", "spans").unionByName(_removed(docs.filter("doc_id IS NULL"), length))
    return _removed(docs, length)


def _removed(docs: DataFrame, length: int) -> DataFrame:
    """`remove_repeats` of (doc_id, text) where no doc_id repeats."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = []
            for spans in batch.column("spans"):
                x = spans.values
                start, size = x.field("start").to_numpy().astype(np.int64), x.field("bytes").to_numpy().astype(np.int64)
                flat.append(merged(start, start + size))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s, _ in flat])))
            starts, ends = (np.concatenate([x[i] for x in flat]) if flat else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_column(starts, offsets, pa.int64()), list_column(ends, offsets, pa.int64())], names=["doc_id", "starts", "ends"])

    spans = _spark.written(repeated_spans(docs.filter("doc_id IS NOT NULL"), length).mapInArrow(joined, "doc_id long, starts array<long>, ends array<long>"))
    few = spans.agg(F.coalesce(F.sum(F.size("starts") + 2), F.lit(0))).first()[0] <= 1_000_000
    both = docs.join(F.broadcast(spans) if few else spans, "doc_id", "left").select("doc_id", "text", "starts", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            kept, sizes = [], []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                sizes.append(len(data))
                edges = [0, *(x for pair in zip(starts or [], ends or [], strict=True) for x in pair), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), batch.column("starts"), batch.column("ends")], names=["doc_id", "n_bytes", "kept", "starts", "ends"])

    none = F.array().cast("array<long>")
    out = both.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")
    pairs = F.arrays_zip(F.coalesce("starts", none).alias("start"), F.coalesce("ends", none).alias("end"))
    return out.select("doc_id", "n_bytes", "kept", pairs.alias("spans"))
