"""Similarity digests of documents from statistically improbable byte windows.

Every window of 8 bytes has a collision entropy, kept up to date for all positions
at once from counts of equal bytes at each distance. Windows are ranked by how far
their entropy lies from that of ordinary text, nearly constant windows excepted; the
rarest of every 12 neighbouring windows is a feature. One rule holds for every length:
whether a window is a feature depends on the bytes around it alone, so all features of
a piece of at least 19 bytes are features of any text that holds it. Features go into a
chain of 2048-bit Bloom filters, at most 512 to a filter. Likeness is the bit overlap
beyond chance, as a share of the largest possible, averaged over the shorter chain.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _spark
from ._arrays import SpanHash, bounded

WINDOW, NEIGHBOURS, BITS, PER_FILTER, HASHES = 8, 12, 2048, 512, 2
# The share of byte pairs of a window that are equal in ordinary prose (mean), and the share from which a window is too uniform to tell texts apart.
_USUAL, _UNIFORM = 0.0618, 0.5


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def features(data: np.ndarray) -> np.ndarray:
    """Distinct hashes of the rarest of every `NEIGHBOURS` windows, in order of first place; a string of up to `WINDOW` bytes is one feature."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    hasher = SpanHash.of_bytes(data)
    if n <= WINDOW:
        return hasher(np.array([0]), np.array([n]))
    possible = WINDOW * (WINDOW - 1) // 2
    forward = np.zeros(n, np.int32)
    backward = np.zeros(n, np.int32)
    for distance in range(1, WINDOW):
        equal = data[:-distance] == data[distance:]
        forward[: n - distance] += equal
        backward[distance:] += equal
    # Moving on by one byte loses the pairs of the byte that leaves and gains those of the one that enters.
    pairs = np.empty(n - WINDOW + 1, np.int32)
    first = np.bincount(data[:WINDOW])
    pairs[0] = (first * (first - 1) // 2).sum()
    pairs[1:] = pairs[0] + np.cumsum(backward[WINDOW:] - forward[: n - WINDOW])
    at = np.arange(len(pairs))
    hashes = hasher(at, at + WINDOW)
    rarity = np.abs(pairs - round(_USUAL * possible)).astype(np.uint64)
    rank = ((np.uint64(1023) - np.minimum(rarity, np.uint64(1023))) << np.uint64(53)) | (hashes >> np.uint64(11))
    rank = np.where(pairs >= _UNIFORM * possible, rank | np.uint64(1 << 63), rank)
    lowest = _slide_min(rank, min(NEIGHBOURS, len(rank)))
    chosen = hashes[np.isin(rank, lowest)]
    _, place = np.unique(chosen, return_index=True)
    return chosen[np.sort(place)]


def digest(data: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of one byte string: uint8 [filters, BITS / 8]; empty for an empty string."""
    found = features(data)
    if not len(found):
        return np.zeros((0, BITS // 8), np.uint8)
    place = np.arange(len(found)) // PER_FILTER
    bits = np.zeros((int(place[-1]) + 1) * BITS, np.uint8)
    for k in range(HASHES):
        bits[place * BITS + ((found >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal chains, also for two empty ones, 0 if one alone is empty."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = (np.bitwise_count(x).sum(1).astype(float) for x in (a, b))
    total = 0.0
    for row, ones in zip(a, ones_a, strict=True):
        common = np.bitwise_count(row & b).sum(1).astype(float)
        chance = ones * ones_b / BITS
        most = np.minimum(ones, ones_b)
        sure = chance + 0.15 * (most - chance)  # overlap that unlike texts may reach
        total += float(np.clip((common - sure) / np.maximum(most - sure, 1e-9), 0, 1).max())
    return total / len(a)


def encoded(chain: np.ndarray) -> str:
    """Text form: number of filters, then the filters in base64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def _digest_of(text: str) -> np.ndarray:
    return digest(np.frombuffer(text.encode("utf-8"), np.uint8))


def edited_text(text: str, following: str) -> str:
    """`text` with its last half replaced by as much of the beginning of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("chain", pa.binary()), ("edited_chain", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_STATE = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("packed", pa.binary()), *_OUT])
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, chain binary, edited_chain binary, near_edited double, near_next double"


def _finished(doc_id, text: str, chain: np.ndarray, following: str, next_chain: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    edited_chain = _digest_of(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), chain.tobytes(), edited_chain.tobytes(), likeness(chain, edited_chain), likeness(chain, next_chain))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _encoded(chain: str) -> Column:
    """`encoded` as a Column; base64() may break its lines."""
    return F.concat((F.length(chain) / (BITS // 8)).cast("long").cast("string"), F.lit(":"), F.regexp_replace(F.base64(chain), "[\\r\\n]+", ""))


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next larger doc_id (rows with equal ids in an
    order of their texts; null ids come first); the last document's is the first. Texts
    travel compressed; they are range-partitioned and sorted by doc_id once. Each task
    pairs its own neighbours and hands out its first and last row, one pair a task,
    which a second small step pairs across tasks. Null counts as empty: an empty chain
    of filters. A single document is its own next one; an empty table gives no rows.
    Only doc_id and text are read.
    """

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in bounded(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack((t.as_py() or "").encode("utf-8")) for t in batch.column("text")], pa.binary())], names=["doc_id", "packed"])

    def opened(packed: bytes) -> str:
        return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, none = TaskContext.get().partitionId(), None, [None] * 6
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), strict=True):
                packed = packed.as_py()
                text = opened(packed)
                chain = _digest_of(text)
                if held is None:
                    rows.append(("head", part, packed, doc_id, *none))
                else:
                    rows.append(("done", part, None, *_finished(*held, text, chain)))
                held, last = (doc_id, text, chain), packed
                if len(rows) >= 500:
                    yield _rows(rows, _STATE)
                    rows = []
        if held is not None:
            rows.append(("tail", part, last, held[0], *none))
        if rows:
            yield _rows(rows, _STATE)

    small = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(compressed, "doc_id long, packed binary")
    ordered = small.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")
    state = _spark.written(ordered.mapInArrow(paired, f"kind string, part long, packed binary, {_OUT_DDL}"))
    done = state.filter("kind = 'done'").select(*[n for n, _ in _OUT])
    heads = state.filter("kind = 'head'").select("part", F.col("packed").alias("next_packed"))
    # One row a task: the task numbers alone are ordered in one place.
    order = heads.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    tails = state.filter("kind = 'tail'").select("part", "doc_id", "packed").join(order, "part").join(heads.select(F.col("part").alias("next_part"), "next_packed"), "next_part").select("doc_id", "packed", "next_packed")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                text, following = opened(x["packed"]), opened(x["next_packed"])
                rows.append(_finished(x["doc_id"], text, _digest_of(text), following, _digest_of(following)))
            if rows:
                yield _rows(rows, pa.schema(_OUT))

    every = done.unionByName(tails.mapInArrow(closed, _OUT_DDL))
    return every.select("doc_id", "n_chars", "edited_sha256", _encoded("chain").alias("fingerprint"), _encoded("edited_chain").alias("edited_fingerprint"), "near_edited", "near_next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row: repeated rows and null ids are kept, null counts as empty (an empty chain of filters), an empty table gives no rows; only doc_id and text are read, texts whole."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encoded(_digest_of(t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n_chars long, fingerprint string")
