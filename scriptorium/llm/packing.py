"""Packing of tokenised documents into fixed windows by Karmarkar-Karp differencing.

Each task tokenises its own rows and packs them in batches of `batch_windows`
windows, so packing needs no shuffle. A document is cut into full windows and a
remainder, and this into pieces of at most `piece` tokens. Multiway differencing of the
pieces merges the two partial partitions of largest spread, largest window against
smallest, until one partition of near-equal windows is left. While one of its windows
exceeds the capacity, the window count rises by one and differencing begins anew.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._arrays import bounded, ragged, text_buffer

_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def karmarkar_karp(sizes: np.ndarray, n: int) -> np.ndarray:
    """The bin (0..n-1) of each item under n-way largest differencing.

    A partial partition is its non-zero bin sums in descending order with a node
    for each bin; merging pairs the largest bins of one with the smallest of the
    other. Ties are broken by item order, so the result is deterministic.
    """
    m = len(sizes)
    if not m:
        return np.zeros(0, np.int64)
    parts = [(np.array([s]), np.array([i])) for i, s in enumerate(sizes.tolist())]
    spread = lambda sums: int(sums[0]) - (int(sums[-1]) if len(sums) == n else 0)
    heap = [(-spread(sums), i) for i, (sums, _) in enumerate(parts)]
    heapq.heapify(heap)
    left, right = [-1] * m, [-1] * m
    while len(heap) > 1:
        (a, an), (b, bn) = (parts[heapq.heappop(heap)[1]] for _ in range(2))
        alone = n - len(b)  # bins of a that meet an empty bin of b
        if len(a) <= alone:
            sums, nodes = np.concatenate((a, b)), np.concatenate((an, bn))
        else:
            both = len(a) - alone
            fresh = np.arange(len(left), len(left) + both)
            left += an[alone:].tolist()
            right += bn[::-1][:both].tolist()
            sums = np.concatenate((a[:alone], a[alone:] + b[::-1][:both], b[: len(b) - both]))
            nodes = np.concatenate((an[:alone], fresh, bn[: len(b) - both]))
        order = np.argsort(-sums, kind="stable")
        parts.append((sums[order], nodes[order]))
        heapq.heappush(heap, (-spread(parts[-1][0]), len(parts) - 1))
    bins = np.full(len(left), -1)
    nodes = parts[heap[0][1]][1]
    bins[nodes] = np.arange(len(nodes))
    for node in range(len(left) - 1, m - 1, -1):
        bins[left[node]] = bins[right[node]] = bins[node]
    return bins[:m]


def near_equal_windows(sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Windows as arrays of item numbers, none over `capacity`, which no single size may exceed."""
    n = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        bins = karmarkar_karp(sizes, n)
        if not len(sizes) or np.bincount(bins, weights=sizes).max() <= capacity:
            order = np.argsort(bins, kind="stable")
            return [x for x in np.split(order, np.cumsum(np.bincount(bins, minlength=n))[:-1]) if len(x)]
        n += 1


#: Kinds of bytes: 1 space and line feed, 2 other white space, 3 lead bytes of longer white space; and which byte may follow those.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[32, 10]], _KINDS[[9, 11, 12, 13, 28, 29, 30, 31]], _KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = 1, 2, 3
_SECOND = np.zeros((256, 256), bool)
_SECOND[[0xC2, 0xC2, 0xE1, 0xE2, 0xE2, 0xE3], [0x85, 0xA0, 0x9A, 0x80, 0x81, 0x80]] = True


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file, as little-endian uint32 bytes.

    Single spaces and line feeds between other characters are always token
    boundaries of this vocabulary's pattern, so a text with no other white space is
    cut before each of them; the distinct new units of a batch are encoded once and kept
    in a bounded cache. Texts with an added token of the file, such as its end-of-text
    mark, go to the tokenizer itself; any other text is encoded whole.
    """

    _LOADED: dict[str, ByteBpe] = {}

    def __init__(self, path: str, cache_entries: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary = whole["model"]["vocab"]
        self._added = [x["content"] for x in whole.get("added_tokens", [])]
        self._tokenizer = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in self._added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._after_space = np.zeros(max(ranks.values()) + 1, bool)
        self._after_space[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self._limit = cache_entries
        self._forget()

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        if path not in cls._LOADED:
            cls._LOADED[path] = cls(path)
        return cls._LOADED[path]

    def _forget(self) -> None:
        self._slots: dict[str, int] = {}
        self._ids, self._starts, self._sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._used = 0

    def _keep(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self._slots), len(units)
        while len(self._starts) < n + m:
            self._starts, self._sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self._starts, self._sizes))
        while len(self._ids) < self._used + len(ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        self._ids[self._used : self._used + len(ids)] = ids
        self._sizes[n : n + m] = sizes
        self._starts[n : n + m] = self._used + np.cumsum(sizes) - sizes
        self._used += len(ids)
        self._slots.update(zip(units, range(n, n + m), strict=True))

    def _learn(self, units: list[str]) -> None:
        """Encodes new units: those after a space in one call, since each begins with a token of its own there."""
        spaced = [u for u in units if u[0] == " "]
        if spaced:
            ids = np.array(self._encode("".join(spaced)), "<u4")
            starts = np.flatnonzero(self._after_space[ids])
            self._keep(spaced, ids, np.diff(np.append(starts, len(ids))))
        rest = [u for u in units if u[0] != " "]
        if rest:
            found = [self._encode(u) for u in rest]
            self._keep(rest, np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found], np.int64))

    def _irregular(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text has white space other than single spaces and line feeds between other characters, or an added token."""
        kind = _KINDS[data]
        plain = kind == 1
        bad = kind == 2
        bad[:-1] |= plain[:-1] & plain[1:]
        # Lead bytes of two- and three-byte white space; other characters that begin alike are encoded whole, too.
        lead = np.flatnonzero(kind == 3)
        second = data[np.minimum(lead + 1, len(data) - 1)]
        bad[lead] = _SECOND[data[lead], second]
        counts = np.concatenate(([0], np.cumsum(bad)))
        first, last = offsets[:-1], offsets[1:]
        some = last > first
        out = np.ones(len(first), bool)
        edge = plain[np.minimum(first, max(len(data) - 1, 0))] | plain[np.maximum(last - 1, 0)] if len(data) else out
        out[some] = ((counts[last] - counts[first]) > 0)[some] | edge[some]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        odd = np.zeros(len(texts), bool)
        for token in self._added:
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        data, offsets = text_buffer(column)
        whole = self._irregular(data, offsets) | odd
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            if texts[i]:
                out[i] = np.array(self._tokenizer.encode(texts[i], add_special_tokens=False).ids if odd[i] else self._encode(texts[i]), "<u4").tobytes()
        regular = np.flatnonzero(~whole)
        if not len(regular):
            return out
        if len(whole) > len(regular):
            data, offsets = text_buffer(column.take(pa.array(regular)))
        mark = (data == 32) | (data == 10)
        mark[offsets[:-1]] = True
        cuts = np.flatnonzero(mark)
        edges = np.append(cuts, len(data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = units.dictionary.to_pylist()
        if len(self._slots) > self._limit:
            self._forget()
        if fresh := [u for u in names if u not in self._slots]:
            self._learn(fresh)
        slots = np.fromiter(map(self._slots.__getitem__, names), np.int64, len(names))[units.indices.to_numpy()]
        sizes = self._sizes[slots]
        ids = self._ids[ragged(self._starts[slots], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.append(np.searchsorted(cuts, offsets[:-1]), len(cuts))] * 4
        for i, a, b in zip(regular.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, batch_windows: int = 256, piece: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and `ids` (little-endian uint32).

    Every id of every document, its closing `end_id` included, lies in exactly one
    piece; offsets in a sequence are gapless from 0. Null and empty texts give the
    closing id alone; a null doc_id is kept; repeated rows are packed each; an empty
    table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    A text is tokenised whole, whatever its length.
    """
    close = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe.load(tokenizer_path)
        context = TaskContext.get()
        following = (context.partitionId() if context else 0) << 40
        held, held_tokens = [], 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        def flush() -> list[tuple]:
            nonlocal following, held, held_tokens
            rows = []
            for window in near_equal_windows(np.array([len(x[3]) // 4 for x in held], np.int64), capacity):
                offset = 0
                for item in window.tolist():
                    doc_id, start, total, ids = held[item]
                    rows.append((doc_id, start, len(ids) // 4, total, following, offset, ids))
                    offset += len(ids) // 4
                following += 1
            held, held_tokens = [], 0
            return rows

        full, least = capacity * 4, min(piece, capacity) * 4
        for batch in bounded(batches, "text", 2_000_000):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += close
                total = len(ids) // 4
                end = len(ids) // full * full
                for at in range(0, end, full):
                    rows.append((doc_id, at // 4, capacity, total, following, 0, ids[at : at + full]))
                    following += 1
                for at in range(end, len(ids), least):
                    held.append((doc_id, at // 4, total, ids[at : at + least]))
                held_tokens += (len(ids) - end) // 4
                if held_tokens >= batch_windows * capacity:
                    rows += flush()
                if len(rows) >= 2000:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)
        if held:
            yield emit(flush())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(packed, _SCHEMA)
