"""The best k of many scores within a task: exact, in memory bounded by queries times k, over any number of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores held at once, rows of a slice times queries.
CELLS = 400_000
#: Scores are compared as whole millionths, as the results are rounded.
GRAIN = 1_000_000


def millionths(scores: np.ndarray) -> np.ndarray:
    """Scores in whole millionths, halves away from zero."""
    return (np.sign(scores) * np.floor(np.abs(scores) * GRAIN + 0.5)).astype(np.int64)


class Best:
    """For each of `queries` queries the k rows of highest score, ties by higher ordinal; `least` is the lowest score that counts, in millionths."""

    def __init__(self, queries: int, k: int, least: int | None = None):
        self.k = k
        #: The least score that still counts.
        self.bar = np.full(queries, np.iinfo(np.int64).min if least is None else least, np.int64)
        self.size = 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, scores: np.ndarray, ordinals: np.ndarray, ids: np.ndarray) -> None:
        """`scores` (rows x queries) of rows with `ordinals` and `ids`."""
        # Only scores within a millionth of the bar are brought to whole millionths.
        row, query = np.nonzero(~(scores < (self.bar - 1.0) / GRAIN))
        exact = millionths(scores[row, query])
        some = exact >= self.bar[query]
        row, query, exact = row[some], query[some], exact[some]
        self.held.append((query, exact, ordinals[row], ids[row]))
        self.size += len(row)
        if self.size > max(CELLS, 4 * self.k * len(self.bar)):
            self._settle()

    def _settle(self) -> None:
        query, score, ordinal, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-ordinal, -score, query))
        query, score, ordinal, ids = query[order], score[order], ordinal[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        self.bar[query[full]] = score[full]
        some = place < self.k
        self.held, self.size = [(query[some], score[some], ordinal[some], ids[some])], int(some.sum())

    def rows(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, chunk_id, ordinal, score) of what is held, at most k a query."""
        if self.held:
            self._settle()
            query, score, ordinal, ids = self.held[0]
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), pa.array(ids.tolist(), pa.string()), pa.array(ordinal), pa.array(score / GRAIN)], ["query_id", "chunk_id", "ordinal", "score"])
