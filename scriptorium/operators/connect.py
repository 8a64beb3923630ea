"""Requests to hosted models from tasks: batches under a token limit, pacing, retries, a log.

Rows are dealt to `slots` streams and ordered within each. A stream is one task that holds
one client and sends one request at a time, so the streams bound the load on the service,
and a budget of requests or tokens a minute is shared out evenly over them. A request's
composition follows from the rows alone: a task that Spark runs again sends the same ones,
and with a store it finds those that were answered already and does not send them again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import rules
from ..sources.answered import AnsweredRequests

#: Rows and tokens of answered requests after which a task gives them on.
FRAME_ROWS, FRAME_TOKENS = 2000, 200_000
SLOT, REQUEST, CALLS, TOKENS = "slot", "request_no", "calls", "tokens"


class Retryable(Exception):
    """The same request may succeed later: a rate limit, a time-out. Clients raise it or wrap what they get in it."""


@dataclass(frozen=True)
class Limits:
    """Of one build: what a request may hold, how often it is tried, what the service allows a minute in all."""

    tokens: int = rules.BATCH_TOKENS
    texts: int = 1000
    attempts: int = 6
    first_wait: float = 30.0
    growth: float = 1.5
    longest_wait: float = 600.0
    requests_per_minute: float | None = None
    tokens_per_minute: float | None = None
    slots: int = 8


def batches_by_tokens(frames: Iterator[pd.DataFrame], count: Callable[[str], int], limit: int = rules.BATCH_TOKENS, column: str = "text", texts: int | None = None, apart: str | None = None) -> Iterator[pd.DataFrame]:
    """Rows in batches of at most `limit` tokens and `texts` rows, a longer text alone, over the borders of frames.

    A batch closes when it has tokens and the next row would pass the limit, when it is
    full, or where the value of `apart` changes. Null texts have no tokens.
    """
    for batch, _ in _batches(frames, count, limit, column, texts, apart):
        yield batch


def _batches(frames: Iterator[pd.DataFrame], count: Callable[[str], int], limit: int = rules.BATCH_TOKENS, column: str = "text", texts: int | None = None, apart: str | None = None) -> Iterator[tuple[pd.DataFrame, int]]:
    """`batches_by_tokens`, each with its tokens."""
    held: list[pd.DataFrame] = []
    rows, total, last = 0, 0, None
    for frame in frames:
        first = 0
        groups = frame[apart].tolist() if apart else [None] * len(frame)
        for i, (said, group) in enumerate(zip(frame[column].tolist(), groups, strict=True)):
            n = count(said) if said else 0
            if rows and ((total and total + n > limit) or rows == texts or group != last):
                yield _joined([*held, frame.iloc[first:i]]), total
                held, first, rows, total = [], i, 0, 0
            rows, total, last = rows + 1, total + n, group
        if first < len(frame):
            held.append(frame.iloc[first:])
    if held:
        yield _joined(held), total


def _joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return parts[0].reset_index(drop=True) if len(parts) == 1 else pd.concat(parts, ignore_index=True)


class _Pace:
    """Keeps one stream under its share of the service's budget; time goes by monotonic clock."""

    def __init__(self, limits: Limits):
        per_request = 60.0 * limits.slots / limits.requests_per_minute if limits.requests_per_minute else 0.0
        per_token = 60.0 * limits.slots / limits.tokens_per_minute if limits.tokens_per_minute else 0.0
        self._cost = lambda tokens: max(per_request, per_token * tokens)
        self._free_at = 0.0

    def wait(self, tokens: int) -> None:
        now = time.monotonic()
        if self._free_at > now:
            time.sleep(self._free_at - now)
        self._free_at = max(now, self._free_at) + self._cost(tokens)


def patiently(call: Callable[[], Any], limits: Limits, pace: _Pace, tokens: int) -> tuple[Any, int]:
    """(result, calls made): tries again after a `Retryable`, with growing waits, `limits.attempts` times at most; then it is raised."""
    wait = limits.first_wait
    for calls in range(1, limits.attempts + 1):
        pace.wait(tokens)
        try:
            return call(), calls
        except Retryable:
            if calls == limits.attempts:
                raise
            time.sleep(wait)
            wait = min(wait * limits.growth, limits.longest_wait)
    raise ValueError("limits.attempts must be 1 at least")


def dealt(rows: DataFrame, slots: int, order: list[str], slot: str | None = None) -> DataFrame:
    """`rows` with `slot`, one partition a slot in `order`: by a hash of all columns, or the numbers from 0 in column `slot`."""
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]), F.lit(slots))
    own = F.pmod(F.col(slot), F.lit(slots)) if slot else hashed
    return rows.withColumn(SLOT, own.cast("int")).repartitionById(slots, F.col(SLOT)).sortWithinPartitions(*order)


def ask_in_requests(
    rows: DataFrame,
    client: Callable[[], Any],
    ask: Callable[[Any, pd.DataFrame], dict[str, list]],
    answers: str,
    limits: Limits,
    count: Callable[[str], int],
    column: str = "text",
    order: list[str] | None = None,
    slot: str | None = None,
    apart: str | None = None,
    store: AnsweredRequests | None = None,
    log: bool = False,
) -> DataFrame:
    """`rows` with the columns `answers` (a DDL string) that `ask(client, batch)` gives as lists, one value a row.

    `client` makes a stream's client inside its task. `order` (the columns whose values
    name a row; all of them if None) fixes the order of a stream. With `apart` a request
    holds rows of one value of it only. With `log`, rows also tell their slot, request_no,
    tokens (of the request) and calls. With a `store` an answered request is written
    there at once, and one that is found there is not sent again.
    """
    order = order or [c for c in rows.columns if not isinstance(rows.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType))]
    given = dealt(rows, limits.slots, ([apart] if apart else []) + order, slot)
    fresh = T.StructType.fromDDL(answers)
    logged = T.StructType.fromDDL(f"{REQUEST} int, {TOKENS} long, {CALLS} int")
    schema = T.StructType(given.schema.fields + fresh.fields + logged.fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in fresh]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, pace = None, _Pace(limits)
        held: list[pd.DataFrame] = []
        added: dict[str, list] = {name: [] for name in [*names, REQUEST, TOKENS, CALLS]}
        size = 0

        def whole(parts: list[pd.DataFrame], more: dict[str, list]) -> pd.DataFrame:
            out = pd.concat(parts, ignore_index=True)
            for name, values in more.items():
                out[name] = pd.Series(values, dtype=object) if name in names else values
            return out

        # Many small requests leave a task as one frame.
        for number, (batch, tokens) in enumerate(_batches(frames, count, limits.tokens, column, limits.texts, apart), 1):
            # The rows name a request, so a second attempt of the task knows it again.
            mark = store.name_of(batch, order) if store else None
            found = store.find(mark) if store else None
            if found is not None:
                yield found.to_pandas()
                continue
            session = client() if session is None else session
            got, calls = patiently(lambda batch=batch: ask(session, batch), limits, pace, tokens)
            n = len(batch)
            for name in names:
                if len(got[name]) != n:
                    raise ValueError(f"{len(got[name])} values of {name} for {n} rows")
            own = {name: list(got[name]) for name in names} | {REQUEST: [number] * n, TOKENS: [tokens] * n, CALLS: [calls] * n}
            if store:
                store.commit(mark, pa.Table.from_pandas(whole([batch], own), arrow, preserve_index=False))
            held.append(batch)
            for name, values in own.items():
                added[name] += values
            size += tokens + n
            if len(added[REQUEST]) >= FRAME_ROWS or size >= FRAME_TOKENS:
                yield whole(held, added)
                held, added, size = [], {name: [] for name in added}, 0
        if held:
            yield whole(held, added)

    out = given.mapInPandas(run, schema)
    return out if log else out.drop(SLOT, REQUEST, TOKENS, CALLS)
