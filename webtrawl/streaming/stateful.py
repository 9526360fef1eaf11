"""Per-key state machines on streams: auto-block, rate limits, breakers, alerts.

Each keeps a small state per key and handles a micro-batch's rows of a key in time order;
how many those are is bounded by the source's trigger limit. The batch operators of the same
names give the same results over a whole log, with hot keys cut into slices.
"""

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame

from webtrawl.functions.breaker_rules import Breaker, step
from webtrawl.operators.resilience import breaker_limits
from webtrawl.settings import (
    BLOCK_MIN_TOTAL,
    BLOCK_RATIO,
    BREAKER_HALF_OPEN_MAX,
    BREAKER_RESET_MS,
    BREAKER_THRESHOLD,
    RATE_MAX,
    RATE_SEARCH_MAX,
    RATE_WINDOW_MS,
)


def _in_order(chunks: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(list(by))


def stream_auto_block(
    log: DataFrame, min_total: int = BLOCK_MIN_TOTAL, ratio: float = BLOCK_RATIO
) -> DataFrame:
    """``(domain, blocked_at)`` once, when a domain trips the failure rule."""

    def fold(key, chunks, state):
        ok, fail, blocked = state.get if state.exists else (0, 0, False)
        tripped = []
        for at, good in _in_order(chunks, "ts_ms", "attempt_id")[["ts_ms", "ok"]].itertuples(
            index=False
        ):
            ok, fail = ok + bool(good), fail + (not good)
            if not good and not blocked and ok + fail >= min_total and fail / (ok + fail) > ratio:
                blocked = True
                tripped.append(int(at))
        state.update((ok, fail, blocked))
        yield pd.DataFrame({"domain": [key[0]] * len(tripped), "blocked_at": tripped})

    return log.groupBy("domain").applyInPandasWithState(
        fold, "domain string, blocked_at long", "ok long, fail long, blocked boolean", "append",
        "NoTimeout",
    )


def stream_anchored_rate_limit(
    requests: DataFrame, max_requests: int = RATE_MAX, max_searches: int = RATE_SEARCH_MAX,
    window_ms: int = RATE_WINDOW_MS,
) -> DataFrame:
    """Windows that start at a client's first request; idle clients are forgotten after two.

    ``requests`` needs a watermark on its event time.
    """

    def fold(key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        start, count, searches = state.get if state.exists else (None, 0, 0)
        rows = []
        batch = _in_order(chunks, "ts_ms", "request_id")
        for request_id, at, is_search in batch[["request_id", "ts_ms", "is_search"]].itertuples(
            index=False
        ):
            if start is None or at - start > window_ms:
                start, count, searches = int(at), 0, 0
            count += 1
            refused = count > max_requests
            if is_search and not refused:
                searches += 1
                refused = searches > max_searches
            wait = ceil((window_ms - (at - start)) / 1000) if refused else None
            rows.append((request_id, key[0], start, count, searches, not refused, wait))
        state.update((start, count, searches))
        state.setTimeoutTimestamp(max(start + 2 * window_ms, state.getCurrentWatermarkMs() + 1))
        columns = ["request_id", "client", "window_start", "count", "search_count", "allowed",
                   "retry_after_s"]
        yield pd.DataFrame(rows, columns=columns).astype({"retry_after_s": "Int64"})

    return requests.groupBy("client").applyInPandasWithState(
        fold,
        "request_id long, client string, window_start long, count long, search_count long, "
        "allowed boolean, retry_after_s long",
        "start long, count long, searches long", "append", "EventTimeTimeout",
    )


def stream_sliding_rate_limit(
    requests: DataFrame, max_requests: int = RATE_MAX, window_ms: int = RATE_WINDOW_MS
) -> DataFrame:
    """Requests in the last ``window_ms`` per client; the state is the times in that window."""

    def fold(key, chunks, state):
        times = list(state.get[0]) if state.exists else []
        first, rows = 0, []
        batch = _in_order(chunks, "ts_ms", "request_id")
        for request_id, at in batch[["request_id", "ts_ms"]].itertuples(index=False):
            times.append(int(at))
            while times[first] <= at - window_ms:
                first += 1
            count = len(times) - first
            rows.append((request_id, key[0], count, count <= max_requests))
        state.update((times[first:],))
        yield pd.DataFrame(rows, columns=["request_id", "client", "in_window", "allowed"])

    return requests.groupBy("client").applyInPandasWithState(
        fold, "request_id long, client string, in_window long, allowed boolean",
        "times array<long>", "append", "NoTimeout",
    )


def stream_circuit_breaker(
    calls: DataFrame, threshold: int = BREAKER_THRESHOLD, reset_ms: int = BREAKER_RESET_MS,
    half_open_max: int = BREAKER_HALF_OPEN_MAX,
) -> DataFrame:
    """The breaker's verdict and state for every call."""
    limits = breaker_limits(threshold, reset_ms, half_open_max)

    def fold(key, chunks, state):
        breaker = Breaker(*state.get) if state.exists else Breaker()
        rows = []
        for call, at, ok in _in_order(chunks, "ts_ms", "id")[["id", "ts_ms", "ok"]].itertuples(
            index=False
        ):
            admitted = step(breaker, int(at), bool(ok), limits)
            rows.append((key[0], call, admitted, breaker.mode, breaker.failures))
        state.update((breaker.mode, breaker.failures, breaker.successes, breaker.last_failure))
        yield pd.DataFrame(rows, columns=["name", "id", "admitted", "state", "failure_count"])

    return calls.groupBy("name").applyInPandasWithState(
        fold, "name string, id long, admitted boolean, state string, failure_count long",
        "mode string, failures long, successes long, last_failure long", "append", "NoTimeout",
    )


def stream_alerts(conditions: DataFrame) -> DataFrame:
    """``(alert, since, firing_at)`` when a condition has held for its hold time.

    ``conditions`` has alert, ts_ms, cond and hold_ms, one row per evaluation.
    """

    def fold(key, chunks, state):
        since, fired = state.get if state.exists else (None, False)
        rows = []
        batch = _in_order(chunks, "ts_ms")
        for at, cond, hold in batch[["ts_ms", "cond", "hold_ms"]].itertuples(index=False):
            if not cond:
                since, fired = None, False
                continue
            since = int(at) if since is None else since
            if not fired and at - since >= hold:
                fired = True
                rows.append((key[0], since, int(at)))
        state.update((since, fired))
        yield pd.DataFrame(rows, columns=["alert", "since", "firing_at"])

    return conditions.groupBy("alert").applyInPandasWithState(
        fold, "alert string, since long, firing_at long", "since long, fired boolean", "append",
        "NoTimeout",
    )
