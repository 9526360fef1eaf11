"""Circuit breakers over call logs and retry schedules for failed messages."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.breaker_rules import Breaker, Limits, advance, step, tabulate
from webtrawl.operators.tables import first_per_key
from webtrawl.plans.chains import anchored_starts
from webtrawl.plans.hotkeys import (
    SLICE,
    SLICE_ROWS,
    SLICED,
    grouped_for_python,
    running_totals,
    with_slices,
)
from webtrawl.plans.staging import stage
from webtrawl.settings import (
    BREAKER_HALF_OPEN_MAX,
    BREAKER_RESET_MS,
    BREAKER_THRESHOLD,
    RETRY_BASE_MS,
    RETRY_CAP_MS,
    RETRY_FACTOR,
    RETRY_MAX,
)


#: Calls a Python worker holds at a time to replay a breaker.
BREAKER_ROWS = 100_000


def breaker_limits(
    threshold: int | None = None, reset_ms: int | None = None, half_open_max: int | None = None
) -> Limits:
    """Limits with 0 or None read as the default."""
    return Limits(
        threshold or BREAKER_THRESHOLD,
        reset_ms or BREAKER_RESET_MS,
        half_open_max or BREAKER_HALF_OPEN_MAX,
    )


def circuit_breaker(
    calls: DataFrame,
    threshold: int = BREAKER_THRESHOLD,
    reset_ms: int = BREAKER_RESET_MS,
    half_open_max: int = BREAKER_HALF_OPEN_MAX,
    slice_rows: int = BREAKER_ROWS,
) -> DataFrame:
    """Replay each named breaker over its calls in (ts_ms, id) order.

    Returns ``name, id, ts_ms, ok, admitted, state, failure_count, last_failure`` as they are
    after the call. The rule is sequential, but a name with very many calls is still cut into
    time slices: each slice tabulates its end state for every start state, a short walk over
    those tables gives every slice its true start, and the slices are replayed in parallel.
    """
    limits = breaker_limits(threshold, reset_ms, half_open_max)
    unknown = F.col("ts_ms").isNull() | F.col("ok").isNull()  # no table of end states allows for these
    cut = with_slices(calls.select("name", "id", "ts_ms", "ok"), ["name"], "ts_ms", slice_rows, "id", unknown)

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts_ms", "id"])
        table = tabulate(group["ts_ms"].to_numpy(np.int64), group["ok"].to_numpy(bool), limits)
        return pd.DataFrame(
            {"name": [group["name"].iloc[0]], SLICE: [group[SLICE].iloc[0]],
             "ends": [json.dumps(table)]}
        )

    def walk(tables: pd.DataFrame) -> pd.DataFrame:
        tables = tables.sort_values(SLICE)
        breaker, starts = Breaker(), []
        for ends in tables["ends"]:
            starts.append(breaker)
            breaker = advance(breaker, json.loads(ends), limits)
        return pd.DataFrame(
            {"name": tables["name"].to_numpy(), SLICE: tables[SLICE].to_numpy(),
             "_mode_": [b.mode for b in starts], "_failures_": [b.failures for b in starts],
             "_successes_": [b.successes for b in starts],
             "_last_": pd.array([b.last_failure for b in starts], dtype="Int64")}
        )

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts_ms", "id"])
        breaker = Breaker()
        head = group.iloc[0]
        if isinstance(head["_mode_"], str):
            last = None if pd.isna(head["_last_"]) else int(head["_last_"])
            breaker = Breaker(head["_mode_"], int(head["_failures_"]), int(head["_successes_"]), last)
        rows = []
        for at, ok in zip(group["ts_ms"].tolist(), group["ok"].tolist()):
            admitted = step(breaker, at, ok, limits)
            rows.append((admitted, breaker.mode, breaker.failures, breaker.last_failure))
        out = group[["name", "id", "ts_ms", "ok"]].reset_index(drop=True)
        admitted, state, failures, last = zip(*rows)
        return out.assign(
            admitted=admitted, state=state, failure_count=failures,
            last_failure=pd.array(last, dtype="Int64"),
        )

    tables = grouped_for_python(cut.filter(SLICED), "name", SLICE).applyInPandas(
        summarise, f"name string, {SLICE} long, ends string"
    )
    starts = tables.groupBy("name").applyInPandas(
        walk,
        f"name string, {SLICE} long, _mode_ string, _failures_ long, _successes_ long, _last_ long",
    )
    ready = cut.join(starts, ["name", SLICE], "left").drop(SLICED)
    return grouped_for_python(ready, "name", SLICE).applyInPandas(
        replay,
        "name string, id long, ts_ms long, ok boolean, admitted boolean, state string, "
        "failure_count long, last_failure long",
    )


def breaker_state(replayed: DataFrame) -> DataFrame:
    """The last known state of each breaker."""
    last = first_per_key(replayed, ["name"], [F.desc("ts_ms"), F.desc("id")])
    return last.select(
        "name", "state", F.col("failure_count").alias("failureCount"),
        F.col("last_failure").alias("lastFailure"),
    )


def shared_breaker(
    calls: DataFrame,
    threshold: int = BREAKER_THRESHOLD,
    reset_ms: int = BREAKER_RESET_MS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The breaker whose state lives in a store with expiry.

    Successes never lower the failure count. An open state expires after ``reset_ms`` and then
    reads as closed with the old count, so from the first trip on any executed failure opens
    it again at once. Hence the open periods are a chain of windows anchored at failures.
    """
    base = calls.select("name", "id", "ts_ms", "ok")
    fails = running_totals(
        base.filter(~F.col("ok")), ["name"], "ts_ms", "id", {"n": F.lit(1).cast("long")}, slice_rows
    )
    tripping = stage(
        fails.filter(F.col("n") >= threshold).select("name", "id", "ts_ms"), "failures"
    )
    chain = anchored_starts(tripping, "name", "ts_ms", reset_ms - 1, slice_rows).filter(
        F.col("ts_ms") == F.col("window_start")
    )
    opened = (
        tripping.join(chain.select("name", "ts_ms"), ["name", "ts_ms"], "left_semi")
        .groupBy("name", F.col("ts_ms").alias("opened_ms"))
        .agg(F.min("id").alias("opened_id"))
    )
    slot = F.floor(F.col("opened_ms") / reset_ms)
    spread = opened.withColumn("_slot_", F.explode(F.array(slot, slot + 1)))
    placed = base.withColumn("_slot_", F.floor(F.col("ts_ms") / reset_ms)).alias("c").join(
        spread.alias("o"),
        (F.col("c.name") == F.col("o.name"))
        & (F.col("c._slot_") == F.col("o._slot_"))
        & (F.col("ts_ms") >= F.col("opened_ms"))
        & (F.col("ts_ms") < F.col("opened_ms") + reset_ms),
        "left",
    )
    after = (F.col("ts_ms") > F.col("opened_ms")) | (F.col("id") > F.col("opened_id"))
    itself = (F.col("ts_ms") == F.col("opened_ms")) & (F.col("id") == F.col("opened_id"))
    judged = placed.select(
        F.col("c.name").alias("name"), "id", "ts_ms", "ok",
        (~F.coalesce(after, F.lit(False))).alias("admitted"),
        F.when(F.coalesce(after | itself, F.lit(False)), "OPEN").otherwise("CLOSED").alias("state"),
    )
    executed = (F.col("admitted") & ~F.col("ok")).cast("long")
    return running_totals(
        judged, ["name"], "ts_ms", "id", {"failure_count": executed}, slice_rows
    )


def retry_delay_ms(
    attempt,
    base: int = RETRY_BASE_MS,
    factor: float = RETRY_FACTOR,
    cap: int = RETRY_CAP_MS,
    jitter: Column | None = None,
) -> Column:
    """Delay before retry ``attempt`` (from 0). ``jitter`` is a share in [0, 1) that scales the
    delay into its upper half; without it the delay is exact."""
    attempt = F.col(attempt) if isinstance(attempt, str) else attempt
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt), F.lit(float(cap)))
    if jitter is not None:
        delay = delay * (F.lit(0.5) + jitter * 0.5)
    return F.floor(delay)


def retry_schedule(
    dead_letters: DataFrame, max_retries: int = RETRY_MAX, jitter_seed: int | None = None, **delays
) -> DataFrame:
    """One row per dead letter and retry: attempt, its delay and the time it is due.

    The jitter is a hash of url, attempt and seed, so a re-run task gives the same times.
    """

    def delay(attempt: Column) -> Column:
        if jitter_seed is None:
            return retry_delay_ms(attempt, **delays)
        share = F.pmod(F.xxhash64("url", attempt, F.lit(jitter_seed)), F.lit(1 << 20)) / (1 << 20)
        return retry_delay_ms(attempt, jitter=share, **delays)

    tries = F.transform(F.sequence(F.lit(0), F.lit(max_retries - 1)), delay)
    return (
        dead_letters.withColumn("_delays_", tries)
        .select("*", F.posexplode("_delays_").alias("attempt", "delay_ms"))
        .withColumn(
            "retry_at",
            F.col("timestamp")
            + F.aggregate(
                F.slice("_delays_", 1, F.col("attempt") + 1),
                F.lit(0).cast("long"),
                lambda acc, d: acc + d,
            ),
        )
        .drop("_delays_")
    )
