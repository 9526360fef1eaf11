"""Chains of windows anchored at events, in parallel even within one key.

A window starts at an event and ends when more than ``window_ms`` has passed; the next event
starts the next window. That is a sequential rule, but what a time slice needs to know from
everything before it is one number, the start of the window still open. Long keys are cut
into slices (see ``hotkeys``); each slice first tabulates, for every possible open start, the
start that is open at its end. That table is a step function with few steps. Walking the
small tables per key gives each slice its true open start, and the slices are then resolved
in parallel.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.plans.hotkeys import (
    SLICE,
    SLICE_ROWS,
    SLICED,
    grouped_for_python,
    with_slices,
)


def _next_start(times: np.ndarray, window_ms: int) -> np.ndarray:
    """Index of the event that starts the window after the one started at each event."""
    return np.searchsorted(times, times + window_ms, side="right")


def _exit_steps(times: np.ndarray, window_ms: int) -> tuple[list[int], list[int]]:
    """Steps ``(first event started, start open at the end)`` over the possible entry events.

    Only the first event of the slice and the events up to one window after it can be the
    first to start a window here.
    """
    after = _next_start(times, window_ms)
    final = np.empty(len(times), dtype=np.int64)
    for i in range(len(times) - 1, -1, -1):
        final[i] = times[i] if after[i] == len(times) else final[after[i]]
    reach = int(np.searchsorted(times, times[0] + window_ms, side="right"))
    final = final[: max(reach, 1) + (1 if reach < len(times) else 0)]
    upto, out = [], []
    for i, value in enumerate(final):
        if out and out[-1] == value:
            upto[-1] = int(times[i])
        else:
            upto.append(int(times[i]))
            out.append(int(value))
    return upto, out


def anchored_starts(
    df: DataFrame, key: str, ms: str, window_ms: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``(key, ms, window_start)`` for every distinct event time of each key."""
    events = df.select(key, ms).distinct()
    cut = with_slices(events, [key], ms, slice_rows)

    def tabulate(group: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(group[ms].to_numpy(np.int64))
        upto, out = _exit_steps(times, window_ms)
        return pd.DataFrame(
            {key: [group[key].iloc[0]], SLICE: [group[SLICE].iloc[0]], "last": [times[-1]],
             "upto": [upto], "final": [out]}
        )

    def walk(tables: pd.DataFrame) -> pd.DataFrame:
        tables = tables.sort_values(SLICE)
        entries, open_start = [], None
        for last, upto, final in zip(tables["last"], tables["upto"], tables["final"]):
            entries.append(open_start)
            if open_start is None:
                open_start = int(final[0])
            elif open_start + window_ms < last:
                # The first event after the open window is at or before this step's end.
                step = int(np.searchsorted(np.asarray(upto), open_start + window_ms, "right"))
                open_start = int(final[step])
        return pd.DataFrame(
            {key: tables[key].to_numpy(), SLICE: tables[SLICE].to_numpy(),
             "_open_": pd.array(entries, dtype="Int64")}
        )

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(group[ms].to_numpy(np.int64))
        entry = group["_open_"].iloc[0]
        starts = np.empty(len(times), dtype=np.int64)
        i = 0
        if not pd.isna(entry):
            i = int(np.searchsorted(times, int(entry) + window_ms, side="right"))
            starts[:i] = int(entry)
        after = _next_start(times, window_ms)
        while i < len(times):
            starts[i : after[i]] = times[i]
            i = int(after[i])
        return pd.DataFrame({key: group[key].iloc[0], ms: times, "window_start": starts})

    key_type = df.schema[key].dataType.simpleString()
    tables = grouped_for_python(cut.filter(SLICED), key, SLICE).applyInPandas(
        tabulate,
        f"{key} {key_type}, {SLICE} long, last long, upto array<long>, final array<long>",
    )
    entries = tables.groupBy(key).applyInPandas(
        walk, f"{key} {key_type}, {SLICE} long, _open_ long"
    )
    ready = cut.join(entries, [key, SLICE], "left").select(key, ms, SLICE, "_open_")
    return grouped_for_python(ready, key, SLICE).applyInPandas(
        resolve, f"{key} {key_type}, {ms} long, window_start long"
    )
