"""The circuit-breaker rule for one call, and its effect over a run of calls.

``step`` is the rule itself. ``tabulate`` answers, for every state in which a run of calls
may start, in which state it ends; that lets runs be worked on in parallel.
"""

from collections import deque
from dataclasses import dataclass

import numpy as np

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


@dataclass(frozen=True)
class Limits:
    threshold: int
    reset_ms: int
    half_open_max: int


@dataclass
class Breaker:
    """Mode, failure count, successes while half open, time of the last failure."""

    mode: str = CLOSED
    failures: int = 0
    successes: int = 0
    last_failure: int | None = None


def step(b: Breaker, at_ms: int, ok: bool, limits: Limits) -> bool:
    """Apply one call to ``b``; False when the call is rejected."""
    if b.mode == OPEN:
        if at_ms - b.last_failure < limits.reset_ms:
            return False
        b.mode, b.successes = HALF_OPEN, 0
    if ok:
        if b.mode == CLOSED:
            b.failures = max(0, b.failures - 1)
            return True
        b.successes += 1
        if b.successes >= limits.half_open_max:
            b.mode, b.failures, b.successes = CLOSED, 0, 0
        return True
    b.failures += 1
    b.last_failure = at_ms
    if b.mode == HALF_OPEN or b.failures >= limits.threshold:
        b.mode = OPEN
    return True


# An end state is (mode, successes, last failure in the run or None, failure count or None,
# failures added when the count is None). A run entered open or half open adds to the count
# it was entered with until it closes once; then the count is known.


def _after_failure(end, at_ms):
    mode, successes, last, count, added = end
    return (mode, successes, at_ms if last is None else last, count, added)


def tabulate(times: np.ndarray, oks: np.ndarray, limits: Limits) -> dict:
    """End state of the run for each start: closed with each failure count, half open with
    each success count, and open, by the first call time that is late enough to get through.

    One pass from the last call to the first; each call changes a bounded number of entries.
    """
    n = len(times)
    wake = np.searchsorted(times, times + limits.reset_ms, side="left")
    closed = deque((CLOSED, 0, None, f, 0) for f in range(limits.threshold))
    half = [(HALF_OPEN, k, None, None, 0) for k in range(limits.half_open_max)]
    probe = [None] * n
    failure_seen = False
    for i in range(n - 1, -1, -1):
        at = int(times[i])
        if oks[i]:
            half = half[1:] + [closed[0]]
            closed.appendleft(closed[0])
            closed.pop()
        else:
            opened = (
                (OPEN, 0, at, None, 0) if wake[i] == n else _after_failure(probe[wake[i]], at)
            )
            mode, successes, last, count, added = opened
            tripped = (mode, successes, last, limits.threshold + added if count is None else count, 0)
            reopened = (mode, successes, last, count, added + 1 if count is None else 0)
            half = [reopened] * limits.half_open_max
            closed.popleft()
            if not failure_seen:
                closed = deque(_after_failure(end, at) for end in closed)
                failure_seen = True
            closed.append(tripped)
        probe[i] = half[0]
    reach = int(np.searchsorted(times, times[0] + limits.reset_ms, side="left"))
    upto, ends = [], []
    for j in range(min(reach + 1, n)):
        if j and times[j] == times[j - 1]:
            continue
        if ends and ends[-1] == probe[j]:
            upto[-1] = int(times[j])
        else:
            upto.append(int(times[j]))
            ends.append(probe[j])
    return {"closed": list(closed), "half": half, "upto": upto, "open": ends,
            "last": int(times[-1])}


def advance(b: Breaker, table: dict, limits: Limits) -> Breaker:
    """The breaker at the end of a tabulated run that it enters as ``b``."""
    if b.mode == CLOSED:
        end = table["closed"][b.failures]
    elif b.mode == HALF_OPEN:
        end = table["half"][b.successes]
    else:
        opens = b.last_failure + limits.reset_ms
        if opens > table["last"]:
            return b
        end = table["open"][int(np.searchsorted(np.asarray(table["upto"]), opens, side="left"))]
    mode, successes, last, count, added = end
    return Breaker(
        mode,
        b.failures + added if count is None else count,
        successes,
        b.last_failure if last is None else last,
    )
