"""Rate limits and latency over a request log."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.plans.chains import anchored_starts
from webtrawl.plans.hotkeys import SLICE_ROWS
from webtrawl.settings import (
    LATENCY_LIMITS,
    RATE_MAX,
    RATE_SEARCH_MAX,
    RATE_WINDOW_MS,
    SLOW_REQUEST_MS,
)


def slow_requests(requests: DataFrame, ms: int = SLOW_REQUEST_MS) -> DataFrame:
    return requests.filter(F.col("duration_ms") > ms)


def _with_client(requests: DataFrame) -> DataFrame:
    """Requests without a client address share one limit."""
    return requests.withColumn("client", F.coalesce("client", F.lit("unknown")))


def sliding_rate_limit(
    requests: DataFrame, max_requests: int = RATE_MAX, window_ms: int = RATE_WINDOW_MS
) -> DataFrame:
    """Add ``in_window`` and ``allowed``: requests of the client in the last ``window_ms``
    up to and including this one, rejected ones counted; equal times follow request_id.

    A request counts one from its time on and one less from the end of its window on, so the
    count is a running sum. Work is cut per client and window-long slot. A slot also gets the
    steps of the slot before it, which is all the look-back needs, so a hot client is spread
    over its slots.
    """
    requests = _with_client(requests)
    slot = F.floor(F.col("ts_ms") / window_ms)
    step = lambda at, by: F.struct(at.alias("at"), F.lit(by).alias("by"))
    comes, goes = step(F.col("ts_ms"), 1), step(F.col("ts_ms") + window_ms, -1)
    own = requests.withColumns({"_slot_": slot, "_step_": comes, "_own_": F.lit(True)})
    earlier = requests.select(
        "client", "request_id", (slot + 1).alias("_slot_"),
        F.explode(F.array(comes, goes)).alias("_step_"), F.lit(False).alias("_own_"),
    )
    both = own.unionByName(earlier, allowMissingColumns=True)
    up_to = (
        W.partitionBy("client", "_slot_")
        .orderBy("_step_.at", "_step_.by", "request_id")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    counted = both.withColumn("in_window", F.sum("_step_.by").over(up_to))
    return (
        counted.filter("_own_")
        .withColumn("allowed", F.col("in_window") <= max_requests)
        .select(*requests.columns, "in_window", "allowed")
    )


def anchored_rate_limit(
    requests: DataFrame,
    max_requests: int = RATE_MAX,
    max_searches: int = RATE_SEARCH_MAX,
    window_ms: int = RATE_WINDOW_MS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Fixed windows that start at a client's first request and restart once more than
    ``window_ms`` has passed since the start.

    Adds ``window_start``, ``count``, ``search_count``, ``allowed`` and ``retry_after_s``. Every
    request counts against ``max_requests``; a search that passes counts against
    ``max_searches`` as well. The chain of window starts is found per client slice
    (``anchored_starts``); the counting then is a window over one client window.
    """
    requests = _with_client(requests)
    starts = anchored_starts(requests, "client", "ts_ms", window_ms, slice_rows)
    placed = requests.join(starts, ["client", "ts_ms"])
    inside = (
        W.partitionBy("client", "window_start")
        .orderBy("ts_ms", "request_id")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    counted = placed.withColumn("count", F.count("*").over(inside)).withColumn(
        "_search_", F.col("is_search") & (F.col("count") <= max_requests)
    ).withColumn("search_count", F.count_if("_search_").over(inside))
    refused = (F.col("count") > max_requests) | (
        F.col("_search_") & (F.col("search_count") > max_searches)
    )
    left_ms = F.lit(window_ms) - (F.col("ts_ms") - F.col("window_start"))
    return counted.select(
        *requests.columns, "window_start", "count", "search_count",
        (~refused).alias("allowed"),
        F.when(refused, F.ceil(left_ms / 1000.0)).alias("retry_after_s"),
    )


def latency_percentiles(requests: DataFrame, kind: str = "kind", limits=None) -> DataFrame:
    """Exact p95 and p99 per request kind against its limits.

    Durations are counted per millisecond first, so the percentile works on a histogram
    bounded by the range of durations.
    """
    histogram = requests.groupBy(kind, "duration_ms").agg(F.count("*").alias("_n_"))
    points = histogram.groupBy(kind).agg(
        F.sum("_n_").alias("requests"),
        F.percentile("duration_ms", F.array(F.lit(0.95), F.lit(0.99)), F.col("_n_")).alias("_p_"),
    )
    table = requests.sparkSession.createDataFrame(
        limits or LATENCY_LIMITS, f"{kind} string, p95_limit long, p99_limit long"
    )
    p95, p99 = F.col("_p_")[0], F.col("_p_")[1]
    return points.join(F.broadcast(table), kind, "left").select(
        kind, "requests", p95.alias("p95"), p99.alias("p99"),
        ((p95 < F.col("p95_limit")) & (p99 < F.col("p99_limit"))).alias("met"),
    )
