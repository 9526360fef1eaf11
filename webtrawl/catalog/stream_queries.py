"""Registered streaming jobs, run over a whole table as a file stream."""

from pyspark.sql import functions as F

from webtrawl import schemas
from webtrawl.catalog import event_queries as eq
from webtrawl.catalog import views as v
from webtrawl.catalog.registry import SQL, query
from webtrawl.catalog.views import with_views
from webtrawl.streaming import ingest, stateful, windows
from webtrawl.streaming.runs import read_file_stream, run_append, run_update

DAY, HOUR = eq.DAY, eq.HOUR


def _events(spark, sf):
    return read_file_stream(spark, sf, schemas.EVENTS, "events.parquet")


def _fetch_log(spark, sf):
    return v.fetch_log_of(_events(spark, sf))


def _requests(spark, sf):
    return v.requests_of(_events(spark, sf))


@query(
    "stream_crawl_stats",
    with_views("fetch_log", extra={"daily": eq._DAILY})
    + "SELECT window_ms, success, fail, total_fetch_ms, error_pct FROM daily",
)
def stream_crawl_stats(spark, sf):
    stats = windows.stream_crawl_stats(_fetch_log(spark, sf), "1 day", "1 hour")
    return run_update(stats, "crawl_stats", ["window_ms"])


@query(
    "stream_error_ratio",
    with_views("fetch_log")
    + f"""SELECT w AS window_ms, count_if(ok) AS success, count_if(NOT ok) AS fail,
  count_if(NOT ok) * 1.0 / nullif(count_if(ok), 0) AS ratio
FROM (SELECT ok, (ts_ms // {6 * HOUR} - k) * {6 * HOUR} AS w FROM fetch_log, (SELECT unnest([0, 1, 2, 3]) AS k))
GROUP BY w""",
)
def stream_error_ratio(spark, sf):
    ratio = windows.stream_error_ratio(_fetch_log(spark, sf), "24 hours", "6 hours", "1 hour")
    return run_update(ratio, "error_ratio", ["window_ms"])


_SESSIONS_SQL = with_views("fetch_log") + """, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY
    THEN 0 ELSE 1 END AS first FROM fetch_log WINDOW w AS (PARTITION BY domain ORDER BY ts, attempt_id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY domain ORDER BY ts, attempt_id) AS n FROM f)
SELECT domain, epoch_us(min(ts)) // 1000 AS started_at, epoch_us(max(ts)) // 1000 + 86400000 AS closes_at,
  count_if(ok) AS success, count_if(NOT ok) AS fail FROM s GROUP BY domain, n"""


@query("domain_sessions", _SESSIONS_SQL)
def domain_sessions(spark, sf):
    return windows.session_stats(v.fetch_log(spark, sf), "1 day")


@query("stream_domain_sessions", _SESSIONS_SQL)
def stream_domain_sessions(spark, sf):
    """The same from a stream that keeps a row per domain and slot."""
    slots = run_update(windows.session_slots(_fetch_log(spark, sf), "1 day", "1 hour"), "session_slots", ["domain", "slot_ms"])
    return windows.sessions_of_slots(slots, DAY)


@query("stream_auto_block", SQL["auto_blocklist"])
def stream_auto_block(spark, sf):
    return run_append(stateful.stream_auto_block(_fetch_log(spark, sf), ratio=0.2), "auto_block")


@query("stream_anchored_rate_limit", SQL["anchored_rate_limit"])
def stream_anchored_rate_limit(spark, sf):
    requests = _requests(spark, sf).withWatermark("ts", "1 hour")
    limited = stateful.stream_anchored_rate_limit(requests, 4, 1, DAY)
    return run_append(limited, "anchored").drop("client")


@query("stream_sliding_rate_limit", SQL["sliding_rate_limit"])
def stream_sliding_rate_limit(spark, sf):
    return run_append(stateful.stream_sliding_rate_limit(_requests(spark, sf), 5, DAY), "sliding")


@query(
    "stream_circuit_breaker",
    f"SELECT id, admitted, state, failure_count FROM ({SQL['circuit_breaker']})",
)
def stream_circuit_breaker(spark, sf):
    calls = v.calls_of(_events(spark, sf))
    judged = stateful.stream_circuit_breaker(calls, eq._T, eq._RESET, eq._HALF)
    return run_append(judged, "breaker").drop("name")


@query("stream_alerts", f"SELECT alert, since, firing_at FROM ({SQL['alert_for']})")
def stream_alerts(spark, sf):
    """Alerts over a stream of hourly condition samples, staged from the fetch log."""
    from webtrawl.operators.fetchlog import alert_conditions
    from webtrawl.plans.staging import new_folder

    folder = new_folder(spark, "conditions")
    conditions = alert_conditions(eq._alert_samples(spark, sf), eq._ALERT_RULES)
    conditions.write.parquet(folder)
    stream = read_file_stream(spark, folder, conditions.schema)
    return run_append(stateful.stream_alerts(stream), "alerts")


@query(
    "stream_dedup",
    with_views("fetch_log") + "SELECT domain AS url, count(*) > 0 AS seen FROM fetch_log GROUP BY domain",
)
def stream_dedup(spark, sf):
    """Each domain once within the horizon, which spans the log."""
    urls = _fetch_log(spark, sf).select(F.col("domain").alias("url"), "ts")
    kept = run_append(windows.stream_dedup(urls, "ts", "60 days"), "dedup")
    return kept.select("url", F.lit(True).alias("seen"))


@query(
    "stream_frontier_ingest",
    with_views("frontier")
    + "SELECT url, max(depth) >= 0 AS known FROM frontier WHERE starts_with(url, 'https') GROUP BY url",
)
def stream_frontier_ingest(spark, sf):
    from webtrawl.plans.staging import new_folder

    folder = new_folder(spark, "messages")
    sent = eq._broken_messages(spark, sf).select("key", "value")
    sent.write.parquet(folder)
    stream = read_file_stream(spark, folder, sent.schema)
    frontier, _ = ingest.stream_frontier_ingest(stream, 7)
    return frontier.select("url", (F.col("depth") >= 0).alias("known"))


