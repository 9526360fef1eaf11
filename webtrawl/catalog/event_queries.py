"""Registered queries over fetch, request and call logs."""

from pyspark.sql import functions as F

from webtrawl.catalog import views as v
from webtrawl.catalog.registry import query
from webtrawl.catalog.views import with_views
from webtrawl.operators import fetchlog as fl
from webtrawl.operators import requests as rq
from webtrawl.operators import resilience as rs
from webtrawl.settings import SLO_TARGETS
from webtrawl.sources import messages as ms
from webtrawl.sources.metrics_text import metric_rows

DAY = 86_400_000
HOUR = 3_600_000

# Rows of a slice in the sliced queries: small, so that even small tables are cut.
_SLICE_ROWS = 500


# ---------------------------------------------------------------- statistics

_STATS = """count_if(ok) AS success, count_if(NOT ok) AS fail,
  CAST(sum(fetch_ms) AS BIGINT) AS total_fetch_ms"""
_RATIOS = """coalesce(fail * 100.0 / nullif(success + fail, 0), 0) AS error_pct,
  coalesce(total_fetch_ms / nullif(success, 0), 0) AS avg_latency_ms"""
_STATS_ROW = f"""SELECT *, success * 1000.0 / (hi - lo) AS rate, {_RATIOS}
  FROM (SELECT {_STATS}, min(ts_ms) AS lo, max(ts_ms) AS hi FROM fetch_log)"""


@query(
    "crawl_stats",
    with_views("fetch_log", extra={"stats": _STATS_ROW})
    + "SELECT success, fail, total_fetch_ms, rate, error_pct, avg_latency_ms FROM stats",
)
def crawl_stats(spark, sf):
    return fl.crawl_stats(v.fetch_log(spark, sf))


_DAILY = f"""SELECT *, success / 86400.0 AS rate, {_RATIOS} FROM
  (SELECT (ts_ms // {DAY}) * {DAY} AS window_ms, {_STATS} FROM fetch_log GROUP BY 1)"""


@query(
    "crawl_stats_per_window",
    with_views("fetch_log", extra={"daily": _DAILY}) + "SELECT * FROM daily",
)
def crawl_stats_per_window(spark, sf):
    return fl.crawl_stats(v.fetch_log(spark, sf), DAY)


@query(
    "error_severity",
    with_views("fetch_log")
    + """SELECT domain, success, fail, pct, fail * 1.0 / nullif(success, 0) AS ratio,
  CASE WHEN pct > 20 THEN 'red' WHEN pct > 10 THEN 'amber' ELSE 'green' END AS severity
FROM (SELECT *, fail * 100.0 / (success + fail) AS pct FROM
  (SELECT domain, count_if(ok) AS success, count_if(NOT ok) AS fail FROM fetch_log GROUP BY domain))""",
)
def error_severity(spark, sf):
    per_domain = v.fetch_log(spark, sf).groupBy("domain").agg(
        F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("fail")
    )
    return (
        per_domain.withColumn("pct", fl.error_pct("success", "fail"))
        .withColumn("ratio", fl.fail_per_success("success", "fail"))
        .withColumn("severity", fl.severity("pct"))
    )


@query(
    "avg_fetch_latency",
    with_views("fetch_log")
    + "SELECT sum(fetch_ms) / count_if(ok) AS avg_latency_ms FROM fetch_log",
)
def avg_fetch_latency(spark, sf):
    return fl.avg_fetch_latency(v.fetch_log(spark, sf))


@query(
    "domains_checked",
    with_views("fetch_log")
    + "SELECT count(DISTINCT regexp_extract(url, '^https://[^/]+', 0)) AS domains_checked FROM fetch_log",
)
def domains_checked(spark, sf):
    return fl.domains_checked(v.fetch_log(spark, sf))


@query(
    "domain_stats",
    with_views("nodes", "fetch_log")
    + """SELECT domain, coalesce(pages_crawled, 0) AS pages_crawled, last_crawled_at,
  coalesce(avg_response_time_ms, 0) AS avg_response_time_ms, coalesce(error_rate, 0) AS error_rate
FROM (SELECT domain, count(*) AS pages_crawled, max(crawled_at) AS last_crawled_at FROM nodes GROUP BY domain)
FULL JOIN (SELECT domain, avg(fetch_ms) AS avg_response_time_ms, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS error_rate
  FROM fetch_log GROUP BY domain) USING (domain)""",
)
def domain_stats(spark, sf):
    return fl.domain_stats(v.nodes(spark, sf), v.fetch_log(spark, sf))


_SESSION_GAP = 15 * 60_000


@query(
    "crawl_sessions",
    with_views("fetch_log")
    + f""", f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms, attempt_id) <= {_SESSION_GAP}
    THEN 0 ELSE 1 END AS first FROM fetch_log),
s AS (SELECT *, sum(first) OVER (ORDER BY ts_ms, attempt_id) AS id FROM f)
SELECT CAST(id AS BIGINT) AS id, min(ts_ms) AS started_at, max(ts_ms) AS ended_at, count_if(ok) AS pages_crawled,
  count_if(NOT ok) AS errors, count(DISTINCT domain) AS domains, 'finished' AS status FROM s GROUP BY id""",
)
def crawl_sessions(spark, sf):
    return fl.crawl_sessions(v.fetch_log(spark, sf), _SESSION_GAP)


@query(
    "error_budget",
    with_views("fetch_log", extra={"stats": _STATS_ROW})
    + """, a AS (SELECT success * 100.0 / (success + fail) AS p FROM stats)
SELECT p AS availability_pct, 43.8 AS budget_minutes, 43800 * (100 - p) / 100 AS spent_minutes,
  43.8 - 43800 * (100 - p) / 100 AS remaining_minutes FROM a""",
)
def error_budget(spark, sf):
    return fl.error_budget(fl.crawl_stats(v.fetch_log(spark, sf)))


_SLO_VALUES = """SELECT 'availability_pct' AS slo, success * 100.0 / (success + fail) AS value FROM stats
  UNION ALL SELECT 'error_rate_pct', error_pct FROM stats
  UNION ALL SELECT 'pages_per_second', rate FROM stats
  UNION ALL SELECT 'freshness_hours', (max(crawled_at) - min(crawled_at)) / 3600000.0 FROM nodes"""
_SLO_TABLE = "SELECT * FROM (VALUES " + ", ".join(map(str, SLO_TARGETS)) + ") t(slo, c, target)"


@query(
    "slo_report",
    with_views(
        "nodes", "fetch_log",
        extra={"stats": _STATS_ROW, "m": _SLO_VALUES, "goal": _SLO_TABLE},
    )
    + """SELECT slo, value, CAST(target AS DOUBLE) AS target,
  CASE c WHEN '>=' THEN value >= target WHEN '>' THEN value > target ELSE value < target END AS met
FROM m JOIN goal USING (slo)""",
)
def slo_report(spark, sf):
    return fl.slo_report(fl.crawl_stats(v.fetch_log(spark, sf)), v.nodes(spark, sf))


_RUNNING = """SELECT *, count(*) OVER w AS total, count_if(NOT ok) OVER w AS fails FROM fetch_log
  WINDOW w AS (PARTITION BY domain ORDER BY ts_ms, attempt_id ROWS UNBOUNDED PRECEDING)"""
_BLOCKED = """SELECT domain, min(ts_ms) AS blocked_at FROM running
  WHERE NOT ok AND total >= 20 AND fails / total > 0.2 GROUP BY domain"""


@query(
    "auto_blocklist",
    with_views("fetch_log", extra={"running": _RUNNING, "blocked": _BLOCKED})
    + "SELECT * FROM blocked",
)
def auto_blocklist(spark, sf):
    return fl.auto_blocklist(v.fetch_log(spark, sf), ratio=0.2)


@query(
    "auto_blocklist_sliced",
    with_views("fetch_log", extra={"running": _RUNNING, "blocked": _BLOCKED})
    + "SELECT * FROM blocked",
)
def auto_blocklist_sliced(spark, sf):
    """The same with every busy domain cut into time slices."""
    return fl.auto_blocklist(v.fetch_log(spark, sf), ratio=0.2, slice_rows=_SLICE_ROWS)


@query(
    "domains_blocked",
    with_views("fetch_log", extra={"running": _RUNNING, "blocked": _BLOCKED})
    + "SELECT count(*) AS domains_blocked FROM blocked",
)
def domains_blocked(spark, sf):
    return fl.domains_blocked(v.fetch_log(spark, sf), ratio=0.2)


# ---------------------------------------------------------------- sampled series

_HOURLY = f"""SELECT (ts_ms // {HOUR}) * {HOUR} AS window_ms, count_if(ok) AS success,
  count_if(NOT ok) AS fail FROM fetch_log GROUP BY 1"""


@query(
    "rolling_history",
    with_views("fetch_log", extra={"daily": _DAILY})
    + """SELECT window_ms, list_sum(list(error_pct) OVER w) AS error_sum, len(list(rate) OVER w) AS n,
  max(error_pct) OVER w AS error_max, max(rate) OVER w AS rate_max FROM daily
WINDOW w AS (ORDER BY window_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def rolling_history(spark, sf):
    samples = fl.crawl_stats(v.fetch_log(spark, sf), DAY)
    history = fl.rolling_history(samples, ["error_pct", "rate"], 10)
    total = F.aggregate("error_pct_history", F.lit(0.0), lambda acc, x: acc + x)
    return history.select(
        "window_ms", total.alias("error_sum"), F.size("rate_history").cast("long").alias("n"),
        F.col("error_pct_max").alias("error_max"), F.col("rate_max"),
    )


def _counter_samples(spark, sf):
    """Hourly counter samples that restart every day."""
    hourly = fl.crawl_stats(v.fetch_log(spark, sf), HOUR)
    rows = hourly.select(
        "window_ms",
        F.explode(F.array(
            F.struct(F.lit("success").alias("name"), F.col("success").alias("n")),
            F.struct(F.lit("fail").alias("name"), F.col("fail").alias("n")),
        )).alias("s"),
    ).select("window_ms", "s.*")
    from pyspark.sql import Window as W

    day = W.partitionBy("name", F.floor(F.col("window_ms") / DAY)).orderBy("window_ms")
    return rows.select(
        "name", F.col("window_ms").alias("ts_ms"),
        F.sum("n").over(day).cast("double").alias("value"),
    )


_SAMPLES = f"""SELECT name, window_ms AS ts_ms, CAST(sum(n) OVER (PARTITION BY name, window_ms // {DAY}
    ORDER BY window_ms) AS DOUBLE) AS value
  FROM (SELECT window_ms, 'success' AS name, success AS n FROM hourly
    UNION ALL SELECT window_ms, 'fail', fail FROM hourly)"""
_STEPS = """SELECT *, CASE WHEN value < prev THEN value ELSE value - prev END AS step FROM
  (SELECT *, lag(value) OVER (PARTITION BY name ORDER BY ts_ms) AS prev FROM samples)"""


@query(
    "counter_rate",
    with_views("fetch_log", extra={"hourly": _HOURLY, "samples": _SAMPLES, "steps": _STEPS})
    + f"""SELECT a.name, a.ts_ms, a.value,
  CASE WHEN count(b.ts_ms) > 1 THEN (sum(b.step) - arg_min(coalesce(b.step, 0), b.ts_ms)) * 1000.0
    / (a.ts_ms - min(b.ts_ms)) END AS rate
FROM steps a JOIN (SELECT name, ts_ms, coalesce(step, 0) AS step FROM steps) b
  ON a.name = b.name AND b.ts_ms <= a.ts_ms AND b.ts_ms > a.ts_ms - {6 * HOUR}
GROUP BY a.name, a.ts_ms, a.value""",
)
def counter_rate(spark, sf):
    return fl.counter_rate(_counter_samples(spark, sf), 6 * HOUR)


_ALERT_RULES = [("HighErrorRate", ">", 0.25, 7200), ("LowThroughput", "<", 10.0, 7200)]


def _alert_samples(spark, sf):
    hourly = fl.crawl_stats(v.fetch_log(spark, sf), HOUR)
    ratio = fl.fail_per_success("success", "fail")
    return hourly.select(
        F.col("window_ms").alias("ts_ms"),
        F.explode(F.array(
            F.struct(F.lit("HighErrorRate").alias("alert"), ratio.alias("value")),
            F.struct(F.lit("LowThroughput").alias("alert"),
                     F.col("success").cast("double").alias("value")),
        )).alias("s"),
    ).select("ts_ms", "s.*")


_CONDS = """SELECT 'HighErrorRate' AS alert, window_ms AS ts_ms,
    coalesce(fail / nullif(success, 0) > 0.25, false) AS cond FROM hourly
  UNION ALL SELECT 'LowThroughput', window_ms, success < 10 FROM hourly"""


@query(
    "alert_for",
    with_views("fetch_log", extra={"hourly": _HOURLY, "conds": _CONDS})
    + """, g AS (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY ts_ms)
    - row_number() OVER (PARTITION BY alert, cond ORDER BY ts_ms) AS island FROM conds),
r AS (SELECT *, min(ts_ms) OVER (PARTITION BY alert, island) AS since FROM g WHERE cond)
SELECT alert, since, min(CASE WHEN ts_ms - since >= 7200000 THEN ts_ms END) AS firing_at,
  max(ts_ms) AS until FROM r GROUP BY alert, island, since HAVING max(ts_ms) - since >= 7200000""",
)
def alert_for(spark, sf):
    return fl.alert_for(fl.alert_conditions(_alert_samples(spark, sf), _ALERT_RULES))


_METRICS = with_views(
    "nodes", "frontier", "fetch_log",
    extra={"running": _RUNNING, "blocked": _BLOCKED, "stats": _STATS_ROW},
) + """SELECT 'crawl_nodes_total' AS name, CAST((SELECT count(*) FROM nodes) AS VARCHAR) AS value
UNION ALL SELECT 'crawl_frontier_total', CAST((SELECT count(*) FROM frontier) AS VARCHAR)
UNION ALL SELECT 'crawl_success_total', CAST(success AS VARCHAR) FROM stats
UNION ALL SELECT 'crawl_fail_total', CAST(fail AS VARCHAR) FROM stats
UNION ALL SELECT 'crawl_error_rate_pct', printf('%.2f', CAST(error_pct AS DOUBLE)) FROM stats
UNION ALL SELECT 'crawl_domains_blacklisted', CAST((SELECT count(*) FROM blocked) AS VARCHAR)
UNION ALL SELECT 'crawl_pages_per_second', printf('%.4f', CAST(rate AS DOUBLE)) FROM stats
UNION ALL SELECT 'crawl_domains_total', CAST((SELECT count(DISTINCT domain) FROM fetch_log) AS VARCHAR)
UNION ALL SELECT 'crawl_avg_fetch_latency_ms', printf('%.0f', CAST(avg_latency_ms AS DOUBLE)) FROM stats
UNION ALL SELECT 'crawl_uptime_seconds', CAST((hi - lo) // 1000 AS VARCHAR) FROM stats
UNION ALL SELECT 'crawl_concurrency', CAST(busy AS VARCHAR) FROM (SELECT count(*) AS busy FROM fetch_log, stats WHERE ts_ms + fetch_ms >= hi)
UNION ALL SELECT unnest(['crawl_cpu_load', 'crawl_memory_rss_bytes', 'crawl_memory_heap_used_bytes']), '0'"""


@query("metric_rows", _METRICS)
def metric_rows_(spark, sf):
    """All metrics; the log says nothing of the machine's load and memory, which read as 0."""
    log = v.fetch_log(spark, sf)
    end = log.agg(F.max("ts_ms")).scalar()
    stats = fl.crawl_stats(log).select(
        "*",
        v.nodes(spark, sf).agg(F.count("*").alias("n")).scalar().alias("node_count"),
        v.frontier(spark, sf).agg(F.count("*").alias("n")).scalar().alias("frontier_count"),
        fl.domains_blocked(log, ratio=0.2).scalar().alias("domains_blocked"),
        fl.domains_checked(log).scalar().alias("domains_checked"),
        log.agg(F.floor((F.max("ts_ms") - F.min("ts_ms")) / 1000)).scalar().alias("uptime_s"),
        log.filter(F.col("ts_ms") + F.col("fetch_ms") >= end).agg(F.count("*")).scalar().alias("concurrency"),
    )
    return metric_rows(stats).select("name", "value")


# ---------------------------------------------------------------- requests


@query(
    "slow_requests",
    with_views("requests")
    + "SELECT request_id, client, duration_ms FROM requests WHERE duration_ms > 1000",
)
def slow_requests(spark, sf):
    return rq.slow_requests(v.requests(spark, sf)).select("request_id", "client", "duration_ms")


@query(
    "latency_percentiles",
    with_views("requests")
    + """SELECT kind, requests, p95, p99, p95 < l95 AND p99 < l99 AS met FROM
  (SELECT kind, count(*) AS requests, quantile_cont(duration_ms, 0.95) AS p95,
     quantile_cont(duration_ms, 0.99) AS p99 FROM requests GROUP BY kind)
JOIN (VALUES ('search', 500, 1000), ('stats', 200, 500), ('page', 300, 600)) t(kind, l95, l99) USING (kind)""",
)
def latency_percentiles(spark, sf):
    return rq.latency_percentiles(v.requests(spark, sf))


@query(
    "sliding_rate_limit",
    with_views("requests")
    + f"""SELECT a.request_id, a.client, count(*) AS in_window, count(*) <= 5 AS allowed
FROM requests a JOIN requests b ON a.client = b.client AND b.ts_ms > a.ts_ms - {DAY}
  AND (b.ts_ms < a.ts_ms OR (b.ts_ms = a.ts_ms AND b.request_id <= a.request_id))
GROUP BY a.request_id, a.client""",
)
def sliding_rate_limit(spark, sf):
    return rq.sliding_rate_limit(v.requests(spark, sf), 5, DAY).select(
        "request_id", "client", "in_window", "allowed"
    )


_ANCHORS = f"""SELECT client, min(ts_ms) AS start FROM requests GROUP BY client
  UNION ALL SELECT a.client, (SELECT min(r.ts_ms) FROM requests r
     WHERE r.client = a.client AND r.ts_ms > a.start + {DAY}) AS start
  FROM anchors a WHERE a.start IS NOT NULL"""
_COUNTED = """SELECT r.*, a.start, count(*) OVER w AS n FROM requests r
  ASOF JOIN (SELECT * FROM anchors WHERE start IS NOT NULL) a ON r.client = a.client AND r.ts_ms >= a.start
  WINDOW w AS (PARTITION BY r.client, a.start ORDER BY r.ts_ms, r.request_id ROWS UNBOUNDED PRECEDING)"""
_ANCHORED_SQL = (
    with_views("requests", recursive=True, extra={"anchors": _ANCHORS, "counted": _COUNTED})
    + f"""SELECT request_id, start AS window_start, n AS "count", s AS search_count,
  NOT (n > 4 OR (is_search AND s > 1)) AS allowed,
  CASE WHEN n > 4 OR (is_search AND s > 1) THEN CAST(ceil(({DAY} - (ts_ms - start)) / 1000.0) AS BIGINT) END
    AS retry_after_s
FROM (SELECT *, count_if(is_search AND n <= 4) OVER (PARTITION BY client, start
    ORDER BY ts_ms, request_id ROWS UNBOUNDED PRECEDING) AS s FROM counted)"""
)


def _anchored(spark, sf, **slicing):
    limited = rq.anchored_rate_limit(v.requests(spark, sf), 4, 1, DAY, **slicing)
    return limited.select(
        "request_id", "window_start", "count", "search_count", "allowed", "retry_after_s"
    )


@query("anchored_rate_limit", _ANCHORED_SQL)
def anchored_rate_limit(spark, sf):
    return _anchored(spark, sf)


@query("anchored_rate_limit_sliced", _ANCHORED_SQL)
def anchored_rate_limit_sliced(spark, sf):
    """The same with every busy client cut into time slices."""
    return _anchored(spark, sf, slice_rows=_SLICE_ROWS)


# ---------------------------------------------------------------- breakers and retries

_T, _RESET, _HALF = 3, HOUR, 2
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts_ms, id) AS rn FROM calls"
_OPENED = f"(b.state = 'OPEN' AND c.ts_ms - b.last >= {_RESET})"
_IN_HALF = f"(b.state = 'HALF_OPEN' OR {_OPENED})"
_PROBES = "(CASE WHEN b.state = 'HALF_OPEN' THEN b.succ ELSE 0 END)"
_REPLAY = f"""SELECT name, CAST(0 AS BIGINT) AS rn, 'CLOSED' AS state, 0 AS fails, 0 AS succ,
    CAST(NULL AS BIGINT) AS last, true AS admitted FROM calls GROUP BY name
  UNION ALL SELECT b.name, c.rn,
    CASE WHEN b.state = 'OPEN' AND NOT {_OPENED} THEN 'OPEN'
      WHEN c.ok AND {_IN_HALF} THEN CASE WHEN {_PROBES} + 1 >= {_HALF} THEN 'CLOSED' ELSE 'HALF_OPEN' END
      WHEN c.ok THEN 'CLOSED'
      WHEN {_IN_HALF} OR b.fails + 1 >= {_T} THEN 'OPEN' ELSE 'CLOSED' END,
    CASE WHEN b.state = 'OPEN' AND NOT {_OPENED} THEN b.fails
      WHEN c.ok AND {_IN_HALF} THEN CASE WHEN {_PROBES} + 1 >= {_HALF} THEN 0 ELSE b.fails END
      WHEN c.ok THEN greatest(0, b.fails - 1) ELSE b.fails + 1 END,
    CASE WHEN c.ok AND {_IN_HALF} AND {_PROBES} + 1 < {_HALF} THEN {_PROBES} + 1 ELSE 0 END,
    CASE WHEN (b.state <> 'OPEN' OR {_OPENED}) AND NOT c.ok THEN c.ts_ms ELSE b.last END,
    b.state <> 'OPEN' OR {_OPENED}
  FROM replay b JOIN numbered c ON c.name = b.name AND c.rn = b.rn + 1"""
_BREAKER_SQL = (
    with_views("calls", recursive=True, extra={"numbered": _NUMBERED, "replay": _REPLAY})
    + """SELECT n.id, r.admitted, r.state, CAST(r.fails AS BIGINT) AS failure_count,
  r.last AS last_failure FROM replay r JOIN numbered n ON n.name = r.name AND n.rn = r.rn"""
)


def _breaker(spark, sf, **slicing):
    replayed = rs.circuit_breaker(v.calls(spark, sf), _T, _RESET, _HALF, **slicing)
    return replayed.select("id", "admitted", "state", "failure_count", "last_failure")


@query("circuit_breaker", _BREAKER_SQL)
def circuit_breaker(spark, sf):
    return _breaker(spark, sf)


@query("circuit_breaker_sliced", _BREAKER_SQL)
def circuit_breaker_sliced(spark, sf):
    """The same with every busy breaker cut into time slices."""
    return _breaker(spark, sf, slice_rows=_SLICE_ROWS)


@query(
    "breaker_state",
    with_views("calls", recursive=True, extra={"numbered": _NUMBERED, "replay": _REPLAY})
    + """SELECT name, state, CAST(fails AS BIGINT) AS "failureCount", last AS "lastFailure" FROM replay
QUALIFY row_number() OVER (PARTITION BY name ORDER BY rn DESC) = 1""",
)
def breaker_state(spark, sf):
    return rs.breaker_state(rs.circuit_breaker(v.calls(spark, sf), _T, _RESET, _HALF))


_SHARED = f"""SELECT name, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS fails,
    CAST(NULL AS BIGINT) AS opened, true AS admitted, 'CLOSED' AS state FROM calls GROUP BY name
  UNION ALL SELECT b.name, c.rn,
    CASE WHEN coalesce(c.ts_ms < b.opened + {_RESET}, false) OR c.ok THEN b.fails ELSE b.fails + 1 END,
    CASE WHEN coalesce(c.ts_ms < b.opened + {_RESET}, false) THEN b.opened
      WHEN NOT c.ok AND b.fails + 1 >= {_T} THEN c.ts_ms END,
    NOT coalesce(c.ts_ms < b.opened + {_RESET}, false),
    CASE WHEN coalesce(c.ts_ms < b.opened + {_RESET}, false) OR (NOT c.ok AND b.fails + 1 >= {_T})
      THEN 'OPEN' ELSE 'CLOSED' END
  FROM replay b JOIN numbered c ON c.name = b.name AND c.rn = b.rn + 1"""
_SHARED_SQL = (
    with_views("calls", recursive=True, extra={"numbered": _NUMBERED, "replay": _SHARED})
    + """SELECT n.id, r.admitted, r.state, r.fails AS failure_count
FROM replay r JOIN numbered n ON n.name = r.name AND n.rn = r.rn"""
)


@query("shared_breaker", _SHARED_SQL)
def shared_breaker(spark, sf):
    return rs.shared_breaker(v.calls(spark, sf), _T, _RESET).select(
        "id", "admitted", "state", "failure_count"
    )


@query("shared_breaker_sliced", _SHARED_SQL)
def shared_breaker_sliced(spark, sf):
    """The same with every busy breaker cut into time slices."""
    return rs.shared_breaker(v.calls(spark, sf), _T, _RESET, slice_rows=_SLICE_ROWS).select(
        "id", "admitted", "state", "failure_count"
    )


@query(
    "retry_schedule",
    with_views("fetch_log")
    + """SELECT url, attempt, CAST(1000 * pow(2, attempt) AS BIGINT) AS delay_ms,
  CAST(ts_ms + 1000 * (pow(2, attempt + 1) - 1) AS BIGINT) AS retry_at
FROM fetch_log, (SELECT unnest([0, 1, 2]) AS attempt) WHERE NOT ok""",
)
def retry_schedule(spark, sf):
    dead = v.fetch_log(spark, sf).filter(~F.col("ok")).select(
        "url", F.col("ts_ms").alias("timestamp")
    )
    return rs.retry_schedule(dead).select("url", "attempt", "delay_ms", "retry_at")


# ---------------------------------------------------------------- messages

_ENQUEUED = 1704067200000


def _broken_messages(spark, sf):
    """Encoded link messages; those of plain-http links are cut off in the middle."""
    sent = ms.to_url_messages(v.links(spark, sf), _ENQUEUED)
    cut = F.substring(F.col("value"), F.lit(1), F.floor(F.length("value") / 2).cast("int"))
    return sent.withColumn(
        "value",
        F.when(F.startswith("key", F.lit("https")), F.col("value")).otherwise(cut),
    )


@query(
    "url_messages",
    with_views("links")
    + f"""SELECT url AS key, '{{"url":"' || url || '","depth":' || depth || ',"parent":"' || parent
  || '","enqueuedAt":{_ENQUEUED}}}' AS value FROM links""",
)
def url_messages(spark, sf):
    return ms.to_url_messages(v.links(spark, sf), _ENQUEUED).select("key", "value")


@query(
    "decode_url_messages",
    with_views("links")
    + f"SELECT url, depth, parent, {_ENQUEUED} AS \"enqueuedAt\" FROM links WHERE starts_with(url, 'https')",
)
def decode_url_messages(spark, sf):
    return ms.split_dead_letters(_broken_messages(spark, sf), 7)[0]


@query(
    "dead_letters",
    with_views("links")
    + "SELECT url, 'not JSON' AS error, 7 AS timestamp FROM links WHERE NOT starts_with(url, 'https')",
)
def dead_letters(spark, sf):
    return ms.split_dead_letters(_broken_messages(spark, sf), 7)[1]


@query(
    "processed_messages",
    """SELECT url AS key, '{"url":"' || url || '","processedAt":9}' AS value FROM pages""",
)
def processed_messages(spark, sf):
    return ms.to_processed_messages(v.pages(spark, sf), 9)
