"""Metrics in the Prometheus text format."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (name, type, column, decimals or None, help).
METRICS = [
    ("nodes_total", "gauge", "node_count", None, "Total indexed nodes"),
    ("frontier_total", "gauge", "frontier_count", None, "URLs in frontier"),
    ("success_total", "counter", "success", None, "Total successful fetches"),
    ("fail_total", "counter", "fail", None, "Total failed fetches"),
    ("error_rate_pct", "gauge", "error_pct", 2, "Error rate percentage"),
    ("domains_total", "gauge", "domains_checked", None, "Total unique domains checked"),
    ("domains_blacklisted", "gauge", "domains_blocked", None, "Auto-blacklisted domains"),
    ("pages_per_second", "gauge", "rate", 4, "Crawl throughput"),
    ("avg_fetch_latency_ms", "gauge", "avg_latency_ms", 0, "Average fetch latency"),
    ("concurrency", "gauge", "concurrency", None, "Current concurrent fetches"),
    ("uptime_seconds", "gauge", "uptime_s", None, "Uptime in seconds"),
    ("cpu_load", "gauge", "cpu_load", 4, "Average CPU load"),
    ("memory_rss_bytes", "gauge", "memory_rss", None, "Resident set size in bytes"),
    ("memory_heap_used_bytes", "gauge", "memory_heap", None, "Heap used in bytes"),
]
STATE_HELP = "Circuit breaker state (0=closed,1=open,2=half)"
FAILURES_HELP = "Circuit breaker failure count"


def _shown(column: str, decimals: int | None) -> Column:
    value = F.coalesce(F.col(column), F.lit(0))
    if decimals is None:
        return value.cast("long").cast("string")
    # A zero is written without decimals.
    return F.when(value == 0, "0").otherwise(
        F.format_string(f"%.{decimals}f", value.cast("double"))
    )


def _entry(position: Column, name: Column, kind: str, text: str, value: Column) -> Column:
    return F.struct(
        position.alias("position"), name.alias("name"), F.lit(kind).alias("type"),
        F.lit(text).alias("help"), value.alias("value"),
    )


def metric_rows(stats: DataFrame, prefix: str = "crawl") -> DataFrame:
    """``(position, name, type, help, value)`` from one row of statistics; a column that is
    missing reads as 0."""
    known = stats
    for _, _, column, _, _ in METRICS:
        if column not in stats.columns:
            known = known.withColumn(column, F.lit(0))
    rows = [
        _entry(F.lit(i), F.lit(f"{prefix}_{name}"), kind, text, _shown(column, decimals))
        for i, (name, kind, column, decimals, text) in enumerate(METRICS)
    ]
    return known.select(F.explode(F.array(*rows)).alias("_m_")).select("_m_.*")


def breaker_rows(breakers: DataFrame, prefix: str = "crawl") -> DataFrame:
    """Two metrics per breaker, in name order after the statistics."""
    state = F.when(F.col("state") == "CLOSED", "0").when(F.col("state") == "OPEN", "1").otherwise("2")
    name = F.concat(F.lit(f"{prefix}_circuit_"), "name")
    after = F.lit(len(METRICS))
    rows = F.array(
        _entry(after, F.concat(name, F.lit("_state")), "gauge", STATE_HELP, state),
        _entry(after, F.concat(name, F.lit("_failures")), "gauge", FAILURES_HELP,
               F.coalesce("failureCount", F.lit(0)).cast("string")),
    )
    return breakers.select(F.explode(rows).alias("_m_")).select("_m_.*")


def render_metrics(
    stats: DataFrame, breakers: DataFrame | None = None, prefix: str = "crawl"
) -> DataFrame:
    """One ``text`` value in exposition format; blocks are separated by an empty line."""
    rows = metric_rows(stats, prefix)
    if breakers is not None:
        rows = rows.unionByName(breaker_rows(breakers, prefix))
    block = F.format_string("# HELP %s %s\n# TYPE %s %s\n%s %s", "name", "help", "name", "type",
                            "name", "value")
    is_failures = F.endswith("name", F.lit("_failures"))
    group = F.regexp_replace("name", "_(state|failures)$", "")
    keyed = rows.select(
        "position", group.alias("g"), F.when(is_failures, 1).otherwise(0).alias("s"),
        block.alias("block"),
    )
    # One small row per metric or breaker, never data rows, is collected into the text.
    listed = keyed.groupBy("position", "g").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("s", "block"))), lambda x: x["block"]),
            "\n",
        ).alias("block")
    )
    return listed.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "g", "block"))),
                lambda x: x["block"],
            ),
            "\n\n",
        ).alias("text")
    )
