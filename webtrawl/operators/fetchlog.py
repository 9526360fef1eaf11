"""Crawl statistics, service levels, auto-blocks and alerts from a log of fetch attempts.

Logs carry ``ts_ms`` (epoch milliseconds, BIGINT); ``with_ms`` adds it to a TIMESTAMP log.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.functions.urls import get_origin
from webtrawl.plans.hotkeys import SLICE_ROWS, running_totals
from webtrawl.settings import (
    ALERT_RULES,
    AVAILABILITY_TARGET,
    BLOCK_MIN_TOTAL,
    BLOCK_RATIO,
    MINUTES_PER_MONTH,
    SLO_TARGETS,
)


def with_ms(log: DataFrame, ts: str = "ts") -> DataFrame:
    return log.withColumn("ts_ms", F.unix_millis(ts))


def error_pct(ok, fail) -> Column:
    """Failed share in percent, 0 when nothing was tried."""
    ok, fail = F.col(ok), F.col(fail)
    return F.coalesce(fail * 100.0 / F.nullif(ok + fail, F.lit(0)), F.lit(0.0))


def severity(pct) -> Column:
    pct = F.col(pct) if isinstance(pct, str) else pct
    return F.when(pct > 20, "red").when(pct > 10, "amber").otherwise("green")


def fail_per_success(ok, fail) -> Column:
    """The alert form of the error ratio; null when nothing succeeded."""
    return F.col(fail) * 1.0 / F.nullif(F.col(ok), F.lit(0))


def _counters() -> list[Column]:
    return [
        F.count_if("ok").alias("success"),
        F.count_if(~F.col("ok")).alias("fail"),
        F.sum("fetch_ms").alias("total_fetch_ms"),
    ]


def crawl_stats(log: DataFrame, window_ms: int | None = None) -> DataFrame:
    """Successes, failures, total fetch ms, pages per second, error % and average latency.

    One row per window of ``window_ms`` (rate over the window), or one row for the whole
    log (rate over its span). All fetch time counts, failures included.
    """
    if window_ms is None:
        stats = log.agg(*_counters(), F.min("ts_ms").alias("_lo_"), F.max("ts_ms").alias("_hi_"))
        seconds = (F.col("_hi_") - F.col("_lo_")) / 1000.0
        key = []
    else:
        start = (F.floor(F.col("ts_ms") / window_ms) * window_ms).alias("window_ms")
        stats = log.groupBy(start).agg(*_counters())
        seconds = F.lit(window_ms / 1000.0)
        key = ["window_ms"]
    return stats.select(
        *key,
        "success",
        "fail",
        "total_fetch_ms",
        F.coalesce(F.col("success") / F.nullif(seconds, F.lit(0.0)), F.lit(0.0)).alias("rate"),
        error_pct("success", "fail").alias("error_pct"),
        avg_latency("total_fetch_ms", "success").alias("avg_latency_ms"),
    )


def avg_latency(total_ms, ok) -> Column:
    return F.coalesce(F.col(total_ms) / F.nullif(F.col(ok), F.lit(0)), F.lit(0.0))


def avg_fetch_latency(log: DataFrame) -> DataFrame:
    totals = log.agg(*_counters())
    return totals.select(avg_latency("total_fetch_ms", "success").alias("avg_latency_ms"))


def domains_checked(log: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct origins seen; the approximate form keeps one sketch per task."""
    origin = get_origin("url")
    count = F.approx_count_distinct(origin) if approximate else F.count_distinct(origin)
    return log.agg(count.alias("domains_checked"))


def domain_stats(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Per stored or tried domain: pages, last crawl, average response ms, error rate."""
    pages = nodes.groupBy("domain").agg(
        F.count("*").alias("pages_crawled"), F.max("crawled_at").alias("last_crawled_at")
    )
    tries = log.groupBy("domain").agg(
        F.avg("fetch_ms").alias("avg_response_time_ms"),
        F.avg((~F.col("ok")).cast("double")).alias("error_rate"),
    )
    return pages.join(tries, "domain", "full_outer").select(
        "domain",
        F.coalesce("pages_crawled", F.lit(0)).alias("pages_crawled"),
        "last_crawled_at",
        F.coalesce("avg_response_time_ms", F.lit(0.0)).alias("avg_response_time_ms"),
        F.coalesce("error_rate", F.lit(0.0)).alias("error_rate"),
    )


def crawl_sessions(log: DataFrame, gap_ms: int, now_ms: int | None = None) -> DataFrame:
    """Crawl sessions: attempts with no pause longer than ``gap_ms`` between them.

    Two attempts in one slot of ``gap_ms`` always share a session, so only one row per used
    slot (bounded by the time span, not by the attempts) is put in order; the distinct
    domains come from a join of slots back to sessions. ``status`` is ``running`` for a
    session still within the gap of ``now_ms``.
    """
    slot = F.floor(F.col("ts_ms") / gap_ms).alias("_slot_")
    slots = log.groupBy(slot).agg(
        F.min("ts_ms").alias("_lo_"), F.max("ts_ms").alias("_hi_"),
        F.count_if("ok").alias("_ok_"), F.count_if(~F.col("ok")).alias("_fail_"),
    )
    in_time = W.orderBy("_slot_")
    pause = F.col("_lo_") - F.lag("_hi_").over(in_time)
    first = F.when(pause <= gap_ms, 0).otherwise(1)
    numbered = slots.withColumn("_first_", first).withColumn(
        "id", F.sum("_first_").over(in_time)
    )
    sums = numbered.groupBy("id").agg(
        F.min("_lo_").alias("started_at"), F.max("_hi_").alias("ended_at"),
        F.sum("_ok_").alias("pages_crawled"), F.sum("_fail_").alias("errors"),
    )
    domains = (
        log.select(slot, "domain").distinct()
        .join(numbered.select("_slot_", "id"), "_slot_")
        .groupBy("id").agg(F.count_distinct("domain").alias("domains"))
    )
    running = F.lit(False) if now_ms is None else (F.lit(now_ms) - F.col("ended_at") <= gap_ms)
    return sums.join(domains, "id").select(
        "id", "started_at", "ended_at", "pages_crawled", "errors", "domains",
        F.when(running, "running").otherwise("finished").alias("status"),
    )


def availability_sli(stats: DataFrame) -> DataFrame:
    ok, fail = F.col("success"), F.col("fail")
    share = F.coalesce(ok * 100.0 / F.nullif(ok + fail, F.lit(0)), F.lit(100.0))
    return stats.withColumn("availability_pct", share)


def error_budget(
    stats: DataFrame, target: float = AVAILABILITY_TARGET, minutes: int = MINUTES_PER_MONTH
) -> DataFrame:
    """Budget minutes of the period, the minutes spent by the measured availability, the rest."""
    budget = minutes * (100.0 - target) / 100.0
    spent = F.lit(float(minutes)) * (100.0 - F.col("availability_pct")) / 100.0
    return availability_sli(stats).select(
        "availability_pct",
        F.lit(budget).alias("budget_minutes"),
        spent.alias("spent_minutes"),
        (F.lit(budget) - spent).alias("remaining_minutes"),
    )


def slo_report(stats: DataFrame, nodes: DataFrame, now_ms=None, targets=None) -> DataFrame:
    """One row per objective: measured value, target and whether it is met.

    ``stats`` is one ``crawl_stats`` row. Freshness is the age of the oldest page at
    ``now_ms`` (default: the newest crawl time).
    """
    now = F.max("crawled_at") if now_ms is None else F.lit(now_ms)
    age = nodes.agg(((now - F.min("crawled_at")) / 3_600_000.0).alias("age"))
    measured = availability_sli(stats).select(
        F.explode(
            F.array(
                F.struct(F.lit("availability_pct").alias("slo"),
                         F.col("availability_pct").alias("value")),
                F.struct(F.lit("error_rate_pct").alias("slo"), F.col("error_pct").alias("value")),
                F.struct(F.lit("pages_per_second").alias("slo"), F.col("rate").alias("value")),
            )
        ).alias("_m_")
    ).select("_m_.*").unionByName(
        age.select(F.lit("freshness_hours").alias("slo"), F.col("age").alias("value"))
    )
    spark = stats.sparkSession
    goal = spark.createDataFrame(
        targets or SLO_TARGETS, "slo string, comparison string, target double"
    )
    value, target = F.col("value"), F.col("target")
    met = (
        F.when(F.col("comparison") == ">=", value >= target)
        .when(F.col("comparison") == ">", value > target)
        .when(F.col("comparison") == "<", value < target)
        .otherwise(value <= target)
    )
    return measured.join(F.broadcast(goal), "slo").select("slo", "value", "target", met.alias("met"))


def trips_block(total, fails, min_total: int = BLOCK_MIN_TOTAL, ratio: float = BLOCK_RATIO) -> Column:
    """Whether a failure with these running counts blocks its domain."""
    return (total >= min_total) & (fails / total > ratio)


def block_times(
    log: DataFrame,
    min_total: int = BLOCK_MIN_TOTAL,
    ratio: float = BLOCK_RATIO,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every failure at which a domain is over the failure ratio, with the running counts."""
    totals = running_totals(
        log.select("domain", "attempt_id", "ts_ms", "ok"),
        ["domain"], "ts_ms", "attempt_id",
        {"total": F.lit(1).cast("long"), "fails": (~F.col("ok")).cast("long")},
        slice_rows,
    )
    return totals.filter(~F.col("ok") & trips_block(F.col("total"), F.col("fails"), min_total, ratio))


def auto_blocklist(
    log: DataFrame,
    min_total: int = BLOCK_MIN_TOTAL,
    ratio: float = BLOCK_RATIO,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Domains blocked for good, with the time of the failure that tripped the rule."""
    return (
        block_times(log, min_total, ratio, slice_rows)
        .groupBy("domain")
        .agg(F.min("ts_ms").alias("blocked_at"))
    )


def domains_blocked(
    log: DataFrame, min_total: int = BLOCK_MIN_TOTAL, ratio: float = BLOCK_RATIO
) -> DataFrame:
    return auto_blocklist(log, min_total, ratio).agg(F.count("*").alias("domains_blocked"))


# ------------------------------------------------------------------- sampled series
#
# The operators below take samples of a series: one row per tick, bounded by the time span
# and the tick length, whatever the number of log rows behind them.


def rolling_history(
    samples: DataFrame, values: list[str], n: int = 60, series=(), at: str = "window_ms"
) -> DataFrame:
    """For each sample the last ``n`` values of each column, and their maximum for the chart."""
    last = W.partitionBy(*[F.col(s) for s in series]).orderBy(at).rowsBetween(-(n - 1), 0)
    out = samples
    for v in values:
        out = out.withColumn(f"{v}_history", F.collect_list(v).over(last)).withColumn(
            f"{v}_max", F.max(v).over(last)
        )
    return out


def counter_rate(
    samples: DataFrame, range_ms: int = 300_000, series: str = "name", at: str = "ts_ms",
    value: str = "value",
) -> DataFrame:
    """Per-second increase of a counter over the trailing range, counter resets included.

    The increase between the first and the last sample inside ``(t - range, t]`` over their
    distance in time; null with fewer than two samples. Work is cut into range-long slots:
    a slot also gets the samples of the slot before it, so a long series is many tasks.
    """
    slot = F.floor(F.col(at) / range_ms)
    ordered = W.partitionBy(series, "_slot_").orderBy(at)
    trailing = W.partitionBy(series, "_slot_").orderBy(at).rangeBetween(-(range_ms - 1), 0)
    copies = samples.select(
        "*", slot.alias("_own_"), F.explode(F.array(slot, slot + 1)).alias("_slot_")
    )
    step = F.col(value) - F.lag(value).over(ordered)
    grown = F.when(step < 0, F.col(value)).otherwise(F.coalesce(step, F.lit(0.0)))
    rated = copies.withColumn("_step_", grown).withColumn(
        "_rise_", F.sum("_step_").over(trailing) - F.first("_step_").over(trailing)
    ).withColumn("_since_", F.col(at) - F.first(at).over(trailing))
    rate = F.col("_rise_") * 1000.0 / F.nullif(F.col("_since_"), F.lit(0))
    return rated.filter(F.col("_own_") == F.col("_slot_")).select(
        *samples.columns, rate.alias("rate")
    )


def alert_conditions(samples: DataFrame, rules=None) -> DataFrame:
    """``(alert, ts_ms, value, firing condition, hold_ms)`` for samples named by alert."""
    table = samples.sparkSession.createDataFrame(
        rules or ALERT_RULES, "alert string, comparison string, bound double, seconds long"
    )
    value, bound = F.col("value"), F.col("bound")
    cond = (
        F.when(F.col("comparison") == ">", value > bound)
        .when(F.col("comparison") == "<", value < bound)
        .otherwise(value == bound)
    )
    return samples.join(F.broadcast(table), "alert").select(
        "alert", "ts_ms", "value", F.coalesce(cond, F.lit(False)).alias("cond"),
        (F.col("seconds") * 1000).alias("hold_ms"),
    )


def alert_for(conditions: DataFrame) -> DataFrame:
    """Stretches in which a condition held without a break for its hold time.

    One row per alert stretch: ``since`` (first true sample), ``firing_at`` (first sample at
    which the hold time is reached) and ``until`` (last true sample).
    """
    ordered = W.partitionBy("alert").orderBy("ts_ms")
    changes = conditions.withColumn(
        "_new_",
        F.when(F.col("cond") == F.coalesce(F.lag("cond").over(ordered), ~F.col("cond")), 0)
        .otherwise(1),
    ).withColumn("_island_", F.sum("_new_").over(ordered))
    held = changes.filter("cond").withColumn(
        "since", F.min("ts_ms").over(W.partitionBy("alert", "_island_"))
    )
    reached = F.when(F.col("ts_ms") - F.col("since") >= F.col("hold_ms"), F.col("ts_ms"))
    return (
        held.groupBy("alert", "_island_")
        .agg(
            F.min("since").alias("since"),
            F.min(reached).alias("firing_at"),
            F.max("ts_ms").alias("until"),
        )
        .filter(F.col("firing_at").isNotNull())
        .drop("_island_")
    )
