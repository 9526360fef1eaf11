"""Windowed statistics of fetch-log streams. Rows later than the watermark are dropped."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.operators.fetchlog import error_pct, fail_per_success


def _counts(windowed) -> DataFrame:
    return windowed.agg(
        F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("fail"),
        F.sum("fetch_ms").alias("total_fetch_ms"),
    )


def stream_crawl_stats(
    log: DataFrame, width: str = "5 seconds", lateness: str = "1 minute"
) -> DataFrame:
    """Successes, failures, fetch time and error % per tumbling window."""
    counts = _counts(log.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w")))
    return counts.select(
        F.unix_millis("w.start").alias("window_ms"), "success", "fail", "total_fetch_ms",
        error_pct("success", "fail").alias("error_pct"),
    )


def stream_error_ratio(
    log: DataFrame, width: str = "5 minutes", slide: str = "15 seconds", lateness: str = "1 minute"
) -> DataFrame:
    """Failures per success over sliding windows."""
    counts = _counts(
        log.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide).alias("w"))
    )
    return counts.select(
        F.unix_millis("w.start").alias("window_ms"), "success", "fail",
        fail_per_success("success", "fail").alias("ratio"),
    )


def session_stats(log: DataFrame, gap: str, lateness: str = "1 minute") -> DataFrame:
    """Crawl sessions per domain, for a batch or a stream."""
    source = log.withWatermark("ts", lateness) if log.isStreaming else log
    counts = _counts(source.groupBy("domain", F.session_window("ts", gap).alias("w")))
    return counts.select(
        "domain", F.unix_millis("w.start").alias("started_at"),
        F.unix_millis("w.end").alias("closes_at"), "success", "fail",
    )


def session_slots(log: DataFrame, gap: str, lateness: str = "1 minute") -> DataFrame:
    """First and last attempt and the outcomes per domain and slot of ``gap`` length, for a batch or
    a stream. Attempts of one slot always share a session, so these rows are all that sessions need.
    A busy domain's state is spread over its slots, and tasks count their part of a slot first."""
    source = log.withWatermark("ts", lateness) if log.isStreaming else log
    slots = source.groupBy("domain", F.window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("fail"),
    )
    return slots.select("domain", F.unix_millis("w.start").alias("slot_ms"), "first_at", "last_at", "success", "fail")


def sessions_of_slots(slots: DataFrame, gap_ms: int) -> DataFrame:
    """The sessions of ``session_stats`` from slots. A domain has one row per used slot here, which
    the time span bounds, not the attempts."""
    in_time = W.partitionBy("domain").orderBy("slot_ms")
    pause = F.unix_micros("first_at") - F.lag(F.unix_micros("last_at")).over(in_time)
    first = F.when(pause <= gap_ms * 1000, 0).otherwise(1)
    numbered = slots.withColumn("_first_", first).withColumn("_session_", F.sum("_first_").over(in_time))
    return numbered.groupBy("domain", "_session_").agg(
        F.unix_millis(F.min("first_at")).alias("started_at"), (F.unix_millis(F.max("last_at")) + gap_ms).alias("closes_at"),
        F.sum("success").alias("success"), F.sum("fail").alias("fail"),
    ).drop("_session_")


def stream_dedup(urls: DataFrame, ts: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """The first row of each url; urls are remembered for the length of ``horizon``."""
    return urls.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["url"])
