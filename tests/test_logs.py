"""Log operators against plain Python on skewed random logs."""

import random

import pytest
from pyspark.sql import functions as F

from webtrawl.functions.breaker_rules import Breaker, Limits, advance, step, tabulate
from webtrawl.operators import fetchlog as fl
from webtrawl.operators import requests as rq
from webtrawl.operators import resilience as rs
from webtrawl.plans.chains import anchored_starts
from webtrawl.plans.hotkeys import SLICE, running_totals, with_slices


def skewed(n, seed, span=20_000):
    """(key, id, ms, ok): one key has about a third of all rows; times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(5)}"
        rows.append((key, i, rng.randrange(span), rng.random() < 0.6))
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("slice_rows", [20, 10**6])
def test_running_totals(spark, slice_rows):
    rows = skewed(600, 1)
    df = spark.createDataFrame(rows, "k string, id long, ms long, ok boolean")
    got = running_totals(df, ["k"], "ms", "id", {"n": F.lit(1), "s": F.col("id")}, slice_rows)
    want = set()
    for group in by_key(rows).values():
        total = 0
        for n, row in enumerate(group, 1):
            total += row[1]
            want.add((row[1], n, total))
    assert {(r.id, r.n, r.s) for r in got.collect()} == want


@pytest.mark.parametrize("slice_rows", [15, 10**6])
@pytest.mark.parametrize("window", [1, 40, 700, 5000])
def test_anchored_starts(spark, slice_rows, window):
    rows = skewed(500, window)
    df = spark.createDataFrame(rows, "k string, id long, ms long, ok boolean")
    want = set()
    for key, group in by_key(rows).items():
        start = None
        for row in group:
            if start is None or row[2] - start > window:
                start = row[2]
            want.add((key, row[2], start))
    got = {tuple(r) for r in anchored_starts(df, "k", "ms", window, slice_rows).collect()}
    assert got == want


def test_breaker_tables_match_replay():
    rng = random.Random(9)
    for _ in range(300):
        limits = Limits(rng.randrange(1, 5), rng.randrange(1, 60), rng.randrange(1, 4))
        times = sorted(rng.randrange(200) for _ in range(rng.randrange(1, 40)))
        oks = [rng.random() < 0.5 for _ in times]
        table = tabulate(__import__("numpy").array(times), oks, limits)
        starts = [Breaker("CLOSED", f, 0, None) for f in range(limits.threshold)]
        starts += [Breaker("HALF_OPEN", 7, k, -5) for k in range(limits.half_open_max)]
        starts += [Breaker("OPEN", 9, 0, -rng.randrange(1, 80)) for _ in range(4)]
        for start in starts:
            end = Breaker(start.mode, start.failures, start.successes, start.last_failure)
            for at, ok in zip(times, oks):
                step(end, at, ok, limits)
            fast = advance(start, table, limits)
            assert (fast.mode, fast.failures, fast.last_failure) == (
                end.mode, end.failures, end.last_failure)
            if end.mode == "HALF_OPEN":
                assert fast.successes == end.successes


@pytest.mark.parametrize("slice_rows", [25, 10**6])
def test_circuit_breaker(spark, slice_rows):
    rows = skewed(700, 4)
    calls = spark.createDataFrame(rows, "name string, id long, ts_ms long, ok boolean")
    limits = Limits(3, 900, 2)
    want = set()
    for group in by_key(rows).values():
        b = Breaker()
        for _, call, at, ok in group:
            admitted = step(b, at, ok, limits)
            want.add((call, admitted, b.mode, b.failures, b.last_failure))
    replayed = rs.circuit_breaker(calls, 3, 900, 2, slice_rows)
    got = {(r.id, r.admitted, r.state, r.failure_count, r.last_failure) for r in replayed.collect()}
    assert got == want


def test_breaker_story():
    b, limits = Breaker(), Limits(3, 1000, 2)
    for at in (0, 1, 2):
        assert step(b, at, False, limits)
    assert b.mode == "OPEN" and not step(b, 500, True, limits)
    assert step(b, 1102, True, limits) and b.mode == "HALF_OPEN"
    assert step(b, 1103, True, limits) and b.mode == "CLOSED" and b.failures == 0
    for ok in (False, False, True):
        step(b, 2000, ok, limits)
    assert b.failures == 1


@pytest.mark.parametrize("slice_rows", [25, 10**6])
def test_shared_breaker(spark, slice_rows):
    rows = skewed(600, 8)
    calls = spark.createDataFrame(rows, "name string, id long, ts_ms long, ok boolean")
    want = set()
    for group in by_key(rows).values():
        fails, opened = 0, None
        for _, call, at, ok in group:
            if opened is not None and at >= opened + 500:
                opened = None
            admitted = opened is None
            if admitted and not ok:
                fails += 1
                opened = at if fails >= 4 else None
            want.add((call, admitted, "CLOSED" if opened is None else "OPEN", fails))
    got = rs.shared_breaker(calls, 4, 500, slice_rows)
    assert {(r.id, r.admitted, r.state, r.failure_count) for r in got.collect()} == want


def test_retry_delays(spark):
    df = spark.range(6).select(rs.retry_delay_ms(F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [1000, 2000, 4000, 8000, 16000, 30000]
    dead = spark.createDataFrame([("u", 5)], "url string, timestamp long")
    assert [r.retry_at for r in rs.retry_schedule(dead).orderBy("attempt").collect()] == [
        1005, 3005, 7005]
    jittered = rs.retry_schedule(dead, jitter_seed=3).collect()
    assert all(500 * 2**r.attempt <= r.delay_ms <= 1000 * 2**r.attempt for r in jittered)


def test_sliding_limit(spark):
    rows = [(i, "c", ms) for i, ms in enumerate([0, 10, 10, 10, 70])]
    df = spark.createDataFrame(rows, "request_id long, client string, ts_ms long")
    got = rq.sliding_rate_limit(df, 3, 60).orderBy("request_id").collect()
    assert [(r.in_window, r.allowed) for r in got] == [
        (1, True), (2, True), (3, True), (4, False), (1, True)]


@pytest.mark.parametrize("search,limit", [(False, 100), (True, 30)])
def test_anchored_limit_refuses_the_next_request(spark, search, limit):
    rows = [(i, "c", i, search) for i in range(limit + 1)]
    df = spark.createDataFrame(rows, "request_id long, client string, ts_ms long, is_search boolean")
    got = {r.request_id: r for r in rq.anchored_rate_limit(df).collect()}
    assert all(got[i].allowed for i in range(limit)) and not got[limit].allowed
    assert got[limit].retry_after_s == 60


def test_auto_block_and_stats(spark):
    rows = [(i, "bad.com", i, i == 0, 10) for i in range(25)] + [(99, "ok.com", 5, True, 30)]
    log = spark.createDataFrame(
        rows, "attempt_id long, domain string, ts_ms long, ok boolean, fetch_ms long")
    for limit in (4, 10**6):
        assert [tuple(r) for r in fl.auto_blocklist(log, slice_rows=limit).collect()] == [
            ("bad.com", 19)]
    stats = fl.crawl_stats(log).first()
    assert (stats.success, stats.fail, stats.avg_latency_ms) == (2, 24, 140.0)
    empty = fl.crawl_stats(log.limit(0)).first()
    assert empty.error_pct == 0 and empty.rate == 0
    one = spark.createDataFrame([(80, 20)], "success long, fail long")
    pct, level, ratio = one.select(
        fl.error_pct("success", "fail"), fl.severity(fl.error_pct("success", "fail")),
        fl.fail_per_success("success", "fail")).first()
    assert (pct, level, ratio) == (20.0, "amber", 0.25)
    budget = fl.error_budget(one).first()
    assert abs(budget.budget_minutes - 43.8) < 1e-9 and budget.availability_pct == 80.0


def test_sessions_and_alerts(spark):
    times = [0, 90, 180, 400, 1000, 1050]
    rows = [(t, f"d{i % 2}", i % 3 > 0) for i, t in enumerate(times)]
    log = spark.createDataFrame(rows, "ts_ms long, domain string, ok boolean")
    got = [(r.started_at, r.ended_at, r.pages_crawled, r.errors, r.domains, r.status)
           for r in fl.crawl_sessions(log, 100, now_ms=1100).orderBy("id").collect()]
    assert got == [(0, 180, 2, 1, 2, "finished"), (400, 400, 0, 1, 1, "finished"),
                   (1000, 1050, 2, 0, 2, "running")]
    values = [(0, .4), (60, .5), (120, .2), (180, .4), (480, .9), (540, .9), (600, .1)]
    samples = spark.createDataFrame(
        [("HighErrorRate", t * 1000, x) for t, x in values], "alert string, ts_ms long, value double")
    firing = fl.alert_for(fl.alert_conditions(samples)).collect()
    assert [(r.since, r.firing_at, r.until) for r in firing] == [(180_000, 480_000, 540_000)]


def test_counter_rate_with_reset(spark):
    rows = [("c", t * 1000, v) for t, v in [(0, 0.), (60, 30.), (120, 90.), (180, 10.), (500, 20.)]]
    df = spark.createDataFrame(rows, "name string, ts_ms long, value double")
    got = {r.ts_ms: r.rate for r in fl.counter_rate(df).collect()}
    assert got == {0: None, 60000: 0.5, 120000: 0.75, 180000: 100 / 180, 500000: None}


def test_rolling_history(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "window_ms long, x double")
    last = fl.rolling_history(df, ["x"]).orderBy(F.desc("window_ms")).first()
    assert last.x_history == [float(i % 7) for i in range(40, 100)] and last.x_max == 6.0


def test_latency(spark):
    rows = [("search", i) for i in range(1, 101)] + [("page", 900)]
    df = spark.createDataFrame(rows, "kind string, duration_ms long")
    got = {r.kind: r for r in rq.latency_percentiles(df).collect()}
    assert abs(got["search"].p95 - 95.05) < 1e-9 and got["search"].met and not got["page"].met


def test_small_slices_take_few_tasks(spark):
    calls = spark.range(4000).select(F.lit("a").alias("name"), "id", F.col("id").alias("ts_ms"), (F.col("id") % 3 > 0).alias("ok"))
    cut = with_slices(calls, ["name"], "ts_ms", 20, "id")
    sizes = [r["count"] for r in cut.groupBy(SLICE).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 20
    files = [f for f in cut.inputFiles() if "/slices-" in f]
    assert 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = cut.groupBy(SLICE).agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy(SLICE).collect()
    assert all(a.high < b.low for a, b in zip(ends, ends[1:]))


def test_a_busy_breaker_is_cut_by_default(spark, monkeypatch):
    seen = []
    real = rs.with_slices
    monkeypatch.setattr(rs, "with_slices", lambda df, keys, ms, n, *a: seen.append(n) or real(df, keys, ms, n, *a))
    rs.circuit_breaker(spark.createDataFrame([("a", 1, 1, True)], "name string, id long, ts_ms long, ok boolean"))
    assert seen == [100_000]


def test_unknown_values_give_the_same_in_slices(spark):
    rows = [("a" if i % 4 else "b", i, i * 7, None if i % 5 == 0 else i % 3 > 0) for i in range(200)]
    calls = spark.createDataFrame(rows, "name string, id long, ts_ms long, ok boolean")
    amount = {"n": (~F.col("ok")).cast("long")}
    cut, one = (sorted(running_totals(calls, ["name"], "ts_ms", "id", amount, n).select("id", "n").collect()) for n in (4, 10**6))
    assert cut == one
    cut, one = (sorted(map(str, rs.circuit_breaker(calls, 3, 50, 2, n).collect())) for n in (20, 10**6))
    assert cut == one
