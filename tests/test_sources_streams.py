"""Messages, metrics, snapshots and multi-batch streams against their batch forms."""

import json
import random

from pyspark.sql import functions as F

from webtrawl import schemas
from webtrawl.operators import fetchlog as fl
from webtrawl.operators import requests as rq
from webtrawl.operators import resilience as rs
from webtrawl.plans.staging import new_folder
from webtrawl.sources import messages as ms
from webtrawl.sources import tables as st
from webtrawl.sources.metrics_text import render_metrics
from webtrawl.streaming import ingest, stateful, windows
from webtrawl.streaming.runs import read_file_stream, run_append, run_update


def test_messages(spark):
    rows = spark.createDataFrame([("https://en.wikipedia.org/a", 2, None)],
                                 "url string, depth int, parent string")
    sent = ms.to_url_messages(rows, 7).first()
    assert sent.partition == 2 and sent.key == "https://en.wikipedia.org/a"
    assert json.loads(sent.value) == {"url": sent.key, "depth": 2, "parent": None, "enqueuedAt": 7}
    raw = spark.createDataFrame(
        [("k1", '{"url":"u1"}'), ("k2", "{broken"), ("k3", '{"depth":3}'),
         ("k4", '{"url":"u4","depth":3,"parent":"p"}')], "key string, value string")
    good, dead = ms.split_dead_letters(raw, 9)
    assert {(r.url, r.depth, r.parent) for r in good.collect()} == {("u1", 0, None), ("u4", 3, "p")}
    assert {(r.url, r.error, r.timestamp) for r in dead.collect()} == {
        ("k2", "not JSON", 9), ("k3", "no url", 9)}
    assert json.loads(ms.to_dead_letters(dead).filter("key = 'k2'").first().value)["error"] == "not JSON"
    assert json.loads(ms.to_processed_messages(rows, 4).first().value)["processedAt"] == 4


def test_metrics_text(spark):
    stats = spark.createDataFrame([(10, 5, 80, 20, 20.0, 1.5, 12.4)],
                                  "node_count int, frontier_count int, success int, fail int, "
                                  "error_pct double, rate double, avg_latency_ms double")
    breakers = spark.createDataFrame([("db", "HALF_OPEN", 2), ("api", "OPEN", 3)],
                                     "name string, state string, failureCount int")
    text = render_metrics(stats, breakers, "m").first().text
    lines = text.split("\n")
    assert lines[:4] == ["# HELP m_nodes_total Total indexed nodes", "# TYPE m_nodes_total gauge",
                         "m_nodes_total 10", ""]
    for line in ["m_error_rate_pct 20.00", "m_pages_per_second 1.5000", "m_avg_fetch_latency_ms 12",
                 "m_circuit_api_state 1", "m_circuit_db_state 2", "m_circuit_db_failures 2",
                 "m_cpu_load 0"]:
        assert line in lines
    assert text.count("# TYPE") == 14 + 4


def test_snapshots_and_tables(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.createDataFrame([("u1",), ("u2",)], schemas.VISITED)
    for day in ("2024-01-01", "2024-01-05", "2024-01-09", "2024-01-09"):
        st.snapshot(df, path, day)
    kept = st.prune_snapshots(spark.read.parquet(path), "2024-01-10", 7)
    assert kept.count() == 4
    nodes = spark.createDataFrame([tuple([f"u{i}", "t"] + [None] * 12) for i in range(3)], schemas.NODES)
    st.write_nodes(nodes, str(tmp_path / "nodes"))
    assert st.read_table(spark, str(tmp_path / "nodes"), schemas.NODES).count() == 3
    site = tmp_path / "site"
    site.mkdir()
    (site / "a.html").write_text("<title>x</title>")
    (site / "a.txt").write_text("no")
    assert [r.body for r in st.read_page_files(spark, str(site)).collect()] == [b"<title>x</title>"]


def _parts(df, folder, column, cuts):
    """Write ``df`` as one file per time range, to be read one micro-batch each."""
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter((F.col(column) >= low) & (F.col(column) < high))
        part.coalesce(1).write.mode("append").parquet(folder)


def _log(spark):
    rng = random.Random(6)
    rows = [(i, f"d{rng.randrange(3)}", rng.randrange(90_000), rng.random() < 0.5, 10) for i in range(300)]
    log = spark.createDataFrame(rows, "id long, name string, ts_ms long, ok boolean, fetch_ms long")
    return log.withColumn("ts", F.timestamp_millis("ts_ms"))


def same(a, b, *columns):
    one, two = (sorted(map(tuple, d.select(*columns).collect()), key=str) for d in (a, b))
    assert one == two


def test_stateful_streams_over_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = _log(spark)
    _parts(log, folder, "ts_ms", [0, 30_000, 60_000, 100_000])
    read = lambda: read_file_stream(spark, folder, log.schema, files_per_batch=1)
    breaker = run_append(stateful.stream_circuit_breaker(read(), 3, 4000, 2), "b")
    same(breaker, rs.circuit_breaker(log, 3, 4000, 2), "id", "admitted", "state", "failure_count")

    renamed = lambda d: d.withColumnsRenamed({"id": "attempt_id", "name": "domain"})
    blocked = run_append(stateful.stream_auto_block(renamed(read()), 10, 0.4), "a")
    same(blocked, fl.auto_blocklist(renamed(log), 10, 0.4), "domain", "blocked_at")

    asked = lambda d: d.select(F.col("id").alias("request_id"), F.col("name").alias("client"),
                               "ts_ms", "ts", F.col("ok").alias("is_search"))
    sliding = run_append(stateful.stream_sliding_rate_limit(asked(read()), 4, 5000), "s")
    same(sliding, rq.sliding_rate_limit(asked(log), 4, 5000), "request_id", "in_window", "allowed")
    late = asked(read()).withWatermark("ts", "1 second")
    anchored = run_append(stateful.stream_anchored_rate_limit(late, 6, 2, 5000), "r")
    same(anchored, rq.anchored_rate_limit(asked(log), 6, 2, 5000),
         "request_id", "window_start", "count", "search_count", "allowed", "retry_after_s")


def test_window_streams_over_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = _log(spark)
    _parts(log, folder, "ts_ms", [0, 30_000, 60_000, 100_000])
    stream = read_file_stream(spark, folder, log.schema, files_per_batch=1)
    stats = run_update(windows.stream_crawl_stats(stream, "5 seconds", "2 minutes"), "w", ["window_ms"])
    same(stats, fl.crawl_stats(log, 5000), "window_ms", "success", "fail", "total_fetch_ms")
    stream = read_file_stream(spark, folder, log.schema, files_per_batch=1)
    urls = stream.select(F.col("name").alias("url"), "ts")
    assert run_append(windows.stream_dedup(urls), "d").count() == 3


def test_alert_stream_over_batches(spark, tmp_path):
    folder = str(tmp_path / "conds")
    rows = [("A", t * 1000, not 40 <= t < 50, 20_000) for t in range(0, 100, 5)]
    conds = spark.createDataFrame(rows, "alert string, ts_ms long, cond boolean, hold_ms long")
    _parts(conds, folder, "ts_ms", [0, 35_000, 60_000, 100_000])
    stream = read_file_stream(spark, folder, conds.schema, files_per_batch=1)
    same(run_append(stateful.stream_alerts(stream), "al"), fl.alert_for(conds),
         "alert", "since", "firing_at")


def test_frontier_ingest_over_batches(spark, tmp_path):
    folder = str(tmp_path / "msgs")
    texts = [['{"url":"a","depth":1,"enqueuedAt":1}', '{"url":"b"}', "oops"],
             ['{"url":"a","depth":9,"enqueuedAt":5}', '{"url":"c","enqueuedAt":6}']]
    for part in texts:
        spark.createDataFrame([("k", t) for t in part], "key string, value string").coalesce(
            1).write.mode("append").parquet(folder)
    stream = read_file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    frontier, dead = ingest.stream_frontier_ingest(stream, 3)
    got = sorted((r.url, r.depth) for r in frontier.collect())
    assert [u for u, _ in got] == ["a", "b", "c"] and got[0][1] in (1, 9)
    assert dead.count() == 1


def test_sessions_from_slots_equal_sessions_from_attempts(spark):
    """Pauses of exactly the gap, one busy domain, several small files in the stream."""
    rng = random.Random(4)
    rows = [("busy", 1_000 + 7 * i, i % 3 > 0) for i in range(3000)]
    rows += [(f"d{i % 5}", 60_000 * rng.randrange(200), i % 2 > 0) for i in range(150)]
    rows += [("even", 600_000 * i, True) for i in range(5)]
    log = spark.createDataFrame(rows, "domain string, ms long, ok boolean").selectExpr("domain", "timestamp_millis(ms) AS ts", "ok")
    want = {}
    for domain in {r[0] for r in rows}:
        times = sorted((ms, ok) for d, ms, ok in rows if d == domain)
        open_at = None
        for ms, ok in times:
            if open_at is None or ms - last > 600_000:  # noqa: F821
                open_at = ms
                want[domain, open_at] = [0, 0, 0]
            last = ms
            entry = want[domain, open_at]
            entry[0], entry[1], entry[2] = ms + 600_000, entry[1] + ok, entry[2] + (not ok)
    folder = new_folder(spark, "log")
    log.repartition(4).write.parquet(folder)
    stream = read_file_stream(spark, folder, log.schema, files_per_batch=2)
    late = run_update(windows.session_slots(stream, "10 minutes", "30 days"), "slots", ["domain", "slot_ms"])
    for slots in (windows.session_slots(log, "10 minutes"), late):
        got = {(r.domain, r.started_at): [r.closes_at, r.success, r.fail] for r in windows.sessions_of_slots(slots, 600_000).collect()}
        assert got == want
