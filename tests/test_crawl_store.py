"""Stored crawl tables: whole batches or nothing, repeated batches, untouched files; crawl rounds on them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webtrawl import schemas
from webtrawl.plans import crawl as cr
from webtrawl.plans.staging import new_folder
from webtrawl.sources import crawl_store as cs


def nodes(spark, *rows, orig=None):
    data = [(u, t, "", "d.com", d, None, 1, "", 1, "", "", "", 0, at) for u, t, d, at in rows]
    df = spark.createDataFrame(data, schemas.NODES)
    return df if orig is None else df.withColumn("origUrl", F.lit(orig) if isinstance(orig, str) else F.col("url"))


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def frontier(spark, *rows):
    return spark.createDataFrame([(i, u, d, "p") for i, u, d in rows], schemas.FRONTIER)


def shown(store):
    return (
        {r.url: (r.title, r.crawled_at) for r in store.nodes.collect()},
        sorted(r.url for r in store.visited.collect()),
        sorted((r.url, r.depth) for r in store.frontier.collect()),
    )


@pytest.fixture
def store(spark):
    return cs.create_store(
        spark, new_folder(spark, "store"), nodes(spark, ("a", "old", 0, 5), ("b", "old", 1, 5)), urls(spark, "a", "b"),
        frontier(spark, (1, "c", 1), (2, "d", 1), (3, "e", 1)), buckets=4,
    )


def test_a_batch_changes_all_tables(spark, store):
    saved = store.save_pages(nodes(spark, ("b", "new", 1, 7), ("c", "x", 1, 7), orig=True), 1)
    saved = saved.save_pages(nodes(spark, ("f", "x", 1, 7), orig="d"), 2)
    want = ({"a": ("old", 5), "b": ("new", 7), "c": ("x", 7), "f": ("x", 7)}, ["a", "b", "c", "d", "f"], [("e", 1)])
    assert shown(saved) == want
    assert shown(saved.save_pages(nodes(spark, ("z", "z", 0, 9), orig=True), 2)) == want  # committed before
    older = saved.save_pages(nodes(spark, ("b", "late", 1, 6), orig=True), 3)
    assert shown(older) == want
    assert shown(cs.open_store(spark, store.path, 1))[2] == [("c", 1), ("d", 1), ("e", 1)]


def test_a_failure_between_two_writes_leaves_the_old_state(spark, store, monkeypatch):
    before = shown(store)
    write, written = cs.CrawlStore._part, []

    def failing(self, name, rows):
        if name == "visited":
            raise RuntimeError("lost")
        written.append(name)
        return write(self, name, rows)

    monkeypatch.setattr(cs.CrawlStore, "_part", failing)
    with pytest.raises(RuntimeError):
        store.save_pages(nodes(spark, ("c", "x", 1, 7), orig=True), 1)
    monkeypatch.undo()
    assert written == ["nodes"]
    assert shown(cs.open_store(spark, store.path)) == before
    again = cs.open_store(spark, store.path).save_pages(nodes(spark, ("c", "x", 1, 7), orig=True), 1)
    assert "c" in shown(again)[0] and "c" in shown(again)[1]
    with pytest.raises(Exception):  # another writer of the same version
        store.save_pages(nodes(spark, ("d", "x", 1, 7), orig=True), 9)
    assert shown(cs.open_store(spark, store.path)) == shown(again)


def test_links_come_back_to_the_frontier_after_a_fetch(spark, store):
    saved = store.save_pages(nodes(spark, ("c", "x", 1, 7), orig=True), 1)
    added = saved.add_links(frontier(spark, (9, "c", -1), (10, "g", 2), (11, "g", 3)), 2)
    assert shown(added)[2] == [("c", -1), ("d", 1), ("e", 1), ("g", 2)]
    done = added.save_pages(nodes(spark, ("c", "y", 1, 8), ("g", "g", 2, 8), orig=True), 3)
    assert shown(done)[2] == [("d", 1), ("e", 1)] and shown(done)[0]["c"] == ("y", 8)


def test_only_touched_buckets_are_written_and_full_ones_compacted(spark, store, monkeypatch):
    monkeypatch.setattr(cs, "MAX_PARTS", 2)
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(store.path).rglob("part-*") if "versions" not in str(p)}
    first, now = files(), store
    for n in range(3):
        held = len([p for p in now.parts if p[0] == "nodes"])
        now = now.save_pages(nodes(spark, ("b", f"t{n}", 1, 10 + n), orig=True), n)
        assert len({b for t, b, f in now.parts if t == "nodes" and f not in {p[2] for p in store.parts}}) == 1
        assert len([p for p in now.parts if p[0] == "nodes"]) <= held + 1
    assert all(files()[p] == at for p, at in first.items())  # nothing is written over
    bucket = now._bucketed(urls(spark, "b")).first().bucket
    assert len([p for p in now.parts if p[0] == "nodes" and p[1] == bucket]) <= 2
    others = {p for p in store.parts if p[0] == "nodes" and p[1] != bucket}
    assert others <= set(now.parts)
    assert shown(now)[0] == {"a": ("old", 5), "b": ("t2", 12)}
    assert shown(now)[1] == ["a", "b"]


# ------------------------------------------------------------------------------ crawl rounds


def pages(spark, links):
    rows = [(u, "".join(f'<a href="{x}">' for x in out)) for u, out in links.items()]
    return spark.createDataFrame(rows, "url string, html string")


def seeds(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "id long, url string")


def test_rounds_read_no_bodies_and_do_not_shuffle_pages(spark):
    links = {f"https://h{i}.com/": [f"https://h{j}.com/" for j in (2 * i + 1, 2 * i + 2) if j < 40] for i in range(40)}
    tables = cr.page_tables(pages(spark, links), buckets=8)
    assert "html" not in tables.records.columns + tables.links.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        batch = cr.start_state(spark, seeds(spark, "https://h0.com/")).frontier
        joined = batch.withColumnRenamed("url", "origUrl").join(tables.records.withColumnRenamed("url", "origUrl"), "origUrl", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # only the batch moves
    state = cr.crawl_bfs(tables, seeds(spark, "https://h0.com/"))
    assert {r.url: r.depth for r in state.nodes.collect()} == {f"https://h{i}.com/": (i + 1).bit_length() - 1 for i in range(40)}


def test_failing_domains_are_blocked_from_the_next_round_on(spark):
    links = {"https://a.com/": [f"https://bad.com/{i}" for i in range(25)] + ["https://a.com/1"], "https://a.com/1": ["https://bad.com/x", "https://a.com/2"],
             "https://a.com/2": ["https://bad.com/y"]}
    tables = cr.page_tables(pages(spark, links))
    rules = cr.CrawlRules(block_failing=(20, 0.9))
    state = cr.crawl_bfs(tables, seeds(spark, "https://a.com/"), rules)
    tried = {r.origUrl for r in state.attempts.collect()}
    assert "https://bad.com/24" in tried and not {"https://bad.com/x", "https://bad.com/y"} & tried
    got = {r.domain: (r.total, r.fails, r.blocked) for r in state.outcomes.collect()}
    assert got == {"a.com": (3, 0, False), "bad.com": (25, 25, True)}
    free = cr.crawl_bfs(tables, seeds(spark, "https://a.com/"))
    assert "https://bad.com/y" in {r.origUrl for r in free.attempts.collect()}


def test_redirects_inside_rounds(spark):
    links = {"https://a.com/": ["https://b.com/old", "https://c.com/"], "https://b.com/new": ["https://d.com/"], "https://c.com/": ["https://b.com/new"], "https://d.com/": []}
    redirects = spark.createDataFrame([("https://b.com/old", "https://b.com/new")], "url string, final string")
    state = cr.crawl_bfs(cr.page_tables(pages(spark, links), redirects), seeds(spark, "https://a.com/"))
    found = {r.url: (r.depth, r.parent) for r in state.nodes.collect()}
    assert found == {"https://a.com/": (0, None), "https://b.com/new": (1, "https://a.com/"), "https://c.com/": (1, "https://a.com/"), "https://d.com/": (2, "https://b.com/new")}
    assert {r.url for r in state.visited.collect()} == set(found) | {"https://b.com/old"}
    assert {r.domain: r.c for r in state.counts.collect()} == {"a.com": 1, "b.com": 1, "c.com": 1, "d.com": 1}


# ------------------------------------------------------------------------------ slices


def test_a_burst_of_one_key_is_cut_evenly(spark):
    from webtrawl.plans.hotkeys import SLICE, running_totals, with_slices

    rows = spark.range(100_000).select(
        F.when(F.col("id") < 99_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.lit(1_000).cast("long").alias("ms"), F.col("id").alias("n"),
    )
    cut = with_slices(rows, ["k"], "ms", 1000, "n")
    sizes = [r["count"] for r in cut.filter("k = 'hot'").groupBy(SLICE).count().collect()]
    assert sum(sizes) == 99_000 and max(sizes) <= 2000 and len(sizes) > 80
    totals = running_totals(rows, ["k"], "ms", "n", {"c": F.lit(1).cast("long")}, 1000)
    assert totals.filter("k = 'hot' and c <> n + 1").count() == 0 and totals.count() == 100_000
