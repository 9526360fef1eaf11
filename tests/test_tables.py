"""Tables, frontier rules, graph and crawl rounds on literal rows."""

import random

from pyspark.sql import functions as F

from webtrawl import schemas
from webtrawl.operators import frontier as fr
from webtrawl.operators import graph as g
from webtrawl.operators import seeds as sd
from webtrawl.operators import tables as tb
from webtrawl.plans import crawl as cr
from webtrawl.plans.ranking import global_row_number, newest, ordered_ids


def node(url, domain, **more):
    base = dict.fromkeys(schemas.NODES.names)
    base.update(url=url, domain=domain, title="", depth=0, popularity=1, https=1, crawled_at=0)
    return tuple({**base, **more}[c] for c in schemas.NODES.names)


def nodes_df(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.NODES)


def test_upsert_and_insert_ignore(spark):
    old = nodes_df(spark, node("u", "a", title="old", crawled_at=5), node("v", "a", crawled_at=9))
    new = nodes_df(spark, node("u", "a", title="new", crawled_at=5), node("v", "a", title="x", crawled_at=1),
                   node("w", "a"))
    got = {r.url: r.title for r in tb.upsert_nodes(old, new).collect()}
    assert got == {"u": "new", "v": "", "w": ""}
    seen = spark.createDataFrame([("a", 1)], "url string, id long")
    more = spark.createDataFrame([("b", 3), ("b", 2), ("a", 4)], "url string, id long")
    assert sorted(map(tuple, tb.insert_ignore(seen, more, "url", ["id"]).collect())) == [
        ("a", 1), ("b", 2)]


def test_save_with_redirect(spark):
    empty = nodes_df(spark)
    visited = spark.createDataFrame([], schemas.VISITED)
    frontier = spark.createDataFrame([(1, "https://old.com", 0, None), (2, "https://z.com", 0, None)],
                                     schemas.FRONTIER)
    data = nodes_df(spark, node("https://new.com", "new.com")).withColumn(
        "origUrl", F.lit("https://old.com"))
    nodes, seen, rest = tb.save_pages(empty, visited, frontier, data)
    assert nodes.count() == 1
    assert {r.url for r in seen.collect()} == {"https://new.com", "https://old.com"}
    assert [r.url for r in rest.collect()] == ["https://z.com"]


def test_ranking(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1000), rng.randrange(10**7)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, ms long")
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    ranked = global_row_number(df, [F.col("k"), F.col("id")]).collect()
    assert sorted((r.rn, r.id) for r in ranked) == [(i + 1, r[0]) for i, r in enumerate(want)]
    ids = {r.id: r.n for r in ordered_ids(df, [F.col("k"), F.col("id")], "n").collect()}
    assert sorted(ids, key=ids.get) == [r[0] for r in want] and len(set(ids.values())) == 500
    for n in (1, 77, 600):
        got = [r.id for r in newest(df, "ms", "id", n, slot_ms=50_000).collect()]
        assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:n]]


def test_retain_latest_and_samples(spark):
    nodes = nodes_df(spark, *[node(f"u{i}", "d", crawled_at=i) for i in range(20)])
    visited = spark.createDataFrame([("u19",), ("u2",), ("other",)], schemas.VISITED)
    kept, seen = tb.retain_latest(nodes, visited, 5)
    assert {r.url for r in kept.collect()} == {f"u{i}" for i in range(15, 20)}
    assert [r.url for r in seen.collect()] == ["u19"]
    one, two = (sorted(r.url for r in tb.sample_recrawl(nodes, 4, s).collect()) for s in (1, 2))
    assert len(one) == 4 and one != two
    assert one == sorted(r.url for r in tb.sample_recrawl(nodes, 4, 1).collect())


def test_robots(spark):
    body = ("User-agent: *\nDisallow: /a\nUser-agent: bot\nDisallow: /b\nUSER-AGENT:  *\n"
            "Disallow:\n  disallow: /c d \r\nAllow: /c/x\nUser-agent: *\nUser-agent: z\nDisallow: /q\n")
    robots = spark.createDataFrame([("https://e.com", body), ("https://f.com", "Disallow: /x")],
                                   "origin string, body string")
    rules = fr.parse_robots(robots)
    assert sorted(map(tuple, rules.collect())) == [("https://e.com", "/a"), ("https://e.com", "/c d")]
    urls = spark.createDataFrame([(u,) for u in ["https://e.com/abc", "https://e.com/b", "https://f.com/a",
                                                "http://e.com/a"]], "url string")
    assert sorted(r.url for r in fr.filter_robots(urls, rules).collect()) == [
        "http://e.com/a", "https://e.com/b", "https://f.com/a"]
    assert [r.url for r in fr.robots_blocked(urls, rules).collect()] == ["https://e.com/abc"]


def test_frontier_rules(spark):
    rows = [(i, f"https://hot.com/{i}", 0, None) for i in range(50)]
    rows += [(100, "https://www.b.com/1", 0, None), (101, "bad", 0, None), (1, "https://c.x.com/", 0, None)]
    frontier = spark.createDataFrame(rows, schemas.FRONTIER)
    batch = fr.polite_batch(frontier, None, 2, None)
    assert sorted(r.id for r in batch.collect()) == [0, 1, 1, 100]
    assert [r.id for r in fr.polite_batch(frontier, None, 2, 2).collect()] == [0, 1]
    busy = spark.createDataFrame([("hot.com", 1)], "domain string, n long")
    assert sorted(r.id for r in fr.polite_batch(frontier, busy, 2, None).collect()) == [0, 1, 100]
    counts = spark.createDataFrame([("hot.com", 47), ("b.com", 50)], "domain string, c long")
    admitted = fr.admit_links(frontier, counts, "id", 50)
    assert sorted(r.id for r in admitted.collect()) == [0, 1, 1, 2, 101]
    assert 100 not in {r.id for r in fr.filter_domain_quota(frontier, counts, 50).collect()}
    listed = spark.createDataFrame([("x.com",), ("hot.com",)], "domain string")
    assert [r.url for r in fr.drop_blacklisted(frontier, listed).collect()] == ["https://www.b.com/1"]


def test_graph(spark):
    nodes = nodes_df(
        spark, node("p", "a", popularity=3), node("q", "a", parent="p"), node("r", "b", parent="p"),
        node("s", "b", parent="p"), node("t", "c", parent="r", popularity=2), node("z", "c", parent="gone"),
    )
    shown, edges, total = g.domain_graph(nodes)
    assert [r.url for r in shown.collect()] == ["p", "t", "r"]
    assert sorted(map(tuple, edges.collect())) == [("a", "b", 2), ("b", "c", 1)]
    assert total.first().total == 6
    assert sorted(r.url for r in g.domain_edges(nodes).collect()) == ["r", "s", "t"]
    near = [r.domain for r in g.ego_network(shown, edges, "a").collect()]
    assert near == ["a", "b"] and g.ego_network(shown, edges, None).count() == 3
    assert '"total":6,"domains":3' in g.graph_payload(shown, edges, total).first().payload
    assert g.graph_or_latest(nodes_df(spark))[0].count() == 0
    top = g.top_domains(nodes, 1)
    assert top.first().domain == "a"
    pops = g.with_popularity(nodes.drop("popularity"), top)
    assert {r.popularity for r in pops.filter("domain = 'a'").collect()} == {3}
    assert g.new_domains(nodes.filter("domain = 'a'"), nodes).count() == 2


def test_seeds(spark):
    topics = spark.createDataFrame([("History",), ("Tea",)], "topic string")
    assert sd.topic_urls(topics, ["en", "de"]).count() == 4
    pages = spark.createDataFrame([(i,) for i in range(40)], "page long")
    seeds = spark.createDataFrame([("https://a.com",), ("https://b.com",)], "url string")
    drawn = sd.sample_seeds(seeds, topics, pages, 10)
    assert drawn.count() == 2 + 2 + 10 + 10
    visited = spark.createDataFrame([("https://a.com",)], schemas.VISITED)
    frontier = spark.createDataFrame([], schemas.FRONTIER)
    added = sd.add_seeds(frontier, sd.merge_seed_pools(seeds, seeds), visited)
    assert [(r.url, r.depth) for r in added.collect()] == [("https://b.com", 0)]


def _bfs(links, root, max_depth=10):
    """Plain crawl in frontier order: (depth, parent) of every reached page."""
    found, queue, queued = {}, [(root, 0, None)], {root}
    while queue:
        url, depth, parent = queue.pop(0)
        if url not in links:
            continue
        found[url] = (depth, parent)
        for link in links[url]:
            if depth + 1 <= max_depth and link not in queued:
                queued.add(link)
                queue.append((link, depth + 1, url))
    return found


def test_crawl_matches_plain_crawl(spark):
    rng = random.Random(5)
    urls = [f"https://h{i % 7}.com/{i}" for i in range(40)]
    links = {u: [rng.choice(urls) for _ in range(rng.randrange(4))] for u in urls}
    links[urls[0]] += urls[1:9]
    html = {u: "".join(f'<a href="{x}">' for x in links[u]) for u in urls}
    pages = spark.createDataFrame(list(html.items()), "url string, html string")
    seeds = pages.filter(F.col("url") == urls[0])
    state = cr.crawl_bfs(pages, seeds, cr.CrawlRules())
    got = {r.url: (r.depth, r.parent) for r in state.nodes.collect()}
    assert got == _bfs(links, urls[0])
    polite = cr.crawl_bfs(pages, seeds, cr.CrawlRules(domain_limit=1), max_rounds=3)
    assert 0 < polite.nodes.count() <= 1 + 7 + 7
    edges = spark.createDataFrame(
        [(a, b) for a in urls for b in links[a]], "src string, dst string")
    reach = cr.reachable(edges, seeds.select(F.col("url").alias("id")))
    assert {r.id: r.depth for r in reach.collect()} == {u: d for u, (d, _) in got.items()}
