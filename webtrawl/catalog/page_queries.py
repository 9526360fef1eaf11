"""Registered queries over pages, links, the frontier and the domain graph."""

from pyspark.sql import functions as F

from webtrawl.catalog import views as v
from webtrawl.catalog.registry import query
from webtrawl.catalog.views import domain_sql, fields_sql, host_sql, origin_sql, with_views
from webtrawl.functions import urls as u
from webtrawl.functions.html import extract_links, parse_page
from webtrawl.operators import frontier as fr
from webtrawl.operators import graph as g
from webtrawl.operators import pages as pg
from webtrawl.operators import seeds as sd
from webtrawl.operators import tables as tb
from webtrawl.plans import crawl as cr
from webtrawl.plans.staging import new_folder
from webtrawl.settings import BLOCKLIST, SEED_LANGS
from webtrawl.sources.crawl_store import create_store

# ---------------------------------------------------------------- scalar URL rules

_HASH = f"""list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(
  string_split({host_sql('url')}, ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda a, c: (a * 31 + c) % 4294967296)"""


@query(
    "url_rules",
    f"""SELECT page_id, {host_sql('url')} AS host, {domain_sql('url')} AS domain,
  {origin_sql('url')} AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  CAST(starts_with(url, 'https') AS INTEGER) AS https,
  CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 6 AS INTEGER) AS part
FROM (SELECT *, {_HASH} AS h FROM pages)""",
)
def url_rules(spark, sf):
    return v.pages(spark, sf).select(
        "page_id", u.get_host("url").alias("host"), u.get_domain("url").alias("domain"),
        u.get_origin("url").alias("origin"), u.get_path("url").alias("path"),
        u.is_https("url").alias("https"), u.domain_partition("url").alias("part"),
    )


def _url_forms(spark, sf):
    """Each page's URL in other spellings, legal and illegal ones."""
    pages = v.pages(spark, sf).select("page_id", "url", u.get_host("url").alias("h"))
    n = F.col("page_id")
    form = lambda name, *parts: F.struct(F.lit(name).alias("form"), F.concat(*parts).alias("raw"))
    forms = F.array(
        form("plain", F.col("url")),
        form("slashes", F.lit("  HTTPS:\\\\"), F.upper("h"), F.lit("\\p")),
        form("user", F.lit("http:/u:p@x@"), F.col("h"), F.lit(":0081/")),
        form("lines", F.lit("ht\ntps://"), F.col("h"), F.lit(":443\t?q ")),
        form("percent", F.lit("http:%"), F.hex(F.substring("h", 1, 1)), F.substring("h", 2, 300)),
        form("ipv4", F.lit("http://0x7f."), (n % 256).cast("string"), F.lit("."), (n * 7 % 65536).cast("string"), F.lit("/")),
        form("ipv6", F.lit("ws://[::"), F.hex(n % 65535 + 1), F.lit(":0:0:1.2.3."), (n % 256).cast("string"), F.lit("]:8080")),
        form("other", F.lit("news://User@"), F.col("h"), F.lit(":119/x")),
        form("opaque", F.lit("mailto:a@"), F.col("h")),
        form("port", F.lit("https://"), F.col("h"), F.lit(":99999/")),
        form("letters", F.lit("https://"), F.col("h"), F.lit(":abc/")),
        form("blank", F.lit("https://a "), F.col("h")),
        form("five", F.lit("http://1.2.3.4."), (n % 256).cast("string")),
        form("octal", F.lit("http://"), F.col("h"), F.lit(".08/")),
    )
    return pages.select("page_id", F.explode(forms).alias("f")).select("page_id", "f.form", "f.raw")


@query(
    "standard_urls",
    f"""WITH p AS (SELECT page_id, url, {host_sql('url')} AS h FROM pages),
x AS (SELECT page_id, unnest(['plain', 'slashes', 'user', 'lines', 'percent', 'ipv4', 'ipv6', 'other', 'opaque', 'port', 'letters',
    'blank', 'five', 'octal']) AS form, url, h,
  '127.' || (page_id % 256) || '.' || (page_id * 7 % 65536) // 256 || '.' || (page_id * 7) % 256 AS v4,
  '[::' || printf('%x', page_id % 65535 + 1) || ':0:0:102:3' || printf('%02x', page_id % 256) || ']' AS v6 FROM p),
y AS (SELECT page_id, form, url, CASE WHEN form IN ('plain', 'slashes', 'user', 'lines', 'percent', 'other') THEN h
  WHEN form = 'ipv4' THEN v4 WHEN form = 'ipv6' THEN v6 WHEN form = 'opaque' THEN '' END AS host FROM x)
SELECT page_id, form, host, regexp_replace(coalesce(host, ''), 'www[.]', '') AS domain,
  CASE form WHEN 'plain' THEN {origin_sql('url')} WHEN 'slashes' THEN 'https://' || host WHEN 'user' THEN 'http://' || host || ':81'
    WHEN 'lines' THEN 'https://' || host WHEN 'percent' THEN 'http://' || host WHEN 'ipv4' THEN 'http://' || host
    WHEN 'ipv6' THEN 'ws://' || host || ':8080' ELSE '' END AS origin, host IS NULL AS blacklisted FROM y""",
)
def standard_urls(spark, sf):
    """Hosts and origins of the pages' URLs in spellings that only the whole standard understands."""
    return _url_forms(spark, sf).select(
        "page_id", "form", u.url_host("raw").alias("host"), u.get_domain("raw").alias("domain"),
        u.get_origin("raw").alias("origin"), u.is_blacklisted("raw", ["nowhere.invalid"]).alias("blacklisted"),
    )


@query(
    "is_blacklisted",
    f"""SELECT page_id, d = '' OR len(list_filter({list(BLOCKLIST) + ['cheap-pills.example.com', 'example.org']!r},
  lambda s: d = s OR ends_with(d, '.' || s))) > 0 AS blacklisted
FROM (SELECT page_id, {domain_sql('url')} AS d FROM pages)""",
)
def is_blacklisted(spark, sf):
    listed = [*BLOCKLIST, "cheap-pills.example.com", "example.org"]
    return v.pages(spark, sf).select(
        "page_id", u.is_blacklisted("url", listed).alias("blacklisted")
    )


# ---------------------------------------------------------------- page fields


@query(
    "parse_pages",
    f"""SELECT page_id, url, {fields_sql('html')}, {domain_sql('url')} AS domain,
  CAST(starts_with(url, 'https') AS INTEGER) AS https FROM pages""",
)
def parse_pages(spark, sf):
    return parse_page(v.pages(spark, sf))


@query(
    "parse_tagged_pages",
    with_views("doc_pages")
    + f"""SELECT url, {fields_sql('html')}, {domain_sql('url')} AS domain,
  CAST(starts_with(url, 'https') AS INTEGER) AS https FROM doc_pages""",
)
def parse_tagged_pages(spark, sf):
    return parse_page(v.doc_pages(spark, sf))


@query("page_links", with_views("links") + "SELECT id, url, depth, parent FROM links")
def page_links(spark, sf):
    return v.links(spark, sf)


@query(
    "link_counts",
    with_views("links")
    + "SELECT parent, count(*) AS links, count(DISTINCT url) AS targets FROM links GROUP BY parent",
)
def link_counts(spark, sf):
    found = extract_links(v.pages(spark, sf))
    return found.groupBy(F.col("url").alias("parent")).agg(
        F.count("*").alias("links"), F.count_distinct("link").alias("targets")
    )


@query(
    "classify_responses",
    with_views("responses")
    + """SELECT url, CASE WHEN status BETWEEN 300 AND 399 AND coalesce(location, '') <> '' THEN 'redirect'
  WHEN status >= 500 THEN 'error:HTTP ' || status
  WHEN NOT contains(lower(content_type), 'text/html') AND NOT contains(lower(content_type), 'xhtml')
    THEN 'error:not HTML' ELSE 'page' END AS outcome FROM responses""",
)
def classify_responses(spark, sf):
    return v.responses(spark, sf).select(
        "url", pg.classify_response("status", "content_type", "location").alias("outcome")
    )


_RESPONSE_KIND = """SELECT url, location, CASE WHEN status BETWEEN 300 AND 399 THEN 'redirect'
  WHEN status >= 500 THEN 'error:HTTP ' || status
  WHEN NOT contains(lower(content_type), 'text/html') THEN 'error:not HTML' ELSE 'page' END AS kind
  FROM responses"""


@query(
    "follow_redirects",
    with_views(
        "responses",
        recursive=True,
        extra={
            "k": _RESPONSE_KIND,
            "walk": """SELECT url AS "origUrl", url AS "finalUrl", 0 AS hops, kind, location FROM k
  UNION ALL SELECT w."origUrl", w.location, w.hops + 1, coalesce(k.kind, 'error:not fetched'), k.location
  FROM walk w LEFT JOIN k ON k.url = w.location WHERE w.kind = 'redirect' AND w.hops < 5""",
        },
    )
    + """SELECT "origUrl", "finalUrl", hops,
  CASE WHEN kind = 'redirect' THEN 'error:redirects' ELSE kind END AS outcome
FROM walk WHERE kind <> 'redirect' OR hops = 5""",
)
def follow_redirects(spark, sf):
    return pg.follow_redirects(v.responses(spark, sf))


@query(
    "decode_bodies",
    """SELECT page_id, length(h) AS chars, md5(h) AS digest
FROM (SELECT page_id, CASE WHEN lang = 'utf-8' THEN html
  ELSE regexp_replace(html, 'charset="utf-8"', 'charset="' || lang || '"') END AS h
  FROM (SELECT page_id, html, CASE regexp_extract(html, '<html lang="([a-z]+)"', 1)
    WHEN 'fr' THEN 'windows-1252' WHEN 'de' THEN 'iso-8859-1' WHEN 'es' THEN 'utf-16le'
    ELSE 'utf-8' END AS lang FROM pages))""",
)
def decode_bodies(spark, sf):
    """Bodies in four charsets by page language, decoded again."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    label = F.when(lang == "fr", "windows-1252").when(lang == "de", "iso-8859-1").when(
        lang == "es", "utf-16le"
    ).otherwise("utf-8")
    text = F.regexp_replace(F.col("html"), F.lit('charset="utf-8"'),
                            F.concat(F.lit('charset="'), F.col("label"), F.lit('"')))
    bodies = v.pages(spark, sf).withColumn("label", label).select(
        "page_id",
        F.when(F.col("label").isin("windows-1252", "iso-8859-1"), F.encode(text, "ISO-8859-1"))
        .when(F.col("label") == "utf-16le", F.encode(text, "UTF-16LE"))
        .otherwise(F.encode("html", "UTF-8")).alias("body"),
        F.concat(F.lit("text/html; charset="), "label").alias("content_type"),
    )
    return pg.decode_body(bodies, "body", "content_type").select(
        "page_id", F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest")
    )


@query(
    "index_documents",
    with_views("nodes")
    + """SELECT substr(replace(base64(encode(url)), chr(10), ''), 1, 512) AS _id, url, title,
  coalesce(nullif(description, ''), nullif("metaDescription", ''), '') AS "metaDescription",
  "ogTitle", "ogDescription", domain, '' AS content, lang, https = 1 AS https, popularity, depth,
  crawled_at AS timestamp FROM nodes""",
)
def index_documents(spark, sf):
    return pg.to_index_docs(v.nodes(spark, sf), 0)


@query(
    "result_view",
    with_views("search_docs")
    + """SELECT url, coalesce(nullif(title, ''), nullif("ogTitle", ''), url) AS view_title,
  substr(coalesce(nullif("metaDescription", ''), nullif("ogDescription", ''), ''), 1, 250) AS snippet
FROM search_docs""",
)
def result_view(spark, sf):
    return pg.result_view(v.search_docs(spark, sf)).select("url", "view_title", "snippet")


@query(
    "filter_sites",
    with_views("nodes")
    + "SELECT url, domain, title FROM nodes WHERE contains(lower(domain), 'the') OR contains(lower(title), 'the')",
)
def filter_sites(spark, sf):
    return pg.filter_sites(v.nodes(spark, sf), "The").select("url", "domain", "title")


# ---------------------------------------------------------------- tables


_UPDATES = """SELECT url, 'again ' || title AS title, crawled_at - 86400000 * (page_id % 2 * 2 - 1) AS crawled_at,
  page_id AS seq FROM nodes_id
  UNION ALL SELECT parent, 'up ' || title, crawled_at, page_id + 1000000000 FROM nodes_id WHERE parent IS NOT NULL"""


@query(
    "upsert_nodes",
    with_views("nodes_id", extra={"updates": _UPDATES})
    + """, m AS (SELECT url, title, crawled_at, 0 AS n, 0 AS seq FROM nodes_id
  UNION ALL SELECT url, title, crawled_at, 1, seq FROM updates)
SELECT url, title, crawled_at FROM m
QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, n DESC, seq DESC) = 1""",
)
def upsert_nodes(spark, sf):
    base = v.nodes_with_id(spark, sf)
    shift = (F.col("page_id") % 2 * 2 - 1) * 86400000
    again = base.select(
        "url", F.concat(F.lit("again "), "title").alias("title"),
        (F.col("crawled_at") - shift).alias("crawled_at"), F.col("page_id").alias("seq"),
    )
    up = base.filter(F.col("parent").isNotNull()).select(
        F.col("parent").alias("url"), F.concat(F.lit("up "), "title").alias("title"), "crawled_at",
        (F.col("page_id") + 1000000000).alias("seq"),
    )
    existing = base.select("url", "title", "crawled_at")
    return tb.upsert_nodes(existing, again.unionByName(up), "seq")


@query(
    "insert_ignore",
    with_views("links", "visited")
    + """SELECT url, NULL::BIGINT AS id FROM visited
UNION ALL (SELECT url, id FROM links WHERE url NOT IN (SELECT url FROM visited)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1)""",
)
def insert_ignore(spark, sf):
    existing = v.visited(spark, sf).withColumn("id", F.lit(None).cast("long"))
    return tb.insert_ignore(existing, v.links(spark, sf).select("url", "id"), "url", ["id"])


def _page_data(spark, sf):
    """Every page as stored under its own url after it was asked for by its plain-http url."""
    orig = F.regexp_replace("url", "^https:", "http:")
    return v.nodes(spark, sf).withColumn("origUrl", orig)


_SAVED = (
    with_views("nodes", "frontier", "visited")
    + """, touched AS (SELECT url FROM nodes UNION SELECT regexp_replace(url, '^https:', 'http:') FROM nodes)
SELECT 'nodes' AS tbl, url, title, depth, parent, crawled_at FROM nodes
UNION ALL SELECT 'visited', url, NULL, NULL, NULL, NULL FROM (SELECT url FROM visited UNION SELECT url FROM touched)
UNION ALL SELECT 'frontier', url, NULL, depth, parent, NULL FROM frontier WHERE url NOT IN (SELECT url FROM touched)"""
)


def _crawl_rows(nodes, visited, frontier):
    """The rows of the three tables under common columns."""
    rows = nodes.select(F.lit("nodes").alias("tbl"), "url", "title", "depth", "parent", "crawled_at")
    for name, df in (("visited", visited), ("frontier", frontier)):
        rows = rows.unionByName(df.select(F.lit(name).alias("tbl"), *[c for c in df.columns if c != "id"]), allowMissingColumns=True)
    return rows


@query("save_pages", _SAVED)
def save_pages(spark, sf):
    old = v.nodes(spark, sf).filter(F.col("depth") < 3)
    return _crawl_rows(*tb.save_pages(old, v.visited(spark, sf), v.frontier(spark, sf), _page_data(spark, sf)))


@query("commit_pages", _SAVED)
def commit_pages(spark, sf):
    """The same through the stored tables, in two batches, one of which comes twice."""
    data = _page_data(spark, sf)
    old = v.nodes(spark, sf).filter(F.col("depth") < 3)
    store = create_store(spark, new_folder(spark, "crawl-store"), old, v.visited(spark, sf), v.frontier(spark, sf), buckets=8)
    early = F.startswith("origUrl", F.lit("http:"))
    store = store.save_pages(data.filter(early), batch=1).save_pages(data.filter(~early), batch=2).save_pages(data, batch=1)
    return _crawl_rows(store.nodes, store.visited, store.frontier)


@query(
    "latest_pages",
    with_views("nodes")
    + "SELECT url, title, domain, depth, parent, popularity, https FROM nodes ORDER BY crawled_at DESC, url LIMIT 150",
)
def latest_pages(spark, sf):
    return g.latest_pages(v.nodes(spark, sf))


@query(
    "retain_latest",
    with_views("nodes", "visited")
    + """, kept AS (SELECT url FROM nodes ORDER BY crawled_at DESC, url LIMIT 100)
SELECT 'visited' AS tbl, v.url FROM visited v JOIN kept USING (url) UNION ALL SELECT 'nodes', url FROM kept""",
)
def retain_latest(spark, sf):
    nodes, visited = tb.retain_latest(v.nodes(spark, sf), v.visited(spark, sf), 100)
    kept = nodes.select(F.lit("nodes").alias("tbl"), "url")
    return kept.unionByName(visited.select(F.lit("visited").alias("tbl"), "url"))


@query(
    "sample_recrawl",
    with_views("nodes")
    + "SELECT least(count(*), 15) AS n, least(count(*), 15) AS known, -1 AS depth FROM nodes",
)
def sample_recrawl(spark, sf):
    """Size and membership of the sample; which urls are drawn depends on the hash."""
    nodes = v.nodes(spark, sf)
    sample = tb.sample_recrawl(nodes)
    return sample.join(nodes.select("url", F.lit(1).alias("one")), "url", "left").agg(
        F.count("*").alias("n"), F.count("one").alias("known"), F.max("depth").alias("depth")
    )


@query("dedup_urls", with_views("frontier") + "SELECT url, id FROM frontier")
def dedup_urls(spark, sf):
    return tb.dedup_urls(v.links(spark, sf), ["id"]).select("url", "id")


# ---------------------------------------------------------------- seeds


def _topics(spark, sf):
    return v.documents(spark, sf).select(
        F.regexp_extract("text", r"^([A-Za-z]+)", 1).alias("topic")
    ).filter("topic <> ''").distinct()


_TOPICS_SQL = "topics AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z]+)', 1) AS topic FROM documents WHERE regexp_matches(text, '^[A-Za-z]'))"


@query(
    "topic_urls",
    f"""WITH {_TOPICS_SQL}
SELECT 'https://' || lang || '.wikipedia.org/wiki/' || topic AS url
FROM topics, (SELECT unnest({list(SEED_LANGS)!r}) AS lang)""",
)
def topic_urls(spark, sf):
    return sd.topic_urls(_topics(spark, sf))


@query(
    "merge_seed_pools",
    with_views("links")
    + """SELECT url FROM pages UNION SELECT url FROM links
UNION SELECT 'https://en.wikipedia.org/w/index.php?special=recentchanges&limit=50&offset=' || page_id * 50 FROM pages""",
)
def merge_seed_pools(spark, sf):
    pages = v.pages(spark, sf)
    return sd.merge_seed_pools(
        pages, v.links(spark, sf), sd.recent_change_urls(pages, "page_id")
    )


@query(
    "seeds_not_visited",
    with_views("frontier", "visited")
    + "SELECT DISTINCT url FROM (SELECT url FROM links UNION ALL SELECT url FROM pages) WHERE url NOT IN (SELECT url FROM visited)",
)
def seeds_not_visited(spark, sf):
    pool = sd.merge_seed_pools(v.links(spark, sf), v.pages(spark, sf))
    return sd.seeds_not_visited(pool, v.visited(spark, sf))


@query("sample_seeds")
def sample_seeds(spark, sf):
    pages = v.pages(spark, sf)
    return sd.sample_seeds(pages, _topics(spark, sf), pages.select(F.col("page_id").alias("page")))


# ---------------------------------------------------------------- frontier rules


@query(
    "drop_visited",
    with_views("visited")
    + "SELECT id, url, depth, parent FROM frontier WHERE url NOT IN (SELECT url FROM visited)",
)
def drop_visited(spark, sf):
    return fr.drop_visited(v.frontier(spark, sf), v.visited(spark, sf))


@query(
    "drop_blacklisted",
    with_views("links", "blocklist")
    + f"""SELECT id, url FROM links WHERE {domain_sql('url')} <> '' AND NOT EXISTS (SELECT 1 FROM blocklist b
  WHERE {domain_sql('links.url')} = b.domain OR ends_with({domain_sql('links.url')}, '.' || b.domain))""",
)
def drop_blacklisted(spark, sf):
    return fr.drop_blacklisted(v.links(spark, sf), v.blocklist(spark, sf)).select("id", "url")


@query("robots_rules", with_views("rules") + "SELECT origin, path FROM rules WHERE path <> '/'"
       + " UNION ALL SELECT origin, path FROM rules WHERE path = '/'")
def robots_rules(spark, sf):
    return fr.parse_robots(v.robots(spark, sf))


_ROBOTS = f"""SELECT id, url FROM links WHERE {{0}} EXISTS (SELECT 1 FROM rules r
  WHERE {origin_sql('links.url')} = r.origin
    AND starts_with(regexp_extract(links.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), r.path))"""


@query("filter_robots", with_views("links", "rules") + _ROBOTS.format("NOT"))
def filter_robots(spark, sf):
    rules = fr.parse_robots(v.robots(spark, sf))
    return fr.filter_robots(v.links(spark, sf), rules).select("id", "url")


@query("robots_blocked", with_views("links", "rules") + _ROBOTS.format(""))
def robots_blocked(spark, sf):
    rules = fr.parse_robots(v.robots(spark, sf))
    return fr.robots_blocked(v.links(spark, sf), rules).select("id", "url")


@query("depth_filter", with_views("links") + "SELECT id, url, depth FROM links WHERE depth <= 6")
def depth_filter(spark, sf):
    return fr.depth_filter(v.links(spark, sf), 6).select("id", "url", "depth")


@query(
    "filter_domain_quota",
    with_views("nodes", "links")
    + f"""SELECT id, url FROM links LEFT JOIN (SELECT domain, count(*) AS c FROM nodes GROUP BY domain) n
  ON n.domain = {domain_sql('links.url')} WHERE coalesce(c, 0) < 10""",
)
def filter_domain_quota(spark, sf):
    counts = g.domain_counts(v.nodes(spark, sf))
    return fr.filter_domain_quota(v.links(spark, sf), counts, 10).select("id", "url")


@query(
    "admit_links",
    with_views("nodes", "links")
    + f"""SELECT id, url FROM (SELECT links.*, coalesce(c, 0) AS c,
    row_number() OVER (PARTITION BY {domain_sql('links.url')} ORDER BY id) AS rn
  FROM links LEFT JOIN (SELECT domain, count(*) AS c FROM nodes GROUP BY domain) n
  ON n.domain = {domain_sql('links.url')}) WHERE c + rn <= 25""",
)
def admit_links(spark, sf):
    counts = g.domain_counts(v.nodes(spark, sf))
    return fr.admit_links(v.links(spark, sf), counts, "id", 25).select("id", "url")


@query(
    "polite_batch",
    with_views("nodes", "frontier")
    + f"""SELECT f.id, f.url, f.depth, f.parent FROM (SELECT *, {domain_sql('url')} AS d,
    row_number() OVER (PARTITION BY {domain_sql('url')} ORDER BY id) AS rn FROM frontier) f
  LEFT JOIN (SELECT domain, count(*) AS n FROM nodes WHERE depth = 0 GROUP BY domain) i ON i.domain = f.d
  WHERE d <> '' AND rn + coalesce(n, 0) <= 2 ORDER BY id LIMIT 50""",
)
def polite_batch(spark, sf):
    root = v.nodes(spark, sf).filter("depth = 0")
    busy = root.groupBy("domain").agg(F.count("*").alias("n"))
    return fr.polite_batch(v.frontier(spark, sf), busy, 2, 50)


@query(
    "admission_gate",
    with_views("nodes", "visited", "blocklist")
    + f""", l AS (SELECT links.*, {domain_sql('links.url')} AS d FROM links),
ok AS (SELECT * FROM l WHERE d <> '' AND depth <= 7
  AND NOT EXISTS (SELECT 1 FROM blocklist b WHERE d = b.domain OR ends_with(d, '.' || b.domain))
  AND d NOT IN (SELECT domain FROM nodes GROUP BY domain HAVING count(*) >= 12)
  AND d NOT IN (SELECT domain FROM nodes WHERE popularity = 1))
SELECT id, url FROM ok QUALIFY row_number() OVER (ORDER BY id) <= 5000 - (SELECT count(*) FROM visited)""",
)
def admission_gate(spark, sf):
    nodes = v.nodes(spark, sf)
    gated = fr.admission_gate(
        v.links(spark, sf), nodes, v.visited(spark, sf), v.blocklist(spark, sf),
        nodes.filter("popularity = 1").select("domain").distinct(),
        max_depth=7, max_frontier=5000, max_pages=12,
    )
    return gated.select("id", "url")


# ---------------------------------------------------------------- domain graph

_EDGES = """SELECT p.domain AS src, n.domain AS dst, count(*) AS w FROM nodes n JOIN nodes p
  ON n.parent = p.url WHERE n.domain <> p.domain GROUP BY 1, 2"""
_SHOWN = """SELECT url, title, domain, depth, parent, popularity, https FROM (SELECT *,
  row_number() OVER (PARTITION BY domain ORDER BY popularity DESC, url) AS rn FROM nodes)
  WHERE rn = 1 ORDER BY popularity DESC, url LIMIT 200"""
_TOP_EDGES = "SELECT * FROM edges ORDER BY w DESC, src, dst LIMIT 300"
_GRAPH = {"edges": _EDGES, "shown": _SHOWN, "top_edges": _TOP_EDGES}


@query(
    "table_counts",
    with_views("nodes", "visited")
    + """SELECT 'nodes' AS name, count(*) AS c FROM nodes UNION ALL
SELECT 'frontier', count(*) FROM frontier UNION ALL SELECT 'visited', count(*) FROM visited""",
)
def table_counts(spark, sf):
    return g.table_counts(
        nodes=v.nodes(spark, sf), frontier=v.frontier(spark, sf), visited=v.visited(spark, sf)
    )


@query("domain_counts", with_views("nodes") + "SELECT domain, count(*) AS c FROM nodes GROUP BY domain")
def domain_counts(spark, sf):
    return g.domain_counts(v.nodes(spark, sf))


@query(
    "top_domains",
    with_views("nodes")
    + "SELECT domain, count(*) AS c FROM nodes GROUP BY domain ORDER BY c DESC, domain LIMIT 20",
)
def top_domains(spark, sf):
    return g.top_domains(v.nodes(spark, sf))


@query(
    "page_popularity",
    with_views("nodes")
    + """SELECT url, CAST(coalesce(c, 0) + 1 AS INTEGER) AS popularity FROM nodes LEFT JOIN
(SELECT domain, count(*) AS c FROM nodes GROUP BY domain ORDER BY c DESC, domain LIMIT 20) t USING (domain)""",
)
def page_popularity(spark, sf):
    nodes = v.nodes(spark, sf)
    return g.with_popularity(nodes.drop("popularity"), g.top_domains(nodes)).select(
        "url", "popularity"
    )


@query(
    "domain_edges",
    with_views("nodes")
    + """SELECT p.domain AS src, n.domain AS dst, n.url FROM nodes n JOIN nodes p
  ON n.parent = p.url WHERE n.domain <> p.domain""",
)
def domain_edges(spark, sf):
    return g.domain_edges(v.nodes(spark, sf))


@query("edge_weights", with_views("nodes", extra=_GRAPH) + "SELECT src, dst, w FROM top_edges")
def edge_weights(spark, sf):
    return g.edge_weights(v.nodes(spark, sf))


@query("domain_representatives", with_views("nodes", extra=_GRAPH) + "SELECT * FROM shown")
def domain_representatives(spark, sf):
    return g.domain_representatives(v.nodes(spark, sf))


@query(
    "domain_graph_edges",
    with_views("nodes", extra=_GRAPH)
    + """SELECT src, dst, w FROM top_edges WHERE src IN (SELECT domain FROM shown)
  AND dst IN (SELECT domain FROM shown)""",
)
def domain_graph_edges(spark, sf):
    return g.domain_graph(v.nodes(spark, sf))[1]


@query(
    "domain_graph_summary",
    with_views("nodes", extra=_GRAPH)
    + """SELECT (SELECT count(*) FROM nodes) AS total, (SELECT count(*) FROM shown) AS domains,
  (SELECT sum(w) FROM top_edges) AS weight""",
)
def domain_graph_summary(spark, sf):
    shown, edges, total = g.domain_graph(v.nodes(spark, sf))
    return total.select(
        "total",
        shown.agg(F.count("*").alias("n")).scalar().alias("domains"),
        edges.agg(F.sum("w").alias("w")).scalar().alias("weight"),
    )


@query("graph_payload")
def graph_payload(spark, sf):
    return g.graph_payload(*g.domain_graph(v.nodes(spark, sf)))


@query(
    "ego_network",
    with_views("nodes", extra=_GRAPH)
    + """, root AS (SELECT domain FROM shown ORDER BY popularity DESC, url LIMIT 1)
SELECT domain, popularity FROM shown WHERE domain IN (SELECT domain FROM root)
  OR domain IN (SELECT src FROM edges WHERE dst IN (SELECT domain FROM root))
  OR domain IN (SELECT dst FROM edges WHERE src IN (SELECT domain FROM root))
ORDER BY popularity DESC, url LIMIT 50""",
)
def ego_network(spark, sf):
    nodes = v.nodes(spark, sf)
    shown = g.domain_representatives(nodes)
    root = shown.orderBy(F.desc("popularity"), "url").first()["domain"]
    return g.ego_network(shown, g.all_edge_weights(nodes), root).select("domain", "popularity")


@query(
    "new_domains",
    with_views("nodes")
    + """SELECT DISTINCT domain FROM nodes WHERE domain NOT IN
  (SELECT domain FROM nodes WHERE depth <= 5)""",
)
def new_domains(spark, sf):
    nodes = v.nodes(spark, sf)
    return g.new_domains(nodes.filter("depth <= 5"), nodes)


# ---------------------------------------------------------------- crawling

_WALK = {
    "walk": """SELECT CAST(0 AS BIGINT) AS id, 0 AS depth
  UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN page_links l ON l.src = w.id WHERE w.depth < 10"""
}


# Paths order as the finders do: by length, then by the places of the links on the way.
_PATHS = {
    "places": "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM page_links",
    "paths": """SELECT CAST(0 AS BIGINT) AS id, 0 AS depth, '00' AS path, CAST(NULL AS BIGINT) AS src
  UNION SELECT l.dst, w.depth + 1, chr(CAST(49 + w.depth AS INTEGER)) || substr(w.path, 2) || l.place, l.src
  FROM paths w JOIN places l ON l.src = w.id WHERE w.depth < 10""",
}


@query(
    "reachable_pages",
    with_views("page_links", recursive=True, extra=_WALK)
    + "SELECT id, min(depth) AS depth FROM walk GROUP BY id",
)
def reachable_pages(spark, sf):
    roots = v.pages(spark, sf).filter("page_id = 0").select(F.col("page_id").alias("id"))
    return cr.reachable(v.page_links(spark, sf), roots)


@query(
    "crawl_bfs",
    with_views("page_links", recursive=True, extra=_PATHS)
    + f"""SELECT regexp_replace(p.url, '#.*', '') AS url, min(depth) AS depth, {domain_sql('p.url')} AS domain,
  regexp_replace(arg_min(q.url, path), '#.*', '') AS parent
  FROM paths JOIN pages p ON p.page_id = paths.id LEFT JOIN pages q ON q.page_id = paths.src GROUP BY p.url""",
)
def crawl_bfs(spark, sf):
    pages = v.linked_pages(spark, sf)
    keyed = pages.withColumn("url", F.regexp_replace("url", "#.*", ""))
    state = cr.crawl_bfs(keyed, keyed.filter("page_id = 0"), cr.CrawlRules(max_pages=1 << 30))
    return state.nodes.select("url", "depth", "domain", "parent")


@query(
    "crawl_round",
    with_views("page_links", "blocklist", "rules")
    + f""", p AS (SELECT page_id, regexp_replace(url, '#.*', '') AS url FROM pages),
firsts AS (SELECT origin, min(path) AS first FROM rules GROUP BY origin),
got AS (SELECT p.* FROM p WHERE NOT starts_with(url, 'https') AND NOT EXISTS (SELECT 1 FROM firsts r
  WHERE r.origin = {origin_sql('p.url')}
  AND starts_with(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), r.first)))
SELECT 'node' AS kind, url, 0 AS depth, parent FROM (SELECT url, NULL::VARCHAR AS parent FROM got)
UNION ALL SELECT 'frontier', url, 1, parent FROM
  (SELECT d.url, got.url AS parent, row_number() OVER (PARTITION BY d.url ORDER BY got.page_id, l.dst) AS rn
   FROM page_links l JOIN got ON got.page_id = l.src JOIN p d ON d.page_id = l.dst
   WHERE starts_with(d.url, 'https') AND NOT EXISTS (SELECT 1 FROM blocklist b
     WHERE {domain_sql('d.url')} = b.domain OR ends_with({domain_sql('d.url')}, '.' || b.domain)))
  WHERE rn = 1""",
)
def crawl_round(spark, sf):
    """One round from the plain-http pages with all rules on: new nodes and new frontier. Each
    site disallows the first of its languages."""
    pages = v.linked_pages(spark, sf).withColumn("url", F.regexp_replace("url", "#.*", ""))
    robots = fr.parse_robots(v.robots(spark, sf)).groupBy("origin").agg(F.min("path").alias("path"))
    rules = cr.CrawlRules(robots=robots, blocklist=v.blocklist(spark, sf), max_pages=1 << 30)
    seeds = pages.select(F.col("page_id").alias("id"), "url").filter(~F.startswith("url", F.lit("https")))
    state = cr.expand_frontier(cr.start_state(spark, seeds), pages, rules, 0)
    columns = ["url", "depth", "parent"]
    return (
        state.nodes.select(F.lit("node").alias("kind"), *columns)
        .unionByName(state.frontier.select(F.lit("frontier").alias("kind"), *columns))
    )
