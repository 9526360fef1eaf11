"""Which URLs may be crawled: visited, blocklist, robots, depth and per-domain quotas."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.functions.urls import get_domain, get_origin, get_path, host_suffixes, strip_www, url_host
from webtrawl.plans.ranking import global_row_number
from webtrawl.settings import (
    CONCURRENCY,
    DOMAIN_LIMIT,
    DOMAIN_MAX,
    MAX_DEPTH,
)


def _with_domain(urls: DataFrame, url: str, domain: str | None) -> DataFrame:
    """``_domain_`` of the urls: from the column ``domain`` if one is named, else from the url."""
    return urls.withColumn("_domain_", F.col(domain) if domain else get_domain(url))


def drop_visited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    return frontier.join(visited.select("url"), "url", "left_anti").select(*frontier.columns)


def drop_blacklisted(
    urls: DataFrame, blocklist: DataFrame, url: str = "url", domain: str | None = None
) -> DataFrame:
    """Rows whose URL is valid and whose host is neither listed nor below a listed domain.

    The suffix test runs on the distinct hosts only; the url rows then lose the blocked hosts
    in one anti join.
    """
    name = F.col(domain) if domain else strip_www(url_host(url))
    hosted = urls.withColumn("_domain_", name).filter(F.col("_domain_").isNotNull())
    listed = blocklist.select(F.col("domain").alias("_suffix_")).distinct()
    blocked = (
        hosted.select("_domain_")
        .distinct()
        .select("_domain_", F.explode(host_suffixes("_domain_")).alias("_suffix_"))
        .join(listed, "_suffix_", "left_semi")
        .select("_domain_")
        .distinct()
    )
    return hosted.join(blocked, "_domain_", "left_anti").select(*urls.columns)


def parse_robots(robots: DataFrame, origin: str = "origin", body: str = "body") -> DataFrame:
    """``(origin, path)`` of the Disallow lines in ``User-agent: *`` groups.

    The body is split at its User-agent lines, so each piece belongs to exactly one agent
    line and the rule needs neither a window nor a shuffle.
    """
    blank = r"[^\S\n]*"
    groups = F.split(F.col(body), rf"(?imdU)^{blank}user-agent:")
    lines = (
        robots.select(F.col(origin).alias("origin"), F.posexplode(groups).alias("_i_", "_group_"))
        .filter((F.col("_i_") > 0) & F.col("_group_").rlike(rf"(?dU)^{blank}\*"))
        .select("origin", F.explode(F.split("_group_", "\n")).alias("_line_"))
    )
    path = F.regexp_extract("_line_", r"(?idU)^\s*disallow:\s*(\S(?:.*\S)?)\s*$", 1)
    return lines.select("origin", path.alias("path")).filter(F.col("path") != "")


def robots_blocked(
    urls: DataFrame, rules: DataFrame, url: str = "url", places: tuple[str, str] | None = None
) -> DataFrame:
    """Rows whose path starts with a rule of their origin. ``places`` names the columns that hold
    origin and path already."""
    keyed, rule = _robots_sides(urls, rules, url, places)
    return keyed.join(rule, _robots_match(), "left_semi").select(*urls.columns)


def filter_robots(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Rows that no rule blocks; an origin without rules is allowed."""
    keyed, rule = _robots_sides(urls, rules, url)
    return keyed.join(rule, _robots_match(), "left_anti").select(*urls.columns)


def _robots_sides(urls: DataFrame, rules: DataFrame, url: str, places: tuple[str, str] | None = None):
    origin, path = map(F.col, places) if places else (get_origin(url), get_path(url))
    keyed = urls.withColumn("_origin_", origin).withColumn("_path_", path)
    rule = rules.select(F.col("origin").alias("_rule_origin_"), F.col("path").alias("_rule_"))
    return keyed, rule.distinct()


def _robots_match() -> Column:
    return (F.col("_origin_") == F.col("_rule_origin_")) & F.startswith("_path_", F.col("_rule_"))


def depth_filter(links: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """Links found too deep are dropped; ``depth`` is the depth of the link itself. None keeps all."""
    return links if max_depth is None else links.filter(F.col("depth") <= max_depth)


def filter_domain_quota(
    links: DataFrame, counts: DataFrame, max_pages: int = DOMAIN_MAX, url: str = "url", domain: str | None = None
) -> DataFrame:
    """Links whose domain has fewer than ``max_pages`` stored pages. Only full domains are
    joined; a link without a domain is kept."""
    full = counts.filter(F.col("c") >= max_pages).select(F.col("domain").alias("_domain_"))
    keyed = _with_domain(links, url, domain)
    return keyed.join(
        full.filter(F.col("_domain_") != ""), "_domain_", "left_anti"
    ).select(*links.columns)


def admit_links(
    links: DataFrame,
    counts: DataFrame,
    seq: str = "id",
    max_pages: int = DOMAIN_MAX,
    url: str = "url",
    domain: str | None = None,
) -> DataFrame:
    """Cumulative quota: stored pages plus rank within the domain may not exceed the limit.

    The rank is cut at ``max_pages`` before the shuffle (group limit), so a hot domain sends
    at most that many rows per task; the counts are joined to the survivors only.
    """
    keyed = _with_domain(links, url, domain)
    free = keyed.filter(F.col("_domain_") == "").select(*links.columns)
    rank = F.row_number().over(W.partitionBy("_domain_").orderBy(seq))
    first = (
        keyed.filter(F.col("_domain_") != "")
        .withColumn("_rn_", rank)
        .filter(F.col("_rn_") <= max_pages)
    )
    stored = counts.select(F.col("domain").alias("_domain_"), F.col("c").alias("_c_"))
    admitted = (
        first.join(stored, "_domain_", "left")
        .filter(F.coalesce("_c_", F.lit(0)) + F.col("_rn_") <= max_pages)
        .select(*links.columns)
    )
    return admitted.unionByName(free)


def polite_batch(
    frontier: DataFrame,
    inflight: DataFrame | None = None,
    domain_limit: int = DOMAIN_LIMIT,
    concurrency: int | None = CONCURRENCY,
    domain: str | None = None,
) -> DataFrame:
    """The next urls to fetch in id order: at most ``domain_limit`` per domain, those in
    flight included, and at most ``concurrency`` in all (None: no overall limit).

    A url without a domain is never picked.
    """
    keyed = _with_domain(frontier, "url", domain).filter(F.col("_domain_") != "")
    rank = F.row_number().over(W.partitionBy("_domain_").orderBy("id"))
    first = keyed.withColumn("_rn_", rank).filter(F.col("_rn_") <= domain_limit)
    if inflight is not None:
        busy = inflight.select(F.col("domain").alias("_domain_"), F.col("n").alias("_busy_"))
        first = first.join(busy, "_domain_", "left").filter(
            F.col("_rn_") + F.coalesce("_busy_", F.lit(0)) <= domain_limit
        )
    picked = first.select(*frontier.columns)
    return picked if concurrency is None else picked.orderBy("id").limit(concurrency)


def admission_gate(
    links: DataFrame,
    nodes: DataFrame,
    frontier: DataFrame,
    blocklist: DataFrame,
    auto_blocked: DataFrame | None = None,
    seq: str = "id",
    max_depth: int = MAX_DEPTH,
    max_nodes: int | None = None,
    max_frontier: int | None = None,
    max_pages: int = DOMAIN_MAX,
) -> DataFrame:
    """All link rules in order: blocklist, depth, table caps, domain quota, auto-blocks.

    Both table caps are off by default. A frontier cap admits links in ``seq`` order up to the
    free room.
    """
    counts = nodes.groupBy("domain").agg(F.count("*").alias("c"))
    n_nodes = nodes.agg(F.count("*").alias("n"))
    kept = depth_filter(drop_blacklisted(links, blocklist), max_depth)
    if max_nodes is not None:
        kept = kept.filter(n_nodes.scalar() < max_nodes)
    kept = filter_domain_quota(kept, counts, max_pages)
    if auto_blocked is not None:
        keyed = kept.withColumn("_domain_", get_domain("url"))
        names = auto_blocked.select(F.col("domain").alias("_domain_"))
        kept = keyed.join(names, "_domain_", "left_anti").select(*links.columns)
    if max_frontier is None:
        return kept
    room = F.lit(max_frontier) - frontier.agg(F.count("*").alias("n")).scalar()
    numbered = global_row_number(kept, [F.col(seq)], "_rn_")
    return numbered.filter(F.col("_rn_") <= room).select(*links.columns)
