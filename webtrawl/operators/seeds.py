"""Seed URLs for a crawl."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.operators.tables import insert_ignore, seeded_order
from webtrawl.settings import SEED_BATCH, SEED_LANGS

RECENT = "https://en.wikipedia.org/w/index.php?special=recentchanges&limit=50&offset="


def topic_urls(topics: DataFrame, langs=tuple(SEED_LANGS), topic: str = "topic") -> DataFrame:
    """One url per topic and language; ``langs`` is a short list, so each topic row fans out
    in place."""
    lang = F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang")
    return topics.select(F.col(topic).alias("topic"), lang).select(
        F.concat(
            F.lit("https://"), "lang", F.lit(".wikipedia.org/wiki/"), "topic"
        ).alias("url")
    )


def recent_change_urls(pages: DataFrame, page: str = "page") -> DataFrame:
    """Urls of the paged recent-changes lists, 50 entries a page."""
    return pages.select(F.concat(F.lit(RECENT), (F.col(page) * 50).cast("string")).alias("url"))


def merge_seed_pools(*pools: DataFrame) -> DataFrame:
    """All pools together, each url once."""
    return reduce(DataFrame.unionByName, [p.select("url") for p in pools]).distinct()


def sample_seeds(
    seeds: DataFrame,
    topics: DataFrame,
    pages: DataFrame,
    count: int = SEED_BATCH,
    seed: int = 0,
    langs=tuple(SEED_LANGS),
) -> DataFrame:
    """At most ``count`` fixed seeds and ``count`` English topics, 80 topic and language
    pairs and 30 list pages, picked by a seeded hash order. Urls may repeat across pools."""

    def pick(df: DataFrame, n: int, salt: int) -> DataFrame:
        return df.orderBy(seeded_order("url", seed + salt), "url").limit(n)

    parts = [
        pick(seeds.select("url"), count, 0),
        pick(topic_urls(topics, ["en"]), count, 1),
        pick(topic_urls(topics, langs), min(count, 80), 2),
        pick(recent_change_urls(pages), min(count, 30), 3),
    ]
    return reduce(DataFrame.unionByName, parts)


def seeds_not_visited(seeds: DataFrame, visited: DataFrame) -> DataFrame:
    return seeds.join(visited.select("url"), "url", "left_anti")


def add_seeds(frontier: DataFrame, seeds: DataFrame, visited: DataFrame) -> DataFrame:
    """Put unvisited seeds into the frontier at depth 0 (without ids yet)."""
    rows = seeds_not_visited(seeds, visited).select(
        "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")
    )
    return insert_ignore(frontier, rows)
