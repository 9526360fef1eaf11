"""Upserts, first-writer inserts and set-style operators over crawl tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.plans.ranking import newest
from webtrawl.settings import RECRAWL_DEPTH, RECRAWL_SAMPLE


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in ``order``. The group limit runs before the shuffle too,
    so a key with very many copies sends one row per task."""
    ranked = df.withColumn("_rn_", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn_") == 1).drop("_rn_")


def upsert_nodes(existing: DataFrame, updates: DataFrame, seq: str | None = None) -> DataFrame:
    """Insert or overwrite by url: latest ``crawled_at`` wins, an update beats an equal age.

    ``seq`` optionally names an arrival-order column of ``updates``; the later row wins.
    """
    order_cols = [F.desc("crawled_at"), F.desc("_new_"), F.desc("_seq_")]
    old = existing.withColumn("_new_", F.lit(0)).withColumn("_seq_", F.lit(0).cast("long"))
    number = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    new = updates.select(
        *existing.columns, F.lit(1).alias("_new_"), number.alias("_seq_")
    )
    merged = old.unionByName(new)
    return first_per_key(merged, ["url"], order_cols).drop("_new_", "_seq_")


def insert_ignore(
    existing: DataFrame, new: DataFrame, key: str = "url", order: Sequence | None = None
) -> DataFrame:
    """Add rows whose key is not there yet; among new rows of one key the first arrival wins."""
    return existing.unionByName(
        rows_to_insert(existing, new, key, order), allowMissingColumns=True
    )


def rows_to_insert(
    existing: DataFrame, new: DataFrame, key: str = "url", order: Sequence | None = None
) -> DataFrame:
    first = first_per_key(new, [key], order) if order else new.dropDuplicates([key])
    return first.join(existing.select(key), key, "left_anti").select(*new.columns)


def save_pages(
    nodes: DataFrame, visited: DataFrame, frontier: DataFrame, page_data: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store fetched pages: upsert the nodes, mark ``url`` and ``origUrl`` visited, drop both
    from the frontier. The search index is derived from the nodes."""
    touched = page_data.select(
        F.explode(F.array_distinct(F.array("url", "origUrl"))).alias("url")
    ).filter(F.col("url").isNotNull()).distinct()
    return (
        upsert_nodes(nodes, page_data.select(*nodes.columns)),
        insert_ignore(visited, touched),
        frontier.join(touched, "url", "left_anti").select(*frontier.columns),
    )


def retain_latest(nodes: DataFrame, visited: DataFrame, n: int | None = 100_000) -> tuple:
    """The newest ``n`` nodes (None: all), and the visited urls that are still among them."""
    kept = nodes if n is None else newest(nodes, "crawled_at", "url", n)
    return kept, visited.join(kept.select("url"), "url", "left_semi")


def seeded_order(url, seed: int) -> Column:
    """A fixed pseudo-random sort key."""
    return F.xxhash64(F.col(url) if isinstance(url, str) else url, F.lit(seed))


def sample_recrawl(nodes: DataFrame, n: int = RECRAWL_SAMPLE, seed: int = 0) -> DataFrame:
    """A repeatable random sample of urls as frontier rows with the re-crawl marker."""
    return (
        nodes.select("url")
        .orderBy(seeded_order("url", seed), "url")
        .limit(n)
        .select(
            "url",
            F.lit(RECRAWL_DEPTH).alias("depth"),
            F.lit(None).cast("string").alias("parent"),
        )
    )


def dedup_urls(urls: DataFrame, order: Sequence | None = None) -> DataFrame:
    """The first row of each url (exact; any row without ``order``)."""
    return first_per_key(urls, ["url"], order) if order else urls.dropDuplicates(["url"])
