"""Page counts per domain and the domain link graph."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TREE_COLUMNS = ["url", "title", "domain", "depth", "parent", "popularity", "https"]


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row per named table with its row count."""
    parts = [
        df.agg(F.count("*").alias("c")).select(F.lit(name).alias("name"), "c")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def domain_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("domain").agg(F.count("*").alias("c"))


def top_domains(nodes: DataFrame, k: int = 20) -> DataFrame:
    return domain_counts(nodes).orderBy(F.desc("c"), "domain").limit(k)


def with_popularity(pages: DataFrame, top: DataFrame) -> DataFrame:
    """Add ``popularity``: 1 + the page count of the domain if it is in ``top``, else 1.

    ``top`` is a ``top_domains`` snapshot, so its size is bounded by that limit.
    """
    counts = top.select("domain", F.col("c").alias("_c_"))
    return (
        pages.join(F.broadcast(counts), "domain", "left")
        .withColumn("popularity", (F.coalesce("_c_", F.lit(0)) + 1).cast("int"))
        .drop("_c_")
    )


def domain_edges(nodes: DataFrame) -> DataFrame:
    """One row per cross-domain parent link: ``src``, ``dst`` and the child ``url``.

    The parent side is unique by url; adaptive execution splits the partition of a parent
    with very many children. ``edge_weights`` needs no such rows and aggregates first.
    """
    parents = nodes.select(F.col("url").alias("_parent_"), F.col("domain").alias("src"))
    children = nodes.filter(F.col("parent").isNotNull()).select(
        "url", "parent", F.col("domain").alias("dst")
    )
    return children.join(
        parents, (F.col("parent") == F.col("_parent_")) & (F.col("src") != F.col("dst"))
    ).select("src", "dst", "url")


def all_edge_weights(nodes: DataFrame) -> DataFrame:
    """Children are counted per (parent, domain) before the join, so a parent page with
    millions of children brings one row per child domain to it."""
    parents = nodes.select(F.col("url").alias("_parent_"), F.col("domain").alias("src"))
    children = (
        nodes.filter(F.col("parent").isNotNull())
        .groupBy("parent", F.col("domain").alias("dst"))
        .agg(F.count("*").alias("_n_"))
    )
    linked = children.join(
        parents, (F.col("parent") == F.col("_parent_")) & (F.col("src") != F.col("dst"))
    )
    return linked.groupBy("src", "dst").agg(F.sum("_n_").alias("w"))


def edge_weights(nodes: DataFrame, k: int = 300) -> DataFrame:
    return all_edge_weights(nodes).orderBy(F.desc("w"), "src", "dst").limit(k)


def domain_representatives(nodes: DataFrame, k: int = 200) -> DataFrame:
    """The most popular page of each domain, best ``k`` of them.

    The top-1 filter is applied before the shuffle as well (group limit), so a hot domain
    sends one row per task.
    """
    best = W.partitionBy("domain").orderBy(F.desc("popularity"), "url")
    return (
        nodes.select(*TREE_COLUMNS)
        .withColumn("_rn_", F.row_number().over(best))
        .filter(F.col("_rn_") == 1)
        .drop("_rn_")
        .orderBy(F.desc("popularity"), "url")
        .limit(k)
    )


def restrict_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges with both ends among the ``shown`` domains."""
    names = shown.select("domain").distinct()
    return edges.join(
        names.withColumnRenamed("domain", "src"), "src", "left_semi"
    ).join(names.withColumnRenamed("domain", "dst"), "dst", "left_semi").select("src", "dst", "w")


def latest_pages(nodes: DataFrame, n: int = 150) -> DataFrame:
    return nodes.orderBy(F.desc("crawled_at"), "url").limit(n).select(*TREE_COLUMNS)


def domain_graph(nodes: DataFrame, k_nodes: int = 200, k_edges: int = 300) -> tuple:
    """``(graph_nodes, graph_edges, total)``; edges are cut to ``k_edges`` before both ends
    are required to be shown."""
    shown = domain_representatives(nodes, k_nodes)
    edges = restrict_edges(edge_weights(nodes, k_edges), shown)
    total = nodes.agg(F.count("*").alias("total"))
    return shown, edges, total


def graph_or_latest(nodes: DataFrame) -> tuple:
    """``domain_graph``, or the latest pages without edges when there is no domain row."""
    shown, edges, total = domain_graph(nodes)
    if shown.isEmpty():
        return latest_pages(nodes), edges.limit(0), total
    return shown, edges, total


def graph_payload(shown: DataFrame, edges: DataFrame, total: DataFrame) -> DataFrame:
    """One JSON row ``{nodes, edges, total, domains}``; both lists are cut by ``domain_graph``."""
    node_json = shown.agg(
        F.array_sort(F.collect_list(F.struct(*TREE_COLUMNS))).alias("nodes")
    ).withColumn("domains", F.size("nodes"))
    edge_json = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst", "w"))).alias("edges"))
    one = F.lit(1).alias("_one_")
    joined = (
        node_json.select("*", one)
        .join(edge_json.select("*", one), "_one_")
        .join(total.select("*", one), "_one_")
    )
    return joined.select(F.to_json(F.struct("nodes", "edges", "total", "domains")).alias("payload"))


def ego_network(shown: DataFrame, edges: DataFrame, root: str | None, limit: int | None = None):
    """The shown nodes that are ``root`` or linked to it, most popular first (50).

    Without a root the first 100 shown nodes.
    """
    order = [F.desc("popularity"), F.col("url")]
    if root is None:
        return shown.orderBy(*order).limit(limit or 100)
    near = (
        edges.filter(F.col("dst") == root).select(F.col("src").alias("domain"))
        .unionByName(edges.filter(F.col("src") == root).select(F.col("dst").alias("domain")))
    )
    linked = shown.join(near.distinct(), "domain", "left_semi")
    itself = shown.filter(F.col("domain") == root)
    return (
        linked.unionByName(itself).dropDuplicates(["domain"]).orderBy(*order).limit(limit or 50)
    )


def new_domains(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Domains of the current snapshot that the previous one did not have."""
    names = current.select("domain").distinct()
    return names.join(previous.select("domain").distinct(), "domain", "left_anti")
