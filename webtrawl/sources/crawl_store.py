"""Stored crawl tables that change together: nodes, visited and frontier.

A store is a folder of immutable parts and a list of versions (``plans.versions``). All tables are
cut into buckets by a hash of the url. A batch writes a part with the rows it brings, only for the
buckets its urls fall into, and publishes one version that names the parts of all tables, so a
page is stored, marked visited and taken off the frontier at once or not at all. A batch number
that was committed before changes nothing, which lets a stream repeat a batch.

Rows are put together when they are read: of a url's nodes the latest ``crawled_at`` counts, and a
frontier row counts unless the same or a later batch has fetched its url. Buckets that have gathered
more than ``MAX_PARTS`` parts of a table are rewritten into one by the batch that brings one more;
the other buckets' files stay as they are.
"""

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl import schemas
from webtrawl.operators.tables import first_per_key
from webtrawl.plans.staging import stage
from webtrawl.plans.versions import publish, published

BUCKETS = 64
#: Parts of a bucket that a reader may have to put together.
MAX_PARTS = 8

_NODE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.NODES.fields)
_TABLES = {
    "nodes": f"{_NODE}, since int",
    "visited": "url string, since int",
    "frontier": "url string, id bigint, depth int, parent string, since int",
    "fetched": "url string, since int",
}
_VERSION = "version int, buckets int, batches array<bigint>, parts array<struct<name string, bucket int, folder string>>"


@dataclass(frozen=True)
class CrawlStore:
    """One version of the stored tables."""

    spark: SparkSession
    path: str
    version: int
    buckets: int
    batches: tuple[int, ...]
    parts: tuple[tuple[str, int, str], ...]

    def _read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a table's parts as they were written, of all or some buckets."""
        paths = [f"{f}/bucket={b}" for n, b, f in self.parts if n == name and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*paths)

    def _mixed(self, name: str) -> tuple[set[int], set[int]]:
        """The buckets with one part of a table, and those with several."""
        held = [b for n, b, _ in self.parts if n == name]
        return {b for b in held if held.count(b) == 1}, {b for b in held if held.count(b) > 1}

    @property
    def nodes(self) -> DataFrame:
        one, several = self._mixed("nodes")
        newest = first_per_key(self._read("nodes", several), ["url"], [F.desc("crawled_at"), F.desc("since")])
        return self._read("nodes", one).unionByName(newest).select(*schemas.NODES.names)

    @property
    def visited(self) -> DataFrame:
        return self._read("visited").select("url")

    def _waiting(self, buckets: set[int] | None = None) -> DataFrame:
        done = self._read("fetched", buckets).groupBy("url").agg(F.max("since").alias("_done_"))
        rows = self._read("frontier", buckets).join(done, "url", "left")
        rows = rows.filter(F.col("_done_").isNull() | (F.col("_done_") < F.col("since"))).drop("_done_")
        return first_per_key(rows, ["url"], ["id", "since"])

    @property
    def frontier(self) -> DataFrame:
        return self._waiting().select("id", "url", "depth", "parent")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int"))

    def _part(self, name: str, rows: DataFrame) -> list[tuple[str, int, str]]:
        """Write a part and name its buckets."""
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        placed = self._bucketed(rows)
        placed.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema("bucket int").option("basePath", folder).parquet(folder)
        return [(name, r.bucket, folder) for r in written.select("bucket").distinct().collect()]  # at most one a bucket

    def _compacted(self, name: str, added: list[tuple[str, int, str]]) -> list[tuple[str, int, str]]:
        """The parts of a table, with full buckets rewritten."""
        held = [p for p in self.parts if p[0] == name] + added
        full = {b for _, b, _ in added if sum(p[1] == b for p in held) > MAX_PARTS}
        if not full:
            return held
        now = replace(self, parts=tuple(held))
        rows = now._read(name, full)
        if name == "nodes":
            rows = first_per_key(rows, ["url"], [F.desc("crawled_at"), F.desc("since")])
        elif name == "fetched":
            rows = rows.groupBy("url").agg(F.max("since").alias("since"))
        elif name == "frontier":
            others = tuple(p for p in self.parts if p[0] == "fetched")
            rows = replace(now, parts=(*held, *others))._waiting(full)
        return [p for p in held if p[1] not in full] + self._part(name, rows)

    def _with(self, batch: int | None, **added: DataFrame) -> "CrawlStore":
        version = self.version + 1
        parts = []
        for name in _TABLES:
            rows = added.get(name)
            new = self._part(name, rows.withColumn("since", F.lit(version))) if rows is not None else []
            parts += self._compacted(name, new)
        batches = self.batches if batch is None else (*self.batches, batch)
        publish(self.spark, self.path, (version, self.buckets, list(batches), parts), _VERSION)
        return open_store(self.spark, self.path, version)

    def save_pages(self, page_data: DataFrame, batch: int) -> "CrawlStore":
        """Store a batch of fetched pages: overwrite the nodes, mark ``url`` and ``origUrl`` visited,
        take both off the frontier. Returns this version if the batch was committed before."""
        if batch in self.batches:
            return self
        page_data = stage(page_data, "batch")
        touched = page_data.select(F.explode(F.array("url", "origUrl")).alias("url")).filter("url is not null").distinct()
        touched = stage(self._bucketed(touched), "touched")
        among = {r.bucket for r in touched.select("bucket").distinct().collect()}  # at most one a bucket
        new = touched.drop("bucket").join(self._read("visited", among).select("url"), "url", "left_anti")
        nodes = first_per_key(page_data.select(*schemas.NODES.names), ["url"], [F.desc("crawled_at")])
        return self._with(batch, nodes=nodes, visited=new, fetched=touched.drop("bucket"))

    def add_links(self, links: DataFrame, batch: int) -> "CrawlStore":
        """Put ``(id, url, depth, parent)`` rows on the frontier; the first of a url counts."""
        if batch in self.batches:
            return self
        rows = first_per_key(links.select("url", "id", "depth", "parent"), ["url"], ["id"])
        return self._with(batch, frontier=rows)


def create_store(spark: SparkSession, path: str, nodes: DataFrame, visited: DataFrame, frontier: DataFrame, buckets: int = BUCKETS) -> CrawlStore:
    """A store that holds these tables, in a new folder. The tables are unique by url."""
    empty = CrawlStore(spark, path, 0, buckets, (), ())
    return empty._with(None, nodes=nodes.select(*schemas.NODES.names), visited=visited.select("url"), frontier=frontier.select("url", "id", "depth", "parent"))


def open_store(spark: SparkSession, path: str, version: int | None = None) -> CrawlStore:
    """The newest committed version, or the one asked for."""
    row = published(spark, path, _VERSION, version)
    parts = tuple((p.name, p.bucket, p.folder) for p in row.parts)
    return CrawlStore(spark, path, row.version, row.buckets, tuple(row.batches), parts)
