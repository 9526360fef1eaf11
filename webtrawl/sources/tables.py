"""Table scans, page sources and dated snapshots."""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.settings import SNAPSHOT_KEEP_DAYS


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, split_on: str, low: int, high: int, parts: int, **options
) -> DataFrame:
    """A database table read in ``parts`` ranges of the numeric column ``split_on``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=split_on, lowerBound=low, upperBound=high,
            numPartitions=parts, **options,
        )
        .load()
    )


def read_page_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """``(url, body)`` from files; the file path stands for the url."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("url"), F.col("content").alias("body"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Store nodes clustered by domain, so that a domain filter skips row groups."""
    nodes.repartitionByRange("domain", "url").sortWithinPartitions("domain", "url").write.mode(
        "overwrite"
    ).parquet(path)


def snapshot(df: DataFrame, path: str, date: datetime.date | str) -> None:
    """Add a dated copy of ``df``; writing a date again replaces it."""
    (
        df.withColumn("snapshot_date", F.lit(str(date)).cast("date"))
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def prune_snapshots(
    snapshots: DataFrame, today: datetime.date | str, keep_days: int = SNAPSHOT_KEEP_DAYS
) -> DataFrame:
    """Snapshots not older than ``keep_days``; the date is the partition column, so older
    folders are not read."""
    cut = F.date_sub(F.lit(str(today)).cast("date"), keep_days)
    return snapshots.filter(F.col("snapshot_date") >= cut)
