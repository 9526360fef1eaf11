"""URL messages of the crawl queue: decode, encode, dead letters."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl import schemas
from webtrawl.functions.urls import domain_partition
from webtrawl.settings import URL_PARTITIONS


def read_message_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a Kafka topic from its latest offset (needs the Kafka connector)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .load()
        .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    )


def _decoded() -> Column:
    return F.from_json("value", schemas.URL_MESSAGE, {"mode": "PERMISSIVE"})


def _is_json() -> Column:
    return F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False))


def decode_url_messages(messages: DataFrame) -> DataFrame:
    """Frontier rows from messages: depth defaults to 0, parent to null."""
    return messages.filter(_is_json()).select(_decoded().alias("m")).select(
        F.col("m.url").alias("url"),
        F.coalesce("m.depth", F.lit(0)).alias("depth"),
        F.nullif(F.col("m.parent"), F.lit("")).alias("parent"),
        F.col("m.enqueuedAt").alias("enqueuedAt"),
    )


def split_dead_letters(messages: DataFrame, now_ms) -> tuple[DataFrame, DataFrame]:
    """``(good, dead)``: frontier rows, and ``{url, error, timestamp}`` for messages that are
    not JSON or carry no url. The message key stands for the url of a broken message."""
    good = decode_url_messages(messages).filter(F.col("url").isNotNull())
    decoded = messages.withColumn("_json_", _is_json()).withColumn("_m_", _decoded())
    dead = decoded.filter(~F.col("_json_") | F.col("_m_.url").isNull()).select(
        F.col("key").alias("url"),
        F.when(F.col("_json_"), "no url").otherwise("not JSON").alias("error"),
        F.lit(now_ms).cast("long").alias("timestamp"),
    )
    return good, dead


def to_url_messages(rows: DataFrame, now_ms, partitions: int = URL_PARTITIONS) -> DataFrame:
    """``key``, ``value`` and ``partition`` of queue messages, the partition by domain hash."""
    body = F.struct(
        "url", "depth", "parent", F.lit(now_ms).cast("long").alias("enqueuedAt")
    )
    return rows.select(
        F.col("url").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
        domain_partition("url", partitions).alias("partition"),
    )


def to_dead_letters(dead: DataFrame) -> DataFrame:
    return dead.select(
        F.col("url").alias("key"), F.to_json(F.struct("url", "error", "timestamp")).alias("value")
    )


def to_processed_messages(urls: DataFrame, now_ms) -> DataFrame:
    done = F.struct("url", F.lit(now_ms).cast("long").alias("processedAt"))
    return urls.select(F.col("url").alias("key"), F.to_json(done).alias("value"))
