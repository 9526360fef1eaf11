"""Frontier ingest from a stream of url messages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.operators.tables import rows_to_insert
from webtrawl.sources.messages import split_dead_letters, to_dead_letters
from webtrawl.streaming.runs import run_batches


def stream_frontier_ingest(messages: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Insert the urls of a message stream into a frontier table, first message wins.

    Returns the frontier and the dead-letter messages. Each batch writes only its new urls
    into its own folder and is compared with the earlier batches' folders, so a batch that
    is repeated after a failure writes the same rows again.
    """
    spark = messages.sparkSession
    schema = "url string, depth int, parent string, enqueuedAt long"

    def write(batch: DataFrame, batch_id: int, folder: str) -> None:
        good, dead = split_dead_letters(batch, now_ms)
        earlier = [f"{folder}/frontier/batch_{i:08d}" for i in range(batch_id)]
        known = spark.read.schema(schema).parquet(*earlier) if earlier else good.limit(0)
        order = [F.col("enqueuedAt"), F.col("depth"), F.col("parent")]
        new = rows_to_insert(known, good, "url", order)
        new.write.mode("overwrite").parquet(f"{folder}/frontier/batch_{batch_id:08d}")
        to_dead_letters(dead).write.mode("overwrite").parquet(
            f"{folder}/dead/batch_{batch_id:08d}"
        )

    folder = run_batches(messages, "ingest", write)
    frontier = spark.read.schema(schema).parquet(f"{folder}/frontier/*")
    dead = spark.read.schema("key string, value string").parquet(f"{folder}/dead/*")
    return frontier, dead
