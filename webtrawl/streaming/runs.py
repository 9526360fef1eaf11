"""Start streaming jobs over what a source has now, and read their output tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webtrawl.operators.tables import first_per_key
from webtrawl.plans.staging import new_folder

BATCH = "batch_id"


def finish(job: StreamingQuery, timeout_s: float | None) -> None:
    """Wait until the source is read up. A job that outlasts a given limit is stopped and an
    error raised, so a partial table is never read."""
    if timeout_s is None:
        job.awaitTermination()
    elif not job.awaitTermination(timeout_s):
        job.stop()
        raise TimeoutError(f"the stream did not end within {timeout_s} s")


def read_file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_append(stream: DataFrame, name: str, timeout_s: float | None = None) -> DataFrame:
    """Write an append-only stream to a new table until the source is read up."""
    folder = new_folder(stream.sparkSession, name)
    job = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    finish(job, timeout_s)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_batches(
    stream: DataFrame, name: str, handle: Callable[[DataFrame, int, str], None],
    mode: str = "append", timeout_s: float | None = None,
) -> str:
    """Hand each micro-batch to ``handle(batch, batch_id, folder)``; returns the folder."""
    folder = new_folder(stream.sparkSession, name)
    job = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, batch_id: handle(batch, batch_id, folder))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    finish(job, timeout_s)
    return folder


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keep the latest row per key of an updating stream. A batch has its own folder, which
    a repeated batch replaces, so the table stays right after a restart."""

    def write(batch: DataFrame, batch_id: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/{BATCH}={batch_id}")

    folder = run_batches(stream, name, write, "update")
    schema = T.StructType([*stream.schema.fields, T.StructField(BATCH, T.LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{folder}/table")
    return first_per_key(rows, keys, [F.desc(BATCH)]).drop(BATCH)
