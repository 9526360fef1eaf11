"""Tables written once and read back, to cut lineage or to share a result between branches.

The files go to the folder the cluster names in ``spark.checkpoint.dir``, so they outlive
any executor. Only on a single machine (tests, a laptop) a temporary folder is used where that is
unset; on a cluster it must be set.
"""

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_root: str | None = None


def shared_folder(spark: SparkSession) -> str:
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="webtrawl-")
    return _local_root


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), "webtrawl", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table.

    With ``drop_shuffles`` the shuffle files of the write go when it ends. They would else stay until
    the driver happens to collect garbage, beside the files of the next steps. For a ``df`` that is
    not used again: it would be shuffled anew.
    """
    path = new_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession) if drop_shuffles else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun in here remove their shuffle files when they end."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows over all cores before heavy per-row work, if the input has fewer files than
    there are cores. Such an input is small; a large table has more files than cores, its scan
    is parallel already, and it is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)
