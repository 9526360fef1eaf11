"""Ordered work per key when one key may hold a large share of all rows.

A key with more than ``slice_rows`` rows is cut into slices of about equal row counts, in the
order of time and a tie-break, so that no task ever gets the whole key, also when all its rows
fall into one instant. Slices are worked on in parallel; what a slice needs from the earlier ones
(a running total, the state at its start) is computed from one small row per slice and joined
back. Keys below the limit are one slice and take no extra step.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.plans.staging import stage

SLICE_ROWS = 1_000_000
SLICE = "_slice_"
SLICED = "_sliced_"
_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def with_slices(
    df: DataFrame, keys: Sequence[str], ms: str, slice_rows: int = SLICE_ROWS, tie: str | None = None,
    whole: Column | None = None,
) -> DataFrame:
    """Add the slice number and whether the row's key has several slices. A key with a row that is
    ``whole`` is only cut beyond ``SLICE_ROWS``.

    The rows of the keys over the limit are range-partitioned and sorted by (keys, ms, tie), into
    shuffle partitions at the most, however small the slices are: the driver gets a sample and a
    task's result per partition. Every partition is cut by row number into slices of half the limit.
    Only these rows are moved and written. At most ``rows / slice_rows`` keys are over the limit,
    which bounds the joins' right side.
    """
    keys = list(keys)
    limit = F.lit(slice_rows)
    if whole is not None:
        limit = F.when(F.col("_whole_"), max(slice_rows, SLICE_ROWS)).otherwise(limit)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n_"), F.max(F.lit(False) if whole is None else whole).alias("_whole_"))
    hot = counts.filter(F.col("_n_") > limit).drop("_whole_")
    hot = stage(hot, "hot-keys")
    parts = hot.agg(F.sum(F.ceil(F.col("_n_") * 2 / slice_rows))).first()[0]
    if not parts:
        return df.withColumn(SLICE, F.lit(0).cast("long")).withColumn(SLICED, F.lit(False))
    names = hot.select(*keys)
    order = [*keys, ms, *([tie] if tie else [])]
    tasks = min(int(parts), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = df.join(names, keys, "left_semi").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    within = F.floor(place.bitwiseAND((1 << _SHIFT) - 1) / max(slice_rows // 2, 1)).cast("long")
    cut = stage(cut.withColumn(SLICE, F.spark_partition_id().cast("long") * F.lit(1 << _SHIFT) + within), "slices")
    rest = df.join(names, keys, "left_anti").withColumn(SLICE, F.lit(0).cast("long"))
    return rest.withColumn(SLICED, F.lit(False)).unionByName(cut.withColumn(SLICED, F.lit(True)))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    ms: str,
    tie: str,
    totals: dict[str, Column],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add running sums per key in (ms, tie) order, the current row included.

    ``totals`` maps an output name to the per-row amount. Totals of whole slices are summed
    first (with map-side combine); a slice then only adds what came before it.
    """
    keys = list(keys)
    cut = with_slices(df, keys, ms, slice_rows, tie)
    for name, amount in totals.items():
        cut = cut.withColumn(f"_amount_{name}", amount)
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.filter(SLICED)
        .groupBy(*keys, SLICE)
        .agg(*[F.sum(f"_amount_{n}").alias(f"_sum_{n}") for n in totals])
        .select(
            *keys,
            SLICE,
            *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in totals],
        )
    )
    inside = (
        W.partitionBy(*keys, SLICE).orderBy(ms, tie).rowsBetween(W.unboundedPreceding, 0)
    )
    local = cut.select(
        "*", *[F.sum(f"_amount_{n}").over(inside).alias(f"_local_{n}") for n in totals]
    )
    joined = local.join(offsets, [*keys, SLICE], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            F.coalesce(
                F.col(f"_local_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0)), F.col(f"_before_{n}")
            ).alias(n)
            for n in totals
        ],
    )


def over_all_partitions(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition small rows that cost much work each over all shuffle partitions; adaptive
    execution merges partitions by bytes and would leave such work to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def grouped_for_python(df: DataFrame, *keys: str):
    """Rows grouped by ``keys`` for a Python function, over all shuffle partitions."""
    return over_all_partitions(df, *keys).groupBy(*keys)
