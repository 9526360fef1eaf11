"""Row numbers and newest-rows cuts over a whole table without a single-task sort."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.plans.staging import stage

_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def ordered_ids(df: DataFrame, order: list[Column], out: str = "id") -> DataFrame:
    """Unique ids that follow ``order``, with gaps; staged, so that they stay the same."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(parted.withColumn(out, F.monotonically_increasing_id()), "ids")


def global_row_number(df: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """Dense row numbers from 1: range partitions, then one offset per partition."""
    numbered = ordered_ids(df, order, "_mono_").withColumn(
        "_part_", F.shiftright("_mono_", _SHIFT)
    )
    before = W.orderBy("_part_").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part_")
        .agg(F.count("*").alias("_n_"))
        .select("_part_", F.coalesce(F.sum("_n_").over(before), F.lit(0)).alias("_off_"))
    )
    local = F.col("_mono_").bitwiseAND((1 << _SHIFT) - 1)
    return numbered.join(offsets, "_part_").select(
        *df.columns, (F.col("_off_") + local + 1).alias(out)
    )


def newest(df: DataFrame, ms: str, tie: str, n: int, slot_ms: int = 3_600_000) -> DataFrame:
    """The ``n`` newest rows.

    Counts per time slot give the oldest slot that is still needed; older rows are filtered
    out before the sort, so no task holds more than the slots around the cut.
    """
    slot = F.floor(F.col(ms) / slot_ms)
    down = W.orderBy(F.desc("_slot_")).rowsBetween(W.unboundedPreceding, 0)
    needed = (
        df.groupBy(slot.alias("_slot_"))
        .agg(F.count("*").alias("_n_"))
        .select("_slot_", F.sum("_n_").over(down).alias("_cum_"))
        .filter(F.col("_cum_") >= n)
        .agg(F.max("_slot_").alias("_slot_"))
    )
    recent = df.filter(slot >= F.coalesce(needed.scalar(), F.lit(-(1 << 62))))
    return recent.orderBy(F.desc(ms), tie).limit(n)
