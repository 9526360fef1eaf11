"""Shards in random order by a two-pass external shuffle, with DataFrame functions only.

First pass: every record goes to a bucket that its seeded hash chooses, and there are as many
buckets as keep one within memory. Second pass: each bucket is put into an order of its own by
a Fisher-Yates shuffle (``shuffle`` of an array) and written. A record's place in the whole is
the number of records in earlier buckets (prefix sums over the buckets' counts) plus its place
in the bucket; places are dealt out to the shards in turn, so shard sizes differ by one row at
most, and the slots of a shard are gapless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrawl.plans.staging import stage

#: Bytes of records a bucket is meant to hold.
BUCKET_BYTES = 12 << 20
#: Bytes counted for a record besides its text.
ROW_BYTES = 64


def _bucket(id_col: str, text_col: str, seed: int, buckets: int) -> Column:
    place = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return F.pmod(place, F.lit(buckets)).cast("int")


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in shuffled order: the columns record (a struct of all columns of ``docs``),
    shard (0 to ``shards`` - 1) and slot (0, 1, ... within a shard), written as a table.

    Every row stays, whatever is null or repeated in it; a null text only counts as empty for
    the bucket sizes. Rows alike in id and text share a bucket, as the id is the table's key.
    A text larger than a bucket makes a larger bucket. An empty table gives an empty table.
    Columns may have any name; map columns have no order and are not allowed. With the same
    seed, rows and partitioning the order is the same.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long") + ROW_BYTES
    total = docs.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    placed = docs.select(
        _bucket(id_col, text_col, seed, buckets).alias("_bucket"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_record")
    )
    sizes = docs.groupBy(_bucket(id_col, text_col, seed, buckets).alias("_bucket")).count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    bases = sizes.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    scattered = placed.repartition(buckets, "_bucket")
    key = F.xxhash64(F.lit(seed + 1), F.col("_record"))
    packed = scattered.groupBy("_bucket").agg(F.collect_list(F.struct(key.alias("key"), F.col("_record").alias("record"))).alias("_rows"))
    shuffled = packed.join(bases, "_bucket").select("_base", F.posexplode(F.shuffle(F.array_sort("_rows"), seed)).alias("_at", "_row"))
    place = F.col("_base") + F.col("_at")
    return stage(
        shuffled.select(
            F.col("_row.record").alias("record"),
            F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
            F.floor(place / F.lit(shards)).cast("long").alias("slot"),
        ),
        "shards",
    )
