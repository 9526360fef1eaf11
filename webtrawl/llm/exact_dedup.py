"""Exact copies by distributed MSD radix partitioning.

Texts are split into groups by their successive bytes, from the first one on, in strides that
grow by a fixed factor. A group is known by the bytes its members share, so no group numbers are
kept anywhere and any task can tell a row's group from its text alone. A level counts the rows
of each group, pre-aggregated before the shuffle; groups of one row are done, groups whose texts
have ended are copies, and only the others are split by the next stride. Texts are compared as
bytes to their end; hashes only spare rows that stand alone the way through a shuffle.

Copies of one text meet as one row per task when they are counted, and rows find their group by a
join with one row per group on the other side, which adaptive execution splits where a text is
frequent. No task needs all rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import flagged, id_text
from webtrawl.plans.staging import stage

#: Bytes of the first stride, and by how much each next prefix is longer.
FIRST_BYTES, GROWTH = 64, 8
#: Rows without an id come after all others.
LAST_ID = 2**63 - 1


def normalised(text: Column) -> Column:
    """Bytes of the text with every run of the six ASCII white-space characters as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary")


def _prefix(size: int) -> tuple[Column, Column]:
    """The first bytes of a text, and whether it ends with them."""
    return F.substring("bytes", 1, size).alias("prefix"), (F.octet_length("bytes") <= size).alias("ended")


def _mark(size: int) -> Column:
    return F.xxhash64(*_prefix(size))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (smallest doc_id among the rows of equal text),
    group_size, kept, text_sha256 (of the normalised text; never compared).

    * A null text counts as empty, so null and empty texts are copies of one another; a text of
      white space only is one space and no copy of these.
    * Rows without an id are copies as others are, come after all ids, and have a null keep_id
      where no row of the group has an id.
    * Of rows that repeat the smallest id of their group exactly one is kept.
    * Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    text = normalised(F.col("text"))
    rows = id_text(docs, id_col, text_col).select("doc_id", text.alias("bytes"))
    shared_heads = rows.groupBy(*_prefix(first)).count().where("count > 1").select(F.xxhash64("prefix", "ended"))
    read = flagged(rows, _mark(first), shared_heads, "_shared").select(
        "doc_id",
        F.sha2("bytes", 256).alias("text_sha256"),
        F.when(F.col("_shared"), F.col("bytes")).alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    read = stage(read, "radix-rows")
    shared = read.where("bytes is not null")
    classes, open_rows, size = [], shared, first * growth
    while True:
        groups = open_rows.groupBy(*_prefix(size)).agg(
            F.count("*").alias("group_size"),
            F.min("doc_id").alias("keep_id"),
            F.min_by("row", F.coalesce("doc_id", F.lit(LAST_ID))).alias("keep_row"),
        )
        groups = groups.where("group_size > 1").withColumn("mark", F.xxhash64("prefix", "ended"))
        groups = stage(groups.withColumn("prefix", F.when(F.col("ended"), F.col("prefix"))), "radix-groups")
        classes.append(groups.where("ended").select(F.col("prefix").alias("copy"), "group_size", "keep_id", "keep_row"))
        going_on = groups.where("not ended").select("mark")
        if going_on.isEmpty():
            break
        longer = shared.where(F.octet_length("bytes") > size)
        open_rows = flagged(longer, _mark(size), going_on, "_open").where("_open").drop("_open")
        size *= growth
    copies = classes[0]
    for more in classes[1:]:
        copies = copies.unionByName(more)
    told = flagged(read, F.xxhash64("bytes"), copies.select(F.xxhash64("copy")), "_copy")
    single = told.where("not _copy").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    grouped = told.where("_copy").join(copies, F.col("bytes") == F.col("copy"), "left")
    alone = F.col("copy").isNull()
    return single.unionByName(
        grouped.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
            "text_sha256",
        )
    )
