"""What several operators of this subpackage share: tables, Arrow batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python worker turns into one output batch.
CHUNK_BYTES = 1 << 20
#: Entries a worker's word cache holds before it is emptied.
CACHE_WORDS = 400_000
#: Bits of the bitmap that ``among`` gives to every task: 8 MB.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table holds."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``folds``: the split into folds."""
    return F.crc32(id_column.cast("string")) % folds


def among(df: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in the only column of ``keys``; any order and
    repeats allowed there. Nulls are in nothing.

    The keys' hashes are first marked in a bitmap of ``bits`` bits, 8 MB at the most whatever the
    number of keys, that every task gets. Only rows with a marked hash are shuffled for the join;
    with more keys than bits that saves less, and the result is the same. The join with the keys is
    an inner one, as a semi join would be moved below the marking.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    key = keys.select(F.col(keys.columns[0]).alias("_key")).where("_key is not null")
    bitmap = key.select(place("_key").alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )
    own = df.withColumn("_place", place(column))
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = own.withColumn("_part", F.bitmap_bucket_number("_place")).join(F.broadcast(bitmap), "_part").where(
        byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8).cast("int") + 1)) != 0
    )
    return marked.select(*df.columns).join(key.distinct(), F.col(column) == F.col("_key")).drop("_key")


def flagged(df: DataFrame, mark: Column, marks: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with the boolean ``name``: whether the hash ``mark`` is one of the hashes in the only
    column of ``marks``. True may be wrong (two hashes on one bit), false never is. Every task gets
    a bitmap of ``bits`` bits, 8 MB at the most whatever the number of hashes; nothing is shuffled."""
    place = F.pmod(F.col("_mark"), F.lit(bits)) + 1
    bitmap = marks.toDF("_mark").select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8).cast("int") + 1)) != 0
    own = df.withColumn("_mark", mark).withColumn("_place", place).withColumn("_part", F.bitmap_bucket_number("_place"))
    return own.join(F.broadcast(bitmap), "_part", "left").select(*df.columns, F.coalesce(is_set, F.lit(False)).alias(name))


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once per Python worker and kept for its later tasks. It is kept in
    a module of its own, as this package's modules travel by value and are new in every task."""
    kept = sys.modules.setdefault("_webtrawl_kept", types.ModuleType("_webtrawl_kept"))
    if name not in vars(kept):
        vars(kept)[name] = make()
    return vars(kept)[name]


def release_memory() -> None:
    """Give freed memory back to the system. Workers are used again by later tasks and stages, and
    what one of them has freed would else count against the executor until it ends."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of about ``limit`` bytes of text; one row at least. Freed
    memory is given back when the task's rows are through."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Hashing a word takes less time than looking it up in a cache would."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(keys: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit keys whose output bits all depend on all input bits."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def chained(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The key of a sequence from the key of all but its last word and that word's hash."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + then)
