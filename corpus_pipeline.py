"""A corpus pipeline over ``documents``: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes what its predecessor kept, written as a table, and all but the last return the
columns of ``documents``. The stages on word sequences take five words and a similarity of 0.8.
Null or empty texts pass through all stages with the quality score of an empty text, no
duplicates, no leaks, no secrets and no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.llm import bpe, decontamination, near_dedup, quality, secrets
from webtrawl.llm.common import fold, table
from webtrawl.plans.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. It learns from the labelled rows
    outside the held-out fold, as its own query does."""
    learned = fold(F.col("doc_id"), 5) != 0
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), learned)
    return quality.score_quality(docs, model, keep=COLUMNS[1:]).where("good").select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    dropped = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item's question and answer are found go."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; all documents stay."""
    found = secrets.find_secrets(docs, keep=COLUMNS[1:])
    text = secrets.masked(F.col("text"), F.col("spans"))
    hit = F.size("spans") > 0
    changed = found.select("doc_id", text.alias("text"), "lang", "source", "n_chars", hit.alias("_hit"))
    n_chars = F.when(F.col("_hit"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the text got back from them."""
    found = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digest = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return found.select("doc_id", "n_tokens", "ids", digest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_leaks),
    ("secrets", masked_secrets),
    ("tokens", tokens),
]

#: No SQL expresses trained compression dictionaries and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, function in first:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return last(spark, docs, sf_dir)
