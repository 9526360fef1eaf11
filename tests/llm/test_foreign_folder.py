"""Executors do not have the package: queries run from another folder, the package on the driver's path only."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import public_tokenizers
from webtrawl.llm import bpe, exact_dedup, ranked_search, token_files, vector_codes
from webtrawl.plans.staging import new_folder
docs = spark.createDataFrame([(i, f"some words and number {{i % 7}}") for i in range(40)], "doc_id long, text string")
vectors = spark.createDataFrame([(i, [float(i % 5)] * 8, i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
bpe_path, word_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
assert bpe.encode_and_decode(docs, bpe_path).count() == 40
shards = token_files.write_token_files(docs, new_folder(spark, "tokens"), word_path, end_id=1)
assert token_files.read_token_files(spark, shards).count() == 40
assert ranked_search.search(ranked_search.build_index(docs), docs.withColumnRenamed("doc_id", "item_id"), 3).count() == 120
assert vector_codes.encode_vectors(vectors).count() == 40
assert exact_dedup.exact_duplicates(docs).where("kept").count() == 7
print("all ran")
"""


def test_operators_run_where_workers_lack_the_package(tmp_path):
    found = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "all ran" in found.stdout, found.stderr[-3000:]
