"""The registered queries of this subpackage and, where SQL can say the same, their SQL.

Each query runs its operator over whole tables and derives the digest columns from what the
operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrawl.llm import (
    bpe,
    decontamination,
    exact_dedup,
    katz,
    language_id,
    near_dedup,
    quality,
    ranked_search,
    secrets,
    sharding,
    token_files,
    topk_search,
    vector_codes,
)
from webtrawl.llm.common import fold, table
from webtrawl.plans.staging import new_folder


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, 1 + least(len(a.q), len(b.q)))]), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["no"] < len(secrets.BASE_RULES))
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        for kind in (r.kind for r in secrets.BASE_RULES)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.encode_and_decode(table(spark, sf_dir, "documents"), path)
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = token_files.write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), path, end_id=1)
    back = token_files.read_token_files(spark, shards)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharding.external_shuffle(table(spark, sf_dir, "documents"), 8).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    languages = language_id.learn_languages(docs, ~held_out)
    found = language_id.identify(docs, languages)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.katz_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.col("good").cast("int").alias("predicted"), "difference")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "passages",
        (F.size("hits") > 0).alias("leaked"),
        F.transform("hits", lambda h: h["item_id"]).alias("items"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("best_score"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), 20)


OP11_SQL = r"""
WITH tok AS (
  SELECT doc_id, n, unnest(words) AS term FROM (
    SELECT doc_id, words, len(words) AS n FROM (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
      FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))
  WHERE n > 0
), post AS (SELECT doc_id, n, term, count(*) AS tf FROM tok GROUP BY doc_id, n, term),
c AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS toks FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
it AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))
  GROUP BY item_id, term
), s AS (
  SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // toks)))) AS BIGINT) AS score
  FROM it JOIN w USING (term) JOIN post USING (term), c
  GROUP BY item_id, doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0
)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 20
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(table(spark, sf_dir, "embeddings"))


def _codebook_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Nearest entries of all parts, written out for every round."""
    ctes = [
        """v AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "p AS (SELECT vec_id, label, part, q[part * len(q) // 4 + 1 : (part + 1) * len(q) // 4] AS x FROM v, range(4) AS t(part))",
        """c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))""",
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"""a{n} AS (SELECT vec_id, part, label, x, min(256 * list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, 1 + len(x))]) + entry) AS m
  FROM p JOIN c{n} USING (part) GROUP BY vec_id, part, label, x)"""
        )
        if n < rounds:
            ctes.append(
                f"""s{n} AS (SELECT part, entry, pos, CAST(sum(val) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT part, m % 256 AS entry, unnest(x) AS val, unnest(range(len(x))) AS pos FROM a{n}) GROUP BY part, entry, pos)"""
            )
            ctes.append(
                f"""c{n + 1} AS (SELECT part, entry, coalesce(l.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM s{n} GROUP BY part, entry) l USING (part, entry))"""
            )
    return "WITH " + ",\n".join(ctes) + f""",
f AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id, label),
e AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f GROUP BY label),
d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN e ON f.label IS NOT DISTINCT FROM e.label, d"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_secrets": op2_secrets,
    "op3_near_dedup": op3_near_dedup,
    "op4_bpe": op4_bpe,
    "op5_token_files": op5_token_files,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_katz": op8_katz,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
}

SQL = {
    "op1_exact_topk": OP1_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_vector_codes": _codebook_sql(),
    "op13_exact_dedup": OP13_SQL,
}
