"""The operators' registered queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chunk_reuse, packing, quality_cascade, repair_store, signature_join, suffix_dedup, surrogates, template_extraction, threshold_topk, token_counts
from .common import shared_dir, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Of the registered query alone: whoever runs the operator on real data gives a key of their own and keeps it secret.
SURROGATE_KEY = "key of the registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-ids")
    repair_store.write_ids(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), out)
    return repair_store.documents_of(repair_store.read_ids(spark, out))


def op2_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extraction.extract(_table(spark, sf_dir, "pages"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge_quality(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY, count_column="n_replaced")


def op4_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.encode(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), digests=True)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), digests=True, keep=("doc_id",))


def op7_resync_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op9_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.linked(_table(spark, sf_dir, "documents"))


def op10_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = threshold_topk.scaled(_table(spark, sf_dir, "embeddings"))
    return threshold_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def queries() -> dict:
    return {
        "op1_repair_token_ids": op1_repair_token_ids,
        "op2_template_extraction": op2_template_extraction,
        "op3_quality_cascade": op3_quality_cascade,
        "op5_surrogates": op5_surrogates,
        "op4_chunk_reuse_bpe": op4_chunk_reuse_bpe,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_resync_token_counts": op7_resync_token_counts,
        "op9_signature_join": op9_signature_join,
        "op10_threshold_topk": op10_threshold_topk,
        "op8_bin_slack_packing": op8_bin_slack_packing,
    }


OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT row_number() OVER () AS n, vec_id, e FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


WORD = "'[^\\x20\\x09-\\x0D]+'"
OP3 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {WORD}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_full_match(x, '[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*'))) AS shouted, len(regexp_extract_all(text, '!!+')) AS exclaimed
  FROM w LEFT JOIN c USING (r)
), b AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR NOT 10 * word_chars BETWEEN 25 * n_words AND 120 * n_words OR 100.0 * shouted / greatest(n_words, 1) > 33 OR 20 * exclaimed > n_words) AS kept
FROM b
"""


def oracle_sql() -> dict:
    return {"op3_quality_cascade": OP3, "op10_threshold_topk": OP10}
