"""A corpus from raw documents to packed token sequences; each stage works on all that its predecessor kept.

Quality rules drop documents, the n-gram join keeps one document of each group of near copies (five words,
similarity 0.8), strings of 200 bytes that still repeat are cut out, personal data gets surrogates, and what is
left is packed. Every stage is written and read again, so a lost executor costs no more than its own stage.

Defined cases: each row is a document of its own, whatever its doc_id. A null or empty text has no words and goes in
the first stage. Of repeated rows and of copies, null ids among them, one row stays: the least non-null id, among
equal ids the least text hash, then the first row. Ids may be null and repeat to the end. Columns beside doc_id and
text, whatever their names, are kept up to packing; n_chars, where there is one, follows the text. An empty table
gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm import packing, quality_cascade, signature_join, suffix_dedup, surrogates
from passagelake.llm.common import stored, tokenizer_path
from passagelake.shipping import ship


#: For made-up corpora. Whoever runs this on real data sets a key of their own and keeps it secret.
SURROGATE_KEY = "key of the example pipeline"


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cascade.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature_join.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(suffix_dedup.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(surrogates.replace_entities(docs, SURROGATE_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("PII", personal_data),
    ("packing", pack),
]

#: Byte cuts, keyed surrogates and packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
