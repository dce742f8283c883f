"""Exact deduplication of passages: one row for each distinct text, numbered by first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import dense_ids


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def unique_texts(occurrences: DataFrame, order: list[str], first_id: int = 0) -> DataFrame:
    """text_id, text, text_hash, n_occurrences and the columns of `order`, by first occurrence along `order` (which is unique).

    Texts meet by their SHA-256, so a shuffle carries a hash and a place; the text itself is looked up at the end by its first place."""
    keyed = occurrences.select(*order, text_hash(F.col("text")).alias("text_hash"))
    first = keyed.groupBy("text_hash").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n_occurrences"))
    ids = dense_ids(first.select("text_hash", "n_occurrences", *[F.col(f"first.{c}").alias(c) for c in order]), order, "text_id", first_id)
    return ids.join(occurrences.select(*order, "text"), order)


def unknown_texts(occurrences: DataFrame, texts: DataFrame) -> DataFrame:
    """The occurrences (with text_hash) whose text is not among `texts` (text_hash); what is left needs a vector."""
    return occurrences.join(texts.select("text_hash"), "text_hash", "left_anti")


def representatives(occurrences: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """For each key the values of its first occurrence."""
    return occurrences.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("r")).select(key, "r.*")


def counts(occurrences: DataFrame) -> DataFrame:
    """n_chunks, n_unique_texts, n_duplicates."""
    each = occurrences.groupBy(text_hash(F.col("text"))).agg(F.count("*").alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count("*").alias("n_unique_texts"))
    return total.withColumn("n_duplicates", F.greatest(F.col("n_chunks") - F.col("n_unique_texts"), F.lit(0)))
