"""Exact cosine search: single query, batches of queries, and several indexes at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024  # rows of a block of vectors
LITERALS = 1000  # so many ids are looked up as values of a filter, more by a join


def top_k(texts: DataFrame, query: list[float], k: int, id_column: str = "text_id", vector: str = "embedding", norm: str = "embedding_norm") -> DataFrame:
    """The k best of one query, ties to the smaller id: a partition-local top-k, then a merge of k rows each."""
    q, kind = np.asarray(query, np.float32), texts.schema[id_column].dataType.simpleString()

    def score(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                ids, vectors, norms = batch.slice(begin, BLOCK).columns
                yield pa.RecordBatch.from_arrays([ids, _cosines(q, vectors, norms)], names=[id_column, "score"])

    scored = texts.select(id_column, vector, norm).mapInArrow(score, f"`{id_column}` {kind}, score float")
    return scored.orderBy(F.col("score").desc(), id_column).limit(max(0, k))


def _cosines(q: np.ndarray, vectors: pa.Array, norms: pa.Array) -> pa.Array:
    """cosine() of a query with each vector, summed in the same order and precision: 0 where the norm is 0, else null where a value is missing."""
    x, flat = _matrix(vectors), vectors.flatten()
    missing = np.asarray(vectors.is_null()) | np.asarray(norms.is_null())
    if flat.null_count:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        missing[row[np.asarray(flat.is_null()) & (at < len(q))]] = True
    size, total = np.asarray(pc.fill_null(norms, 1), np.float32), np.zeros(len(x), np.float32)
    with np.errstate(all="ignore"):
        for j in range(min(x.shape[1], len(q))):
            total += q[j] * x[:, j]
        scores = np.where(size == 0, np.float32(0), (total.astype(np.float64) / size.astype(np.float64)).astype(np.float32))
    return pa.array(scores, pa.float32(), mask=missing & (size != 0))


def federated_top_k(indexes: list[DataFrame], query: list[float], k: int) -> DataFrame:
    """The k best over several indexes (UNION ALL), ties to the earlier index, then the smaller id."""
    local = [top_k(t, query, k).withColumn("index_order", F.lit(i)) for i, t in enumerate(indexes)]
    return reduce(DataFrame.unionByName, local).orderBy(F.col("score").desc(), "index_order", "text_id").limit(max(0, k))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros: these add nothing to a product."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    out = np.zeros((len(vectors), lengths.max(initial=0)), np.float32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(rows: DataFrame, block: int, **columns: str) -> DataFrame:
    """Rows as blocks: each column a list. Blocks are cut where the rows lie, without a shuffle."""
    fields = {name: rows.schema[c].dataType.simpleString() for name, c in columns.items()}

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                bounds = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, c.take(pa.array(np.arange(part.num_rows)))) for c in part.columns], names=list(fields))

    return rows.select(*[F.col(c).alias(name) for name, c in columns.items()]).mapInArrow(pack, ", ".join(f"`{n}` array<{t}>" for n, t in fields.items()))


def batch_top_k(texts: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """queries (query_id, query: unit vectors) against all texts: query_id, rank, id, score; ties to the smaller id.

    The queries are the stated set. Both sides are packed into blocks; each block of texts meets each block of queries
    once and gives k rows a query. Products are summed in index order and single precision, as in cosine()."""
    kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((texts, id_column), (queries, "query_id")))
    pairs = _packed(texts, block, ids=id_column, vectors="embedding", norms="embedding_norm").crossJoin(_packed(queries, block, query_ids="query_id", queries="query"))

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, norms, query_ids, asked = (batch.column(c)[i].values for c in ("ids", "vectors", "norms", "query_ids", "queries"))
                x, q = _matrix(vectors), _matrix(asked)
                total = np.zeros((len(q), len(x)), np.float32)
                for j in range(min(x.shape[1], q.shape[1])):
                    total += q[:, j, None] * x[None, :, j]
                size, number = np.asarray(norms, np.float32), np.asarray(ids)
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.where(size == 0, np.float32(0), (total.astype(np.float64) / size.astype(np.float64)).astype(np.float32))
                best = np.stack([np.lexsort((number, -row))[:k] for row in scores]) if len(q) else np.zeros((0, 0), np.int64)
                asked_by = np.repeat(np.arange(len(q)), best.shape[1])
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(asked_by)), ids.take(pa.array(best.ravel())), pa.array(scores[asked_by, best.ravel()])], names=["query_id", id_column, "score"])

    found = pairs.mapInArrow(score, f"query_id {query_kind}, `{id_column}` {kind}, score float")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_column)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def resolve_hits(hits: DataFrame, occurrences: DataFrame, sources: DataFrame, texts: DataFrame) -> DataFrame:
    """hits (text_id, score) with their text and the path and offset of their first occurrence; a hit without an occurrence, or with an unknown source or text, is an error.

    The k hits are fetched once and looked up by value, so vectors are scored once and the lookups reach the scans."""
    spark, few = hits.sparkSession, hits.select("text_id", "score").collect()  # k rows
    chosen = spark.createDataFrame(few, "text_id long, score float")

    def among(table: DataFrame, key: str, values: list) -> DataFrame:
        return table.filter(F.col(key).isin(values)) if len(values) <= LITERALS else table.join(F.broadcast(spark.createDataFrame([(v,) for v in values], f"{key} long")), key, "left_semi")

    ids = [r["text_id"] for r in few]
    first = among(occurrences, "text_id", ids).groupBy("text_id").agg(F.min_by(F.struct("source_id", "byte_offset"), "occ_ord").alias("r")).select("text_id", "r.*").collect()
    paths = among(sources, "source_id", sorted({r["source_id"] for r in first})).select("source_id", "path").collect()
    if missing := set(ids) - {r["text_id"] for r in first}:
        raise ValueError(f"text ID {min(missing)} has no occurrence")
    if missing := {r["source_id"] for r in first} - {r["source_id"] for r in paths}:
        raise ValueError(f"invalid source ID {min(missing)}")
    path_of = {r["source_id"]: r["path"] for r in paths}
    named = spark.createDataFrame([(r["text_id"], r["source_id"], path_of[r["source_id"]], r["byte_offset"]) for r in first], "text_id long, source_id long, path string, byte_offset long")
    return F.broadcast(named).join(F.broadcast(chosen), "text_id").join(among(texts.select("text_id", "text"), "text_id", ids), "text_id")
