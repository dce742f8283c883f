"""Exact top-k inner product by the threshold algorithm.

Candidates are cut into blocks of bounded size, each stored once with its sorted lists: for each dimension its
vectors in the order of that component. A query reads each list from the end that its own component favours, some
entries at a time, scores the vectors it meets for the first time, and stops when the bound for all others - the sum
over dimensions of the query's component times the last entry read - is below its kth score. The blocks are handled
in rounds of growing size; what a round found is every query's floor in the next one, so a block stops as soon as its
bound is below the kth score of all blocks before it. Ties at the kth score are always met.

Queries travel as blocks too: rows of packed vectors. A round pairs its candidate blocks with all query blocks, so
candidates are shuffled once and not once for each query block.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; neither do rows
with a null id. Vectors of another length than the query's are no candidates of it. Rows with equal ids are each a
candidate, and each a query with ranks of its own; a row is no candidate for a query of its own id. Fewer than k
candidates give as many ranks. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

BLOCK = 8192
STEP = 16
GROWTH = 4  # a round handles so many times the blocks of all rounds before it


class SortedLists:
    """A candidate block: integer vectors (n x d) and their ids; `order`, if it is known, are the rows by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.order = sorted_lists(vectors) if order is None else order  # d lists of rows, ascending
        self.values = np.take_along_axis(self.vectors, self.order.T, axis=0).T.copy()
        self.wide = self.vectors.astype(np.float64)  # products below 2**53 are exact
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def top(self, query_id: int, query: np.ndarray, k: int, step: int = STEP, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, vectors scored) of the k best that score `floor` at least, ties to the smaller id."""
        n, used = len(self.ids), np.flatnonzero(query)
        q, rising = query[used], query[used] < 0  # a negative component favours small entries
        seen = np.zeros(n, bool)
        best, scores, depth, width, met = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, step, 0
        exact = int(np.abs(query).max(initial=0)) * self.largest * max(1, len(query)) < 2**52
        if floor is not None and n and int((np.where(rising, self.values[used, 0], self.values[used, n - 1]) * q).sum()) < floor:
            return best, scores, 0  # not even the best entry of every list reaches the floor
        while depth < n:
            last = min(n, depth + width)
            if len(used) and last < n:
                rows = np.where(rising[:, None], self.order[used, depth:last], self.order[used, n - last : n - depth]).ravel()
            else:
                rows = np.arange(n)
                last = n
            new = np.zeros(n, bool)
            new[rows] = True
            new &= ~seen
            rows = np.flatnonzero(new)
            seen |= new
            met += len(rows)
            rows = rows[self.ids[rows] != query_id]
            got = (self.wide[rows] @ query.astype(np.float64)).astype(np.int64) if exact else self.vectors[rows] @ query
            best, scores = np.concatenate([best, rows]), np.concatenate([scores, got])
            if floor is not None:
                best, scores = best[scores >= floor], scores[scores >= floor]
            if len(best) > k:
                keep = np.lexsort((self.ids[best], -scores))[:k]
                best, scores = best[keep], scores[keep]
            depth, width = last, width * 2
            known = ([int(scores.min())] if len(best) == k else []) + ([floor] if floor is not None else [])
            least = max(known, default=None)
            if depth < n and least is not None:
                edge = np.where(rising, self.values[used, depth - 1], self.values[used, n - depth])
                if int((edge * q).sum()) < least:
                    break
        keep = np.lexsort((self.ids[best], -scores))[:k]
        return self.ids[best[keep]], scores[keep], met


@contextmanager
def rows_a_batch(spark, n: int):
    """Rows of whole blocks go to Python a few at a time; for jobs that run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    return np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (block, size, key, id, floor, v) as one row for each block: keys, ids, floors and vectors laid flat."""
    lists = rows.groupBy("block", "size").agg(F.array_sort(F.collect_list(F.struct("id", "key", "floor", "v"))).alias("x"))
    return lists.select("block", "size", F.col("x.id").alias(f"{kind}_ids"), F.col("x.key").alias(f"{kind}_keys"), F.col("x.floor").alias(f"{kind}_floors"), F.flatten("x.v").alias(f"{kind}_vectors"))


def _array(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, id_column: str = "vec_id", vector_column: str = "embedding", with_scored: bool = False) -> DataFrame:
    """query_id, rank, id, score for every row of `queries`; both tables hold an id and an array of whole numbers.

    with_scored adds n_scored: how many vectors were scored for the query in all rounds."""

    def numbered(df, name):
        """Each row with a number of its own and its block: rows are dealt evenly, however often one repeats."""
        rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<long>").alias("v"), F.monotonically_increasing_id().alias("key"))
        rows = stored(rows.filter("id IS NOT NULL AND v IS NOT NULL").withColumn("size", F.size("v")), name)
        blocks = max(1, -(-rows.count() // block))
        return blocks, rows, rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))

    n_blocks, rows, candidates = numbered(vectors, "candidates")
    asked = numbered(queries, "queries")[2]

    def with_lists(batches):
        for batch in batches:
            size = batch.column("size").to_pylist()
            lists = [sorted_lists(_array(batch.column("c_vectors"), i).reshape(-1, size[i])).ravel() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "size", "c_ids", "c_vectors")), pa.array(lists, pa.list_(pa.int32()))], names=["block", "size", "c_ids", "c_vectors", "c_order"])

    blocks = _packed(candidates.withColumn("floor", F.lit(None).cast("long")), "c").select("block", "size", "c_ids", "c_vectors")
    with rows_a_batch(vectors.sparkSession, 4):
        blocks = stored(blocks.mapInArrow(with_lists, "block long, size int, c_ids array<long>, c_vectors array<long>, c_order array<int>"), "sorted-lists")

    def work(batches):
        known, lists = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                size, this = batch.column("size")[i].as_py(), (batch.column("block")[i].as_py(), batch.column("size")[i].as_py())
                if batch.column("q_size")[i].as_py() != size:
                    continue
                if this != known:
                    known, lists = this, SortedLists(_array(batch.column("c_ids"), i), _array(batch.column("c_vectors"), i).reshape(-1, size), _array(batch.column("c_order"), i).reshape(size, -1))
                found, keys = [], _array(batch.column("q_keys"), i)
                floors = batch.column("q_floors")[i].as_py()
                for query_id, floor, v in zip(_array(batch.column("q_ids"), i).tolist(), floors, _array(batch.column("q_vectors"), i).reshape(-1, size)):
                    found.append(lists.top(query_id, v, k, floor=floor))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.int64())], names=["key", "ids", "scores", "n"])

    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    kept = scored = None
    start, count = 0, 1
    while start < n_blocks:
        if kept is None:
            floors = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = asked.join(kept.filter(F.col("rank") == k).select("key", F.col("score").alias("floor")), "key", "left")
        packed = stored(_packed(floors, "q").withColumnRenamed("size", "q_size").drop("block"), "query-blocks")
        pairs = blocks.filter(F.col("block").between(start, start + count - 1)).crossJoin(packed)  # of blocks, not of rows
        pairs = pairs.select("block", "size", "c_ids", "c_vectors", "c_order", "q_size", "q_keys", "q_ids", "q_floors", "q_vectors")
        with rows_a_batch(vectors.sparkSession, 4):
            met = stored(pairs.mapInArrow(work, "key long, ids array<long>, scores array<long>, n long"), "round")
        found = met.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("key", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
        if kept is not None:
            found = found.unionByName(kept.select("key", "id", "score"))
        before, kept = kept, stored(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "best")
        for table in [packed] + [before] * (before is not None) + [met] * (not with_scored):
            discard(table)
        scored = met.select("key", "n") if scored is None else scored.unionByName(met.select("key", "n"))
        start, count = start + count, (start + count) * GROWTH
    for table in (blocks, rows):
        discard(table)
    out = kept.join(asked.select("key", F.col("id").alias("query_id")), "key")
    if with_scored:
        out = out.join(scored.groupBy("key").agg(F.sum("n").alias("n_scored")), "key")
    return out.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_column), "score", *["n_scored"] * with_scored)


def scaled(vectors: DataFrame, factor: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Each component x as floor(factor * x); rows that take no part are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = vectors.select(id_column, F.col(vector_column).cast("array<double>").alias(vector_column)).filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
    x = x.filter(F.forall(vector_column, finite) & (F.size(vector_column) > 0))
    return x.select(id_column, F.transform(vector_column, lambda v: F.floor(v * factor)).alias(vector_column))
