"""Connected components of an undirected graph given as an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b of one orderable type. Returns node, root: the least node that it is connected with; nodes without edges are absent.

    Alternating star contraction: each node's neighbours above it are hooked to the least node it knows, then the
    neighbours below it; minima are aggregated before they are dealt out, so hubs do not gather their edges."""
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")  # a < b
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a
        large = edges.join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: neighbours below b, and b itself
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()
        small = stored(small, "edges")
        # done when every node hangs on one root and no root hangs on another
        roots = small.select("a").distinct()
        again = small.join(roots.withColumnRenamed("a", "b"), "b", "left_semi").limit(1).count() or small.groupBy("b").count().filter("count > 1").limit(1).count()
        discard(edges)
        edges = small
        if not again:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
