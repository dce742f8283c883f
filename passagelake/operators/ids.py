"""Dense ids in a global order without a single-task sort: ranges are sorted in parallel and counted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.sources.scratch import stored


def dense_ids(rows: DataFrame, order: list[str], name: str, first: int = 0, sums: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """rows with `name` = first, first + 1, ... along `order` (which must be unique).

    sums: by its name each running sum that is added too, as the summed column (long, no nulls) and the sum before the first row."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    running = {"_n": None, **{f"_s{i}": column for i, (column, _) in enumerate((sums or {}).values())}}
    at = {out: ranged.columns.index(column) for out, column in running.items() if column}

    def number(batches):
        part, done = TaskContext.get().partitionId(), dict.fromkeys(running, 0)
        for batch in batches:
            size = batch.num_rows
            out = batch.append_column("_part", pa.array(np.full(size, part, np.int32)))
            for column in running:
                step = np.asarray(batch.column(at[column]), np.int64) if column in at else np.ones(size, np.int64)
                total = np.cumsum(step) + done[column]
                out = out.append_column(column, pa.array(total - step))
                done[column] = int(total[-1]) if size else done[column]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    # written: the ranges that are counted must be those that are numbered, also after a lost executor
    numbered = stored(ranged.mapInArrow(number, f"{fields}, _part int, " + ", ".join(f"{c} long" for c in running)), "ids")
    totals = numbered.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(column).alias(out) for out, column in running.items() if column])
    before = [first, *[start for _, start in (sums or {}).values()]]
    bases = []
    for part in sorted(totals.collect(), key=lambda r: r["_part"]):  # a row per partition
        bases.append((part["_part"], *before))
        before = [b + part[c] for b, c in zip(before, running)]
    offsets = rows.sparkSession.createDataFrame(bases or [(0, *before)], "_part int, " + ", ".join(f"_base{c} long" for c in running))
    placed = numbered.join(F.broadcast(offsets), "_part")
    for out, column in zip((name, *(sums or {})), running):
        placed = placed.withColumn(out, F.col(f"_base{column}") + F.col(column))
    return placed.drop("_part", *running, *[f"_base{c}" for c in running])
