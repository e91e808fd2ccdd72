"""The best k rows of each key, cut down in every task before anything is exchanged.

A task keeps, for the keys it has met, no more than k rows each; once it holds ``HELD`` rows it cuts them, and if that frees
less than half it hands them on and starts anew, so its memory is bounded whatever the number of keys. A key's rows meet in
two steps, first in ``SPREAD`` parts, so a key that every task has isn't one task's work either.

Edge cases: null keys are a key; rows whose score is null come last; equal scores rank by ``tie``, then repeated rows each
take a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HELD, SPREAD = 200_000, 32


def _cut(rows: pa.Table, keys: list[str], order: list[tuple[str, str]], k: int) -> pa.Table:
    """The first ``k`` of each key."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[*((c, "ascending") for c in keys), *order], null_placement="at_end"))
    n = len(rows)
    new = pa.array([True] + [False] * (n - 1)) if n else pa.array([], pa.bool_())
    for c in keys:
        column = rows.column(c).combine_chunks()
        a, b = column.slice(1), column.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new = pc.or_(new, pa.concat_arrays([pa.array([True]), differ]))
    flags = new.to_numpy(zero_copy_only=False)
    starts = flags.nonzero()[0]
    place = pa.array(range(n), pa.int64()).to_numpy() - starts[flags.cumsum() - 1] if n else flags
    return rows.filter(pa.array(place < k))


def top_k(df: DataFrame, keys: list[str], score: str, tie: list[str], k: int, held: int = HELD, spread: int = SPREAD) -> DataFrame:
    """``df`` cut to each key's ``k`` rows of the greatest ``score``, then the least ``tie``, with their place (from 1)."""
    order = [(score, "descending"), *((c, "ascending") for c in tie)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            rows.append(batch)
            size += batch.num_rows
            if size > held:
                whole = _cut(pa.Table.from_batches(rows), keys, order, k).combine_chunks()
                size, rows = whole.num_rows, whole.to_batches()
                if size > held // 2:
                    yield from rows
                    size, rows = 0, []
        if rows:
            yield from _cut(pa.Table.from_batches(rows), keys, order, k).to_batches()

    def placed(rows: DataFrame, *by) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie))
        return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)

    few = df.mapInArrow(run, df.schema).withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(spread)))
    return placed(placed(few, *keys, "__part").drop("__part", "place"), *keys)
