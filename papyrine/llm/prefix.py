"""Running totals within groups of any size, over tables of any size.

A table is range-partitioned by (group, order) and stored sorted. One pass over each partition, in Arrow batches and with
constant memory, gives the totals within the partition; its first and last group also leave a marker row with their totals.
Markers, two a partition at most, are summed per group in blocks of ``BLOCK`` partitions, then over blocks, and what lies in
earlier partitions is added to the rows of a partition's first group, the only one that can have begun before.

So a group's rows spread over as many partitions as they need, and no task, nor the driver, sees more than a partition's
rows or ``BLOCK`` markers of a group. Nulls form a group; sums are of longs, null counts as 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from papyrine.llm.common import checkpoint_dir

#: Partitions whose markers of a group are added up together.
BLOCK = 1000


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """A join's condition: equal or both null in all ``keys``."""
    return reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))


def changes(column: pa.Array) -> np.ndarray:
    """For each value but the first, whether it differs from the one before it. Nulls are equal, and so are NaNs."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(column.type):
        differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return np.asarray(pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))))


def before(total: str) -> str:
    return f"before_{total}"


def earlier(df: DataFrame, groups: list[str], at: str, totals: list[str], block: int = BLOCK) -> DataFrame:
    """(groups, at, totals): the totals over the rows of a group with a smaller ``at``, a number from 0 that is in one row of a group."""

    def so_far(df: DataFrame, keys: list[str], by: str) -> DataFrame:
        rows = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({t: F.coalesce(F.sum(t).over(rows), F.lit(0)) for t in totals})

    keys = [*groups, "__block"]
    rows = df.select(*groups, at, *totals).withColumn("__block", F.floor(F.col(at) / block))
    blocks = so_far(rows.groupBy(*keys).agg(*(F.sum(t).alias(t) for t in totals)), groups, "__block")
    within = so_far(rows, keys, at)
    return within.join(blocks, same(within, blocks, keys)).select(*(within[k] for k in [*groups, at]), *((within[t] + blocks[t]).alias(t) for t in totals))


class Running:
    """``df`` sorted and stored, with the totals of ``totals`` over the rows before each row in its partition and group."""

    def __init__(self, df: DataFrame, groups: list[str], order: list[Column], totals: list[str], name: str):
        self.columns, self.groups, self.totals = df.columns, groups, totals
        schema = StructType([*df.schema.fields, *(StructField(n, k()) for n, k in (("__pid", LongType), ("__first", BooleanType), ("__marker", BooleanType))), *(StructField(before(t), LongType()) for t in totals)])
        group_at, total_at, names = [df.columns.index(g) for g in groups], [df.columns.index(t) for t in totals], schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid = TaskContext.get().partitionId()
            markers: list[tuple[pa.RecordBatch, np.ndarray, bool]] = []
            last, in_first, open_ = None, True, np.zeros(len(total_at), np.int64)

            def made(rows: pa.RecordBatch, first: np.ndarray, marker: bool, sums: list[np.ndarray]) -> pa.RecordBatch:
                n = rows.num_rows
                return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, pid)), pa.array(first), pa.array(np.full(n, marker)), *map(pa.array, sums)], names=names)

            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                new = np.zeros(n, bool)
                for i in group_at:
                    column = batch.column(i)
                    new[1:] |= changes(column)
                    if last is not None:
                        new[0] |= changes(pa.concat_arrays([last.column(i), column.slice(0, 1)]))[0]
                starts, which, sums = np.flatnonzero(new), np.cumsum(new), []
                ended = np.zeros(len(total_at), np.int64)  # of the open group, where it ends in this batch
                for k, i in enumerate(total_at):
                    value = np.asarray(pc.fill_null(batch.column(i), 0)).astype(np.int64)
                    upto = np.cumsum(value)
                    base = np.concatenate([[-open_[k]], (upto - value)[starts]])
                    sums.append(upto - value - base[which])
                    ended[k] = base[1] - base[0] if len(starts) else 0
                    open_[k] = upto[-1] - base[-1]
                if in_first and len(starts):
                    markers.append((batch.take(pa.array([starts[0] - 1])) if starts[0] else last, ended, True))
                yield made(batch, (which == 0) & in_first, False, sums)
                in_first &= not len(starts)
                last = batch.take(pa.array([n - 1]))
            if last is not None:
                markers.append((last, open_, in_first))
            for row, sums, first in markers:
                yield made(row, np.array([first]), True, [np.array([x]) for x in sums])

        keys = [*(F.col(g).asc_nulls_first() for g in groups), *order]
        folder, spark = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
        self._stored = spark.read.schema(schema).parquet(folder)
        #: All rows, without their totals.
        self.table = self._stored.where(~F.col("__marker")).select(*self.columns)

    def _carry(self) -> DataFrame:
        """(__pid, totals): what a partition's first group has in earlier partitions, where that isn't nothing."""
        names = [f"__{t}" for t in self.totals]
        markers = self._stored.where("__marker").select(*self.groups, "__pid", *(F.col(before(t)).alias(f"__{t}") for t in self.totals))
        found = earlier(markers, self.groups, "__pid", names).select("__pid", *names)
        return found.where(reduce(lambda a, b: a | b, (F.col(n) != 0 for n in names)))

    def rows(self, keep: Column | None = None) -> DataFrame:
        """All columns and before_*. Rows without ``keep`` are left out; it may use before_* as a lower bound of it."""
        rows = self._stored.where(~F.col("__marker"))
        rows = rows if keep is None else rows.where(keep)
        begun = rows.where("__first").join(self._carry(), "__pid", "left")
        begun = begun.withColumns({before(t): F.col(before(t)) + F.coalesce(F.col(f"__{t}"), F.lit(0)) for t in self.totals})
        names = [*self.columns, *map(before, self.totals)]
        return rows.where(~F.col("__first")).select(*names).unionByName(begun.select(*names))
