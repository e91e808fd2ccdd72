"""Helpers shared by the operators of this subpackage.

Rules that hold for all of them:

* ``pick`` selects columns by exact name and position, so extra columns, also ones that differ only in case, do no harm.
* Row-local Python work goes through ``append_columns`` (``mapInArrow``): bounded slices of a batch, never a whole partition.
* ``materialize`` cuts lineage by writing a table into the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one call of a row-local function handles at most (a single longer text goes alone).
SLICE_BYTES = 2 << 20
#: What Python and the JVM beside it hold of a task's rows as an Arrow batch.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names; of repeated names the first."""
    columns = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(columns))))
    return plain.select(*(F.col(f"c{columns.index(n)}").alias(n) for n in names))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local master gets one of its own; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = known.get() if known.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: one computation, no lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this process has freed to the system; the C library and Arrow keep it otherwise, as long as the driver lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on Python gets at most ``BATCH_BYTES`` in an Arrow batch, not 10,000 rows of any length, unless the session has a lower limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then the memory it has freed goes back to the system: the worker stays for other tasks, or idle beside them."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


#: Keys with more than one of so many rows are frequent: there are fewer such keys, so they fit a broadcast.
FREQUENT = 500


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the columns of ``table`` for their keys (each once there, none missing) but ``count``.

    ``count`` is the number of rows of a key. Keys with a large share of the rows are joined by broadcast, so they are
    spread as the rows are; the others by an exchange.
    """
    often = (table.agg(F.sum(count)).first()[0] or 0) / FREQUENT
    common = F.broadcast(table.where(F.col(count) > often).drop(count))  # fewer than FREQUENT rows
    seldom = table.where(F.col(count) <= often).drop(count)
    rest = rows.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(seldom, keys)
    return rows.join(common, keys).unionByName(rest)


def chance(seed: str, *columns: str) -> Column:
    """A number from 0 to 1 that depends on these columns only, as fine as a double: rows below a share are a draw of it."""
    return F.xxhash64(*columns, F.lit(seed)).cast("double") / F.lit(2.0**64) + F.lit(0.5)


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 1


def decode_texts(column: pa.Array) -> list[str | None]:
    """Strings of an Arrow column; bytes that aren't UTF-8 become U+FFFD."""
    return [None if x is None else x.decode("utf-8", "replace") for x in byte_texts(column)]


def byte_texts(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text."""
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def append_columns(df: DataFrame, fields: StructType, make: Callable[[], Callable[[pa.Array], list]], source: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """All columns of ``df`` and those of ``fields`` (replacing any of the same name), computed from one column.

    ``make`` runs once a task and returns a function from an Arrow array to one list or array per new column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = set(fields.names)
    kept = [c for c in df.columns if c not in new or c == source]
    df = pick(df, *kept)
    out_kept = [c for c in kept if c not in new]
    schema = StructType([df.schema[c] for c in out_kept] + list(fields))
    arrow = to_arrow_schema(fields)
    at, keep_at = kept.index(source), [kept.index(c) for c in out_kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for whole in batches:
            for batch in slices(whole, at, limit):
                made = function(batch.column(at))
                arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type) for x, f in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep_at), *arrays], names=schema.names)

    return df.mapInArrow(returning(run), schema)
