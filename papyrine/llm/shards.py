"""Shards of documents and exact global counts for them.

A shard is one stored row with the documents of up to ``limit`` bytes of text. Counting over all shards is an exchange:
each shard sends its distinct item hashes once, with its own counts, to buckets by the hashes' leading bits; a bucket sums
them and sends each shard the totals of what it asked for. However common an item is, it is one entry a shard, so no key
is hot, and the bytes moved are packed, sorted differences rather than rows. Shards are stored as a table bucketed by their
names, so the totals come to them and they are never exchanged themselves.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import byte_texts, checkpoint_dir, materialize, pick, returning, slices

#: Distinct hashes that a bucket is meant to hold; buckets there are at least.
PER_BUCKET, LEAST_BUCKETS = 4_000_000, 64
#: Buckets of a table of shards: as many as the input's partitions, within these bounds.
LEAST_PARTS, MOST_PARTS = 12, 50_000


class Counted(Protocol):
    """An open shard: for each round its sorted distinct hashes with their counts in it, and what it does with the totals."""

    def items(self, number: int) -> tuple[np.ndarray, np.ndarray]: ...

    def learn(self, number: int, hashes: np.ndarray, total: np.ndarray) -> None: ...


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def words(text: bytes | None) -> list[bytes]:
    """Words in ASCII lower case."""
    return text.lower().split() if text else []


def word_hashes(documents: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of all words, one after another."""
    distinct = list(set().union(*documents)) if documents else []
    table = dict(zip(distinct, map(xxhash.xxh64_intdigest, distinct)))
    return np.fromiter((table[w] for d in documents for w in d), np.uint64, sum(map(len, documents)))


def whole_docs(batch: pa.RecordBatch) -> tuple[bytes, int]:
    """The documents as an Arrow stream, and their number of words."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), sum(len(words(t)) for t in byte_texts(batch.column(1)))


def make_shards(df: DataFrame, limit: int, name: str, store: Callable[[pa.RecordBatch], tuple[bytes, int]] = whole_docs) -> DataFrame:
    """Stored rows (shard, n_docs, n_words, docs) of ``df``'s (doc_id, text); docs and n_words are what ``store`` gives."""
    df = pick(df, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            docs = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, n_words = store(docs)
            row = (f"{task}-{made}", docs.num_rows, n_words, data)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "n_docs", "n_words", "docs"])

        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                held.append(batch)
                size += batch.nbytes
                if size >= limit:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    parts = min(MOST_PARTS, max(LEAST_PARTS, df.rdd.getNumPartitions()))
    made = df.mapInArrow(returning(run), "shard string, n_docs long, n_words long, docs binary")
    made.write.bucketBy(parts, "shard").option("path", f"{checkpoint_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def open_docs(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)


def totals(shards: DataFrame) -> tuple[int, int]:
    row = shards.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_words"))).first()
    return tuple(row)


def count_globally(shards: DataFrame, load: Callable[[bytes], Counted], expected: int, then: Callable[[Any], Iterator[pa.RecordBatch]], schema: str, rounds: int = 1) -> DataFrame:
    """``then`` of each shard, opened by ``load``, after it has learnt the totals of what it asks for in each of the rounds.

    What a shard asks for in a round may depend on what it learnt before; ``expected`` is the number of items of a round.
    """
    bits = max(LEAST_BUCKETS, math.ceil(expected / PER_BUCKET)).bit_length() - 1
    shift = np.uint64(64 - bits)

    def ask(shard: str, opened: Counted, number: int) -> pa.RecordBatch:
        hashes, counts = opened.items(number)
        cut = np.searchsorted(hashes >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = [(b, int(x), int(y)) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([pack_sorted(hashes[x:y]) for _, x, y in rows], pa.binary()), pa.array([pack(counts[x:y].astype(np.uint32)) for _, x, y in rows], pa.binary())], names=["shard", "bucket", "hashes", "counts"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield ask(shard, load(data), 0)

    def answer(number: int, table: pa.Table) -> pa.Table:
        shard, bucket = table.column("shard"), table.column("bucket")
        parts = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)[at]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"shard": shard, "round": pa.array([number] * len(parts), pa.int32()), "bucket": bucket, "totals": pa.array([pack(t) for t in np.split(total, ends[:-1])], pa.binary())})

    def learnt(documents: pa.Table, answers: pa.Table, so_far: int) -> Iterator[tuple[str, Counted]]:
        order = np.lexsort((answers.column("bucket").to_numpy(), answers.column("round").to_numpy()))
        number, parts = answers.column("round").to_pylist(), answers.column("totals").to_pylist()
        totals = [np.concatenate([np.zeros(0, np.int64), *(unpack(parts[i], np.int64) for i in order if number[i] == k)]) for k in range(so_far)]
        for shard, data in zip(documents.column("shard").to_pylist(), documents.column("docs").to_pylist()):
            opened = load(data)
            for k, total in enumerate(totals):
                opened.learn(k, opened.items(k)[0], total)
            yield shard, opened

    def next_(number: int, documents: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([ask(shard, opened, number) for shard, opened in learnt(documents, answers, number)])

    def finish(documents: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([x for _, opened in learnt(documents, answers, rounds) for x in then(opened)])

    docs, asks, told = shards.select("shard", "docs"), "shard string, bucket int, hashes binary, counts binary", "shard string, round int, bucket int, totals binary"
    known: list[DataFrame] = []
    for k in range(rounds):
        if k:
            asked = docs.groupBy("shard").cogroup(reduce(DataFrame.unionByName, known).groupBy("shard")).applyInArrow(_named(partial(next_, k)), asks)
        else:
            asked = docs.mapInArrow(first, asks)
        answered = asked.groupBy("bucket").applyInArrow(_one(partial(answer, k)), told)
        known.append(materialize(answered, "totals") if rounds > 1 else answered)
    return docs.groupBy("shard").cogroup(reduce(DataFrame.unionByName, known).groupBy("shard")).applyInArrow(finish, schema)


def _one(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    return lambda table: f(table)


def _named(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda left, right: f(left, right)
