"""Operator 13: documents are tokenised, concatenated and cut into sequences of one length.

1. First pass: every document's ids (with the end id) are stored with the number of ids before it in its partition.
2. The partitions' totals, one row each, are summed over the partitions before them (``prefix.earlier``): where each starts.
3. Second pass: a document's place in the whole is its partition's start plus its own; it is cut wherever a window of
   ``capacity`` ids ends. Each piece is a record of where it lies in its document and in its sequence.

No row is exchanged: only the totals are. All windows are full but for what is left at the end, which becomes sequences of
powers of two, its binary digits, longest first, so nothing needs padding.

Edge cases: a null or empty text is its end id alone; a null doc_id is kept; repeated rows are packed each; columns other
than doc_id and text are left out; an empty table gives no piece.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from papyrine.llm.bpe import RANK_FILE
from papyrine.llm.common import checkpoint_dir, decode_texts, pick, slices
from papyrine.llm.packing import END_ID, _tokenizer
from papyrine.llm.prefix import earlier

CAPACITY = 1024
#: Partitions whose starts (16 bytes each) are broadcast at most; those of more are joined by an exchange.
BROADCAST_STARTS = 1_000_000


def store_ids(df: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``df``'s (doc_id, text) as doc_id, __pid, before (ids before it in its partition), doc_tokens, width and ids.

    ids are little-endian numbers of ``width`` bytes: two where all are below 65536, else four.
    """
    path = path or public_tokenizers.path(RANK_FILE)
    df, spark = pick(df, "doc_id", "text"), df.sparkSession
    schema = StructType([df.schema["doc_id"], StructField("__pid", LongType()), StructField("before", LongType()), StructField("doc_tokens", LongType()), StructField("width", IntegerType()), StructField("ids", BinaryType())])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, before = _tokenizer(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1):
                out: list[list] = [[], [], [], []]
                for text in decode_texts(batch.column(1)):
                    ids = np.frombuffer(encode(text or "") + end, "<u4")
                    width = 2 if ids.max() < 1 << 16 else 4
                    for to, x in zip(out, (before, len(ids), width, ids.astype(f"<u{width}").tobytes())):
                        to.append(x)
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pid] * batch.num_rows, pa.int64()), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary())))], names=schema.names)

    folder = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    df.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def ends(total: int, capacity: int) -> np.ndarray:
    """Where the sequences after the last full window end."""
    rest = total % capacity
    return total - rest + np.cumsum([1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], dtype=np.int64)


def concat_pack(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False, broadcast_starts: int = BROADCAST_STARTS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; if asked for, its ids (four bytes each)."""
    stored = store_ids(df, end_id, path)
    totals = stored.groupBy("__pid").agg(F.sum("doc_tokens").alias("n"))
    total, partitions = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    starts = earlier(totals, [], "__pid", ["n"])
    placed = stored.join(F.broadcast(starts) if partitions <= broadcast_starts else starts, "__pid")
    placed = placed.select("doc_id", "doc_tokens", "width", (F.col("n") + F.col("before")).alias("at"), "ids")
    fields = [stored.schema["doc_id"], *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(StructField("ids", BinaryType()))
    names, full, tail = [f.name for f in fields], total // capacity, ends(total, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[list] = [[] for _ in names[1:]]
            for i, (n, width, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                ids = np.frombuffer(batch.column(4)[i].as_buffer(), f"<u{width}").astype("<u4")
                inner = np.arange(at // capacity + 1, min((at + n - 1) // capacity, full) + 1) * capacity
                cuts = np.unique(np.concatenate([[at], inner, tail[(tail > at) & (tail < at + n)], [at + n]])).tolist()
                for a, b in zip(cuts, cuts[1:]):
                    sequence, offset = a // capacity, a % capacity
                    if sequence == full:
                        k = int(np.searchsorted(tail, a, "right"))
                        sequence, offset = full + k, a - (int(tail[k - 1]) if k else full * capacity)
                    part = ids[a - at : b - at].tobytes()
                    rows.append(i)
                    for to, x in zip(out, (a - at, b - a, zlib.crc32(part), n, sequence, offset, part)):
                        to.append(x)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(out, kinds))], names=names)

    return placed.mapInArrow(run, StructType(fields))
