"""Operator 9: best-fit packing of tokenised documents into fixed-length sequences.

Only the number of pieces of each length decides a packing, so the plan is made on the driver from a histogram of at most
``capacity`` counts and never grows with the input:

1. Martello-Toth reduction: going down the lengths, a set of at most three pieces that dominates every other set with its
   longest piece (an exact complement; a best partner that nothing else can beat; a pair that no other pair can beat) is
   fixed for good, as many times as its pieces last.
2. What remains is packed best-fit decreasing, whole runs of equal pieces into whole runs of equal sequences.

The plan is a list of runs "pieces of this length and rank lo..hi go to sequences s.. at this offset". Pieces get their rank
within their length from salted buckets of bounded size, so one very common length isn't one task.

Edge cases: a null or empty text is one piece of length 1 (its end-of-text id 0); a null doc_id is kept; repeated rows are
packed each; a document longer than the capacity is cut, its first piece taking the remainder; an empty table gives none.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from papyrine.llm.bpe import RANK_FILE, encoder
from papyrine.llm.common import decode_texts, materialize, pick, returning, slices

CAPACITY = 2048
END_ID = 0
#: Fixed value: the vocabulary's added token, which the tokenizers library finds in texts before it splits them.
ADDED = (("<|endoftext|>", 50256),)
#: Pieces of one length that are ranked together.
BUCKET = 500
#: Buckets of one length whose counts are summed together.
STRETCH = 1000
#: A run of white space that tiktoken's matcher isn't given: it gives up on runs some hundred times as long.
LONG_RUN = 5000
LONG_BLANK = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(2)
def _tokenizer(path: str, added: tuple[tuple[str, int], ...] = ADDED) -> Callable[[str], bytes]:
    """One per worker process and rank file: the packed little-endian ids of a text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = dict(added)
    library = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=known)
    either = re.compile("(" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + ")") if known else None

    def by_part(text: str) -> bytes:
        parts = either.split(text) if either else [text]
        return b"".join(known[x].to_bytes(4, "little") if x in known else encoder(path).whole(x) for x in parts if x)

    def run(text: str) -> bytes:
        if len(text) >= LONG_RUN and LONG_BLANK.search(text):
            return by_part(text)
        return np.frombuffer(array("I", library.encode(text, allowed_special="all")), np.uint32).astype("<u4", copy=False).tobytes()

    return run


def split_pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """One row for each piece of ``df``'s (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    The ids are those of the tokenizers library on the same vocabulary, with its added tokens; tiktoken gives the same ones
    faster. A text with a very long run of white space goes through ``bpe.Encoder``.
    """
    path = path or public_tokenizers.path(RANK_FILE)
    df = pick(df, "doc_id", "text")
    fields = [df.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    if with_ids:
        fields.append(StructField("ids", BinaryType()))
    end = int(end_id).to_bytes(4, "little")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path)
        for whole in batches:
            for batch in slices(whole, 1):
                rows: list[int] = []
                out: list[list] = [[] for _ in names[1:]]
                for i, text in enumerate(decode_texts(batch.column(1))):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = ids if len(cuts) == 2 else ids[4 * a : 4 * b]
                        rows.append(i)
                        for to, value in zip(out, (k, a, b - a, zlib.crc32(part), part)):
                            to.append(value)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(out, kinds))], names=names)

    return df.mapInArrow(returning(run), StructType(fields))


class Plan:
    """Runs of (length, first rank, count, first sequence, offset), and the number of sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < k <= capacity or v < 0 for k, v in histogram.items()):
            raise ValueError("lengths must lie between 1 and the capacity")
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.left = [0] * (capacity + 1)
        for k, v in histogram.items():
            self.left[k] += v
        self.next = [0] * (capacity + 1)
        self.runs: list[tuple[int, int, int, int, int]] = []
        while self._reduce():
            pass
        self.fixed = self.sequences
        self._best_fit()

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next[length], n, sequence, offset))
        self.next[length] += n
        self.left[length] -= n

    def _fix(self, lengths: tuple[int, ...], n: int) -> None:
        offset = 0
        for length in lengths:
            self._place(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def _times(self, lengths: tuple[int, ...]) -> int:
        return min(self.left[x] // lengths.count(x) for x in set(lengths))

    def _others(self, length: int, room: int) -> list[int]:
        """Lengths at hand up to ``room`` beside one piece of ``length``, ascending."""
        return [x for x in range(1, room + 1) if self.left[x] - (x == length) > 0]

    def _reduce(self) -> bool:
        """One pass over the lengths, longest first; true if it fixed anything."""
        before = self.sequences
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                found = self._dominant(length)
                if not found:
                    break
                self._fix(found, self._times(found))
        return self.sequences > before

    def _dominant(self, length: int) -> tuple[int, ...] | None:
        room = self.capacity - length
        if room and self.left[room] - (room == length) > 0:
            return (length, room)
        others = self._others(length, room)
        if not others:
            return (length,)
        best = others[-1]
        have = lambda x: self.left[x] - (x == length)
        small: list[int] = []
        for x in others:
            small += [x] * min(3 - len(small), have(x))
            if len(small) == 3:
                break
        if len(small) < 2 or small[0] + small[1] > room:
            return (length, best)
        if len(small) == 3 and sum(small) <= room:
            return None
        pair, a, b = (0, 0), 0, len(others) - 1
        while a <= b:
            total = others[a] + others[b]
            if total > room or a == b and have(others[a]) < 2:
                b -= 1
            else:
                if total > sum(pair):
                    pair = (others[b], others[a])
                a += 1
        if not sum(pair) or best >= sum(pair):
            return (length, best)
        if pair[0] == best:  # it dominates if no pair has both pieces shorter than best and longer than its second
            between = [x for x in others if pair[1] < x < best]
            if not between or between[0] + (between[0] if have(between[0]) > 1 else between[1] if len(between) > 1 else self.capacity) > room:
                return (length, *pair)
        return None

    def _best_fit(self) -> None:
        capacity = self.capacity
        open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: runs of (first sequence, count)
        for length in range(capacity, 0, -1):
            room = length
            while self.left[length]:
                while room <= capacity and not open_[room]:
                    room += 1
                n = self.left[length]
                if room <= capacity:
                    first, count = open_[room].pop()
                    used = min(n, count)
                    self._place(length, used, first, capacity - room)
                    if used < count:
                        open_[room].append((first + used, count - used))
                    open_[room - length].append((first, used))
                    room = length
                    continue
                each = capacity // length
                full, rest = divmod(n, each)
                for held, times in ((each, full), (rest, 1)):
                    if held and times:
                        for k in range(held):
                            self._place(length, times, self.sequences, k * length)
                        open_[capacity - held * length].append((self.sequences, times))
                        self.sequences += times
        self.waste = sum(room * count for room, runs in enumerate(open_) for _, count in runs)


def pack(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``split_pieces`` with sequence_id (0..) and offset; as few sequences as the plan finds."""
    pieces = materialize(split_pieces(df, capacity, end_id, with_ids).withColumn("__at", F.monotonically_increasing_id()), "pieces")
    return assign(pieces, capacity)


def assign(stored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``stored`` (a stored table with length and a different ``__at`` in each row) its place."""
    spark = stored.sparkSession
    pieces = stored.drop("__at")
    histogram = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(Plan(histogram, capacity).runs)
    # 'capacity' rows at most: broadcast by construction
    share = spark.createDataFrame([(k, 1 + v // BUCKET) for k, v in sorted(histogram.items())], "length long, buckets long")
    salted = stored.join(F.broadcast(share), "length").withColumn("bucket", F.pmod(F.xxhash64("__at"), F.col("buckets"))).drop("buckets")
    # running totals over buckets, and over stretches of buckets before them, so no task sees all buckets of a length
    held = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("bucket") / STRETCH))
    so_far = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    stretches = held.groupBy("length", "stretch").agg(F.sum("n").alias("n")).select("length", "stretch", F.coalesce(F.sum("n").over(so_far("length", "stretch")), F.lit(0)).alias("before"))
    starts = held.withColumn("within", F.coalesce(F.sum("n").over(so_far("length", "stretch", "bucket")), F.lit(0))).join(stretches, ["length", "stretch"])
    starts = starts.select("length", "bucket", (F.col("before") + F.col("within")).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("__at")
    ranked = salted.withColumn("within", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("first") + F.col("within")).alias("rank"))
    table = np.array(runs, np.int64).reshape(-1, 5)
    base = table[:, 0] << 48 | table[:, 1]
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    length_at, rank_at, names = pieces.columns.index("length"), len(pieces.columns), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (length_at, rank_at))
            row = np.searchsorted(base, length << 48 | rank, "right") - 1
            found = table[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:rank_at], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=names)

    return ranked.mapInArrow(returning(run), schema)
