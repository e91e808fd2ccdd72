"""Operator 5: SimHash near-duplicates, linked through pivot distance tables.

Distinct fingerprints go to every group that one of the key masks sends them to. With the exact masks two fingerprints
that differ in at most ``radius`` bits agree on at least one mask, so no link is lost. In a group, the Hamming distances
to many reference fingerprints (pivots) are computed once; a pair is discarded as soon as one coordinate differs by more
than the radius (the first coordinate by a sorted sweep that never forms such pairs), and what survives is verified bit
by bit. A group gives its links as a spanning forest of shortest links, so its output is no larger than itself; groups
over ``CHUNK`` fingerprints are split into pairs of chunks.

Edge cases: a null or empty text has the fingerprint zero, which links like any other; fewer words than a shingle count
as one shingle; null doc_ids are kept and never chosen as component_id unless all are null; repeated rows keep their rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from papyrine.llm.common import append_columns, byte_texts, join_spread, materialize, pick, returning, slices
from papyrine.llm.components import components
from papyrine.llm.shards import count_globally, make_shards, open_docs, pack, pack_sorted, unpack, unpack_sorted

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Reference fingerprints; the first two are all zeros and a half of ones, the rest pseudo-random.
PIVOTS = np.concatenate([np.array([0, 0x00000000FFFFFFFF], np.uint64), np.random.default_rng(20).integers(0, 2**64, 14, dtype=np.uint64)])
CHUNK = 2048
#: For near copies: hashes that a bucket is meant to hold.
PER_BUCKET = 1_000_000
#: Hashes of the sets that meet in one cell, of either side.
CELL = 400_000


def exact_masks(radius: int, blocks: int | None = None, agree: int = 2) -> list[int]:
    """Masks of ``agree`` whole blocks; at most ``radius`` differing bits leave at least one of them untouched."""
    blocks = blocks or radius + agree
    if blocks - radius < agree:
        raise ValueError("too few blocks for this radius")
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    return [sum(block[i] for i in some) for some in combinations(range(blocks), agree)]


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """ASCII-lower-cased word shingles with repeats; a shorter text is one shingle, one without words none."""
    words = text.lower().split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    join = b" ".join
    return list(map(join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Bit set if set in over half of the shingles' XXH64."""
    pieces = shingles(text, size)
    if not pieces:
        return 0
    digest = xxhash.xxh64_digest
    bits = np.unpackbits(np.frombuffer(b"".join([digest(s, SEED) for s in pieces]), np.uint8).reshape(-1, 8), axis=1)
    n = len(bits)
    whole = n // 255 * 255
    count = bits[whole:].sum(0, dtype=np.int64)
    if whole:  # partial sums of 255 rows fit a byte
        count += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text: str = "text", size: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``df`` with the 64-bit fingerprint of ``text`` as a long (its bits read as two's complement)."""

    def make():
        return lambda column: [[signed(fingerprint(t, size)) for t in byte_texts(column)]]

    return append_columns(df, StructType([StructField(name, LongType())]), make, text)


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Positions of a minimum spanning forest of the links (a, b) of length d between n rows."""
    label, kept = np.arange(n), []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        while True:
            at = at[label[a[at]] != label[b[at]]]
            if not len(at):
                break
            x, y = label[a[at]], label[b[at]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            _, one = np.unique(high, return_index=True)  # each higher root hooks to one lower root
            kept.append(at[one])
            to = np.arange(n)
            to[high[one]] = low[one]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def pivot_links(fp: np.ndarray, group: np.ndarray, radius: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest, by group, of the links within ``radius``: two arrays of fingerprints and their distances."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    fp, group, table = fp[order], group[order], np.ascontiguousarray(table[order].T)
    n = len(fp)
    found: list[np.ndarray] = []
    held = 0

    def reduce() -> None:
        nonlocal held
        if found:
            links = np.concatenate(found, axis=1)
            found[:] = [links[:, forest(*links, n)]]
            held = found[0].shape[1]

    i, gap = np.arange(n - 1), 1
    while len(i):
        i = i[i + gap < n]
        j = i + gap
        near = (group[i] == group[j]) & (table[0, j] - table[0, i] <= radius)
        i = i[near]
        a, b = i, i + gap
        for row in table[1:]:
            keep = np.abs(row[a] - row[b]) <= radius
            a, b = a[keep], b[keep]
        d = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
        keep = d <= radius
        if keep.any():
            found.append(np.stack([a[keep], b[keep], d[keep]]))
            held += int(keep.sum())
            if held > most:
                reduce()
        gap += 1
    reduce()
    if not found:
        none = np.zeros(0, np.int64)
        return fp[none], fp[none], none
    a, b, d = found[0]
    return fp[a], fp[b], d


def links(distinct: DataFrame, radius: int = RADIUS, masks: list[int] | None = None) -> DataFrame:
    """(a, b, d): links that connect what all pairs of ``distinct``'s fp within ``radius`` connect."""
    masks = masks or exact_masks(radius)
    keys = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("k")).select("k.t", "k.key", "fp")
    large = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    members = keys.join(large, ["t", "key"]).withColumn("own", own)
    members = members.select("t", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))).alias("c"))
    members = members.select("t", "key", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "fp")
    members = members.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("d", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: np.ndarray) -> pa.RecordBatch:
            change = np.r_[True, (table[1:, :4] != table[:-1, :4]).any(1)]
            a, b, d = pivot_links(table[:, 4].astype(np.int64).view(np.uint64), np.cumsum(change), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d, pa.int32())], names=schema.names)

        rest = np.zeros((0, 5), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
            if len(rest) < 50_000:
                continue
            cut = np.flatnonzero((rest[:, :4] != rest[-1, :4]).any(1))
            if len(cut):  # the last group may go on
                yield solve(rest[: cut[-1] + 1])
                rest = rest[cut[-1] + 1 :]
        if len(rest):
            yield solve(rest)

    return members.mapInArrow(returning(run), schema)


def near_duplicates(df: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``df``'s (doc_id, text)."""
    prints = materialize(fingerprints(pick(df, "doc_id", "text"), size=size).select("doc_id", "fp"), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, radius))
    labelled = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least")
    classes = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = labelled.join(classes, "root").select("fp", "component_id")
    whole = materialize(distinct.join(merged, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return join_spread(prints, whole, ["fp"], "n").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _shared(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in shingles(text, size)]), "<u8"))


def rare_first(found: np.ndarray, often: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the order by frequency and value, as long as a similar set can't lack all of it, and its frequencies."""
    order = np.lexsort((found, often))[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]
    return found[order], often[order]


def shared_enough(stored: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node): sets of which at least ``similarity`` of the hashes occur in other rows too; no other set has a similar one.

    Batches send their hashes packed, by leading bits, to buckets; a bucket sends back how many of each set's hashes it has
    seen more than once, and the sums decide. Nothing is cut off: a hash in very many sets is one entry a set.
    """
    words = stored.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    bits = max(64, math.ceil(words / PER_BUCKET)).bit_length() - 1
    shift = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1, 8 << 20):
                node, first = np.unique(batch.column(0).to_numpy(), return_index=True)
                sets = [shingle_set(t, size) for t in byte_texts(batch.column(1).take(pa.array(first)))]
                n = np.array([len(x) for x in sets], np.int64)
                sig, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), n).astype(np.uint32)
                order = np.argsort(sig, kind="stable")
                sig, of = sig[order], of[order]
                cut = np.searchsorted(sig >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
                out, name = [], f"{task}-{made}"
                for b, (x, y) in enumerate(zip(cut, cut[1:])):
                    if y > x:
                        whose = (None, None) if out else (pack(node), pack(n))  # one of the rows says whose hashes they are
                        out.append((name, b, pack_sorted(sig[x:y]), pack(of[x:y]), *whose))
                made += 1
                kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["batch", "bucket", "sig", "of", "node", "n"])

    def meet(table: pa.Table) -> pa.Table:
        sigs = [unpack_sorted(x) for x in table.column("sig").to_pylist()]
        _, at, many = np.unique(np.concatenate(sigs), return_inverse=True, return_counts=True)
        more = np.split(many[at] > 1, np.cumsum([len(x) for x in sigs])[:-1])
        seen = [pack(np.bincount(unpack(x, np.uint32)[y]).astype(np.uint32)) for x, y in zip(table.column("of").to_pylist(), more)]
        return pa.table({"batch": table.column("batch"), "seen": pa.array(seen, pa.binary()), "node": table.column("node"), "n": table.column("n")})

    def decide(table: pa.Table) -> pa.Table:
        node, n = (next(unpack(x, np.int64) for x in table.column(c).to_pylist() if x is not None) for c in ("node", "n"))
        total = np.zeros(len(n), np.int64)
        for x in table.column("seen").to_pylist():
            part = unpack(x, np.uint32)
            total[: len(part)] += part
        return pa.table({"node": node[(n > 0) & (total >= similarity * n - 1e-6)]})

    sent = stored.select("__node", "text").mapInArrow(returning(send), "batch string, bucket int, sig binary, of binary, node binary, n binary")
    answered = sent.groupBy("bucket").applyInArrow(meet, "batch string, seen binary, node binary, n binary")
    return answered.groupBy("batch").applyInArrow(decide, "node long").distinct()


def signatures(some: DataFrame, size: int, similarity: float) -> DataFrame:
    """(sig, node, n, pos): the prefix hashes that several of the sets of ``some`` (node, text, n) have, with sizes and places.

    Hashes are ordered by the number of sets of ``some`` that have them, rare ones first.
    """
    shards = make_shards(some.select(F.col("node").alias("doc_id"), "text"), 4 << 20, "near-shards")
    words = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    class Sets:
        def __init__(self, data: bytes):
            batch = open_docs(data)
            self.node, self.sets = batch.column(0).to_pylist(), [shingle_set(t, size) for t in byte_texts(batch.column(1))]

        def items(self, _: int) -> tuple[np.ndarray, np.ndarray]:
            return np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]), return_counts=True)

        def learn(self, _: int, hashes: np.ndarray, total: np.ndarray) -> None:
            self.hashes, self.total = hashes, total

    def cut(shard: Sets) -> Iterator[pa.RecordBatch]:
        out = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
        for node, found in zip(shard.node, shard.sets):
            sig, often = rare_first(found, shard.total[np.searchsorted(shard.hashes, found)], similarity)
            pos = np.flatnonzero(often > 1)
            out.append((sig[pos], np.full(len(pos), node, np.int64), np.full(len(pos), len(found), np.int64), pos))
        sig, node, n, pos = map(np.concatenate, zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))], names=["sig", "node", "n", "pos"])

    return count_globally(shards, Sets, words, cut, "sig long, node long, n int, pos int")


def similar_rows(sets: list[np.ndarray], root: np.ndarray, own: np.ndarray, inside: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of similar sets of different roots, a spanning forest of them; only of different ``own`` unless ``inside``."""
    n = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted, start = row[order], np.searchsorted(code[order], np.arange(int(code.max(initial=-1)) + 2))
    ends = np.cumsum(np.append(0, n))
    _, label = np.unique(root, return_inverse=True)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(sets)):
        some = code[ends[i] : ends[i + 1]]
        many = start[some + 1] - start[some]
        at = np.repeat(start[some] - (np.cumsum(many) - many), many)
        both = np.bincount(posted[at + np.arange(len(at))], minlength=len(sets))
        hit = np.flatnonzero((both >= similarity * (n + n[i] - both)) & (label > label[i]) & (inside | (own != own[i])))
        left.append(np.full(len(hit), i)), right.append(hit)
    a, b = np.concatenate(left), np.concatenate(right)
    kept = forest(label[a], label[b], np.zeros(len(a), np.int64), len(sets))
    return a[kept], b[kept]


def cells(batches: Iterator[pa.RecordBatch], work: Callable[[tuple, list], pa.RecordBatch], keys: int = 3) -> Iterator[pa.RecordBatch]:
    """``work`` of each cell's key and rows, which come one cell after another."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for row in zip(*(byte_texts(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield work(key, held)
                held, key = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield work(key, held)


def apart(rooted: DataFrame, some: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): links between similar sets that share a prefix hash but not yet a root, enough to connect them.

    The sets of a hash meet in cells of bounded size, and pairs stay inside their task: first sizes and places alone, then
    the texts of those that aren't ruled out. The sets of a hash's most frequent root are cut into cells with the others
    only, not with each other. A set of fewer than four hashes has no similar one but itself at 0.8.
    """
    rooted = rooted.where((F.col("n") - 1) / F.col("n") >= similarity - 1e-9)
    per_root = rooted.groupBy("sig", "root").agg(F.sum("n").alias("n"))
    top = per_root.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    top = top.select("sig", F.col("top.root").alias("first"), F.ceil(F.col("top.n") / CELL).cast("int").alias("g"), F.ceil((F.col("all") - F.col("top.n")) / CELL).cast("int").alias("o"))
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    big, g, o = F.col("root") == F.col("first"), F.col("g"), F.col("o")
    met = rooted.join(top, "sig").withColumn("own", F.when(big, F.pmod(F.xxhash64("node"), g)).otherwise(g + F.pmod(F.xxhash64("node"), o)).cast("int"))
    with_big = F.transform(F.sequence(F.lit(0), g - 1), lambda i: cell(i, F.col("own")))
    among = F.transform(F.sequence(g, g + o - 1), lambda k: cell(F.least("own", k), F.greatest("own", k)))
    into = F.when(big, F.transform(F.sequence(g, g + o - 1), lambda j: cell(F.col("own"), j))).otherwise(F.concat(with_big, among))
    met = met.select("sig", "node", "root", "own", "n", "pos", F.explode(into).alias("c")).select("sig", "c.i", "c.j", "own", "root", "node", "n", "pos")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(key: tuple, held: list) -> pa.RecordBatch:
            own, root, node, n, pos = np.array(held, np.int64).T
            needed = np.zeros(len(n), bool)
            for k in range(len(n)):
                least = np.minimum(n, n[k])
                hit = (root != root[k]) & (least >= similarity * np.maximum(n, n[k]) - 1e-6) & (np.minimum(n - pos, n[k] - pos[k]) * (1 + similarity) >= similarity * (n + n[k]) - 1e-6)
                needed[k] = (hit & ((key[1] == key[2]) | (own != own[k]))).any()
            m = int(needed.sum())
            return pa.RecordBatch.from_arrays([*(pa.array([x] * m, t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))), pa.array(own[needed], pa.int32()), pa.array(root[needed]), pa.array(node[needed])], names=["sig", "i", "j", "own", "root", "node"])

        return cells(batches, work)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(key: tuple, held: list) -> pa.RecordBatch:
            own, root, node = (np.array([x[k] for x in held], np.int64) for k in range(3))
            a, b = similar_rows([shingle_set(x[3], size) for x in held], root, own, key[1] == key[2], similarity)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        return cells(batches, work)

    in_cells = lambda df: df.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    left = materialize(in_cells(met).mapInArrow(returning(thin), "sig long, i int, j int, own int, root long, node long"), "cells")
    texts = left.join(some.select("node", "text"), "node").select("sig", "i", "j", "own", "root", "node", "text")
    return in_cells(texts).mapInArrow(returning(compare), "a long, b long")


def near_unique(df: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` less all but one of each group of near copies (the least doc_id stays; of null ids any).

    Texts are near copies if the Jaccard similarity of their sets of ``size``-word shingles (as 64-bit hashes) is at least
    ``similarity``; groups are what such links connect. Texts with the same set, known by its 64-bit hash, are one node.
    A set can only have a similar one if others share enough of its hashes (``shared_enough``); only these go on. Candidates
    are first what ``links`` finds by their fingerprints through pivot tables, and of each set the one of its hashes' least
    sets that it meets most often; then, since SimHash alone loses pairs at this similarity, all pairs that share a hash of
    their prefixes (Chaudhuri et al., 2006; two similar sets always do) and aren't connected yet (``apart``). Every link is checked on the whole sets before it counts.

    Edge cases: texts without words (null, empty, blank) are one group; a text shorter than a shingle is one shingle; of rows
    with one doc_id and one text the first read stays; an empty table gives an empty one; extra columns are kept as they are.
    """
    columns = df.columns

    def marks():
        def make(column: pa.Array) -> list:
            sets = [shingle_set(t, size) for t in byte_texts(column)]
            return [[signed(xxhash.xxh3_64_intdigest(s.tobytes(), SEED)) for s in sets], [len(s) for s in sets]]

        return make

    marked = append_columns(df, StructType([StructField("__node", LongType()), StructField("__n", LongType())]), marks)
    stored = materialize(marked.withColumn("__row", F.monotonically_increasing_id()), "marked")
    order = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("__row"))
    least = materialize(stored.groupBy(F.col("__node").alias("node")).agg(F.min(order).alias("o")), "nodes")
    picked = least.join(shared_enough(stored, size, similarity), "node").select("node", F.col("o.__row").alias("__row"))
    some = materialize(stored.select("__row", "text", F.col("__n").alias("n")).join(picked, "__row").select("node", "text", "n"), "candidates")
    shared = materialize(signatures(some, size, similarity), "signatures")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, center = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, part, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), byte_texts(batch.column(3))):
                found = shingle_set(text, size)
                if (a, part) != held:  # the center comes first
                    held, center = (a, part), found
                elif _shared(center, found) >= similarity:
                    out.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar; texts meet their pairs' a, in parts where it has many."""
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        cut = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
        met = cut.select("a", "part", F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = some.select("node", "text").join(met, "node").select("a", "part", "node", "text", (F.col("a") != F.col("node")).alias("later"))
        texts = texts.repartition("a", "part").sortWithinPartitions("a", "part", "later").drop("later")
        return materialize(texts.mapInArrow(returning(compare), "a long, b long"), "verified")

    def possible(p: str, q: str) -> Column:
        """Whether two sets whose first common hash is this one can be similar by their sizes and places."""
        n, m, i, j = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (p, q))
        fits = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
        return fits & (F.least(n - i, m - j) * (1 + similarity) >= similarity * (n + m) - 1e-6)

    prints = materialize(fingerprints(some, size=size).select("node", "fp"), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("node").alias("center"))
    same = prints.join(first, "fp").where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(x), F.col("center").alias(f"{x}_node")) for x in ("a", "b")]
    alike = links(first.select("fp")).select("a", "b").join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    entry = F.struct("node", "n", "pos")
    stars = shared.groupBy("sig").agg(F.min(entry).alias("p")).join(shared.select("sig", entry.alias("q")), "sig")
    stars = stars.where((F.col("p.node") < F.col("q.node")) & possible("p", "q")).groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(F.count("*").alias("n"))
    stars = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b")
    near = verified(materialize(stars.unionByName(same).unionByName(alike).distinct(), "pairs"))
    roots = components(near)
    rooted = shared.join(roots, "node", "left").select("sig", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    far = materialize(apart(rooted, some, size, similarity), "verified")
    stars = roots.where("node <> root").toDF("a", "b")  # they connect what ``near`` connects
    labelled = least.join(components(stars.unionByName(far)), "node", "left").select(F.coalesce("root", "node").alias("root"), "o")
    stay = labelled.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.__row").alias("__row"))
    return pick(stored.join(stay, "__row", "left_semi"), *columns)
