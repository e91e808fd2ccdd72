"""Near copies by MinHash signatures in bands (Broder 1997; Leskovec, Rajaraman and Ullman, ch. 3) of five-word shingles.

1. One pass over the texts gives each its set's digest, its size and a hash of each band of its signature. Equal sets are one
   class from here on, so exact copies are never compared.
2. In each bucket (band, hash) every class is paired with the bucket's least class, a star. Pairs are verified on whole sets,
   in blocks to which a set goes once.
3. Classes that share a bucket but aren't yet in one component are paired too, those already tested left out; buckets of many
   are split into chunks for that. So every pair that shares a bucket is either verified or already connected: nothing is
   dropped, and a group of very many copies costs its stars, not all of its pairs.
4. Components of the verified links (``joins.components``).

With 20 bands of 5 a pair of similarity 0.8 shares a bucket with a chance of 0.9996, one of 0.9 always but for 1 in 10**8.

Edge cases: a text of fewer than five words has its whole sequence as its one shingle; a null text or one without a word is
a class of its own, linked to none; null ids count in a class but never are its id (a class of null ids only has a null id);
a repeated id is in the class of each of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from papyrine.operators.joins import blocks, components, look_up, only_of, stored
from papyrine.operators.shingles import PORTION, by_text, hash_words, mix, ngrams

N, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
#: Classes of a bucket that are paired together.
CHUNK = 500
_ODD = (np.random.default_rng(7).integers(0, 1 << 62, BANDS * ROWS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = np.random.default_rng(8).integers(0, 1 << 62, BANDS * ROWS).astype(np.uint64)


def shingle_sets(hashed: np.ndarray, begins: np.ndarray, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    all_ = ngrams(hashed, n)
    for a, b in zip(begins[:-1], begins[1:]):
        yield np.unique(all_[a : b - n + 1] if b - a >= n else ngrams(hashed[a:b], b - a) if b > a else all_[:0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of the permuted shingles."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[k : k + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least.reshape(BANDS, ROWS)[:, k])
    return out


def digest(shingles: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    return int(mix(mix(shingles).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(shingles))).view(np.int64)[0])


def sketches(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, class, size, bands) of ``docs``' (doc_id, text): a set's digest, its number of shingles and its bands' hashes."""

    def work(hashed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        sets = list(shingle_sets(hashed, begins, n))
        bands = [band_hashes(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
        return np.arange(len(sets)), [pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]

    return by_text(docs.select("doc_id", "text"), StructType([StructField("class", LongType()), StructField("size", LongType()), StructField("bands", ArrayType(LongType()))]), work)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(class, set) of ``docs``; a set as sorted numbers of eight bytes."""

    def work(hashed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        sets = list(shingle_sets(hashed, begins, n))
        return np.arange(len(sets)), [pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

    return by_text(docs.select("doc_id", "text"), StructType([StructField("class", LongType()), StructField("set", BinaryType())]), work).select("class", "set")


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``pairs`` (a, b) of classes whose sets' Jaccard similarity is ``similar`` or more, and it."""
    pairs, needed = blocks(pairs)
    table = sets.join(needed.groupBy("class").agg(F.count("*").alias("n")), "class")
    sent = look_up(needed, stored(table, "sets"), "class", "n", payload="set")

    def run(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        held = {name: np.frombuffer(x.as_buffer(), np.uint64) for name, x in zip(sent.column("class").to_pylist(), sent.column("set"))}
        score = np.zeros(pairs.num_rows)
        for i, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
            x, y = held[a], held[b]
            common = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
            score[i] = common / (len(x) + len(y) - common)
        keep = score >= similar
        return pa.table({"a": pairs.column("a").filter(pa.array(keep)), "b": pairs.column("b").filter(pa.array(keep)), "jaccard": score[keep]})

    compared = pairs.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, "a long, b long, jaccard double")
    return stored(compared, "verified")


def stars(buckets: DataFrame, similar: float) -> DataFrame:
    """Each class of a bucket with the bucket's least, where their sizes don't rule it out."""
    least = buckets.groupBy("bucket").agg(F.min(F.struct("class", "size")).alias("hub"), F.count("*").alias("n"))
    paired = look_up(buckets, least, "bucket", "n").where("class <> hub.class")
    return paired.where(_sizes_fit(F.col("size"), F.col("hub.size"), similar)).select(F.col("hub.class").alias("a"), F.col("class").alias("b")).distinct()


def _sizes_fit(x, y, similar: float):
    return F.least(x, y) >= F.greatest(x, y) * F.lit(similar)


def across(buckets: DataFrame, roots: DataFrame, similar: float, chunk: int = CHUNK) -> DataFrame:
    """The pairs of classes of one bucket in different components, where their sizes don't rule it out."""
    placed = buckets.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket", "n")
    rows = look_up(stored(placed, "placed"), mixed.withColumn("k", F.col("n")), "bucket", "n")
    chunks = F.ceil(F.col("k") / chunk)
    left = rows.withColumn("chunk", F.pmod(F.col("class"), chunks)).select("bucket", "chunk", F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("root").alias("root_a"))
    right = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).select("bucket", "chunk", F.col("class").alias("b"), "size", "root")
    return left.join(right, ["bucket", "chunk"]).where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root")) & _sizes_fit(F.col("size_a"), F.col("size"), similar)).select("a", "b").distinct()


def near_copies(docs: DataFrame, n: int = N, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, size, class_id, component_id): the least doc_id with the same set of shingles, and the least that links reach."""
    docs = docs.select("doc_id", "text")
    found = stored(sketches(docs, n), "sketches", PORTION)
    classes = stored(found.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("n")), "classes")
    # the band's number is in its hash
    each = classes.select("class", "size", F.explode("bands").alias("bucket"))
    buckets = stored(look_up_shared(each), "buckets")
    pairs = stored(stars(buckets, similar), "stars")
    members = buckets.select("class").distinct().join(classes.select("class", "class_id"), "class")
    texts = only_of(docs, members.select("class_id"), "doc_id")
    sets = stored(_sets(texts, n).dropDuplicates(["class"]), "class-sets", PORTION)
    links = verified(pairs, sets, similar)
    more = stored(across(buckets, components(links), similar, chunk).join(pairs, ["a", "b"], "left_anti"), "across")
    links = links.unionByName(verified(more, sets, similar))
    roots = components(links)
    named = roots.join(classes.select(F.col("class").alias("node"), "class_id"), "node")
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n"))
    groups = look_up(named, least, "root", "n").select(F.col("node").alias("class"), "component_id")
    table = classes.select("class", "class_id", "n").join(groups, "class", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    empty = found.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return look_up(found.where("size > 0"), table, "class", "n").select("doc_id", "size", "class_id", "component_id").unionByName(empty)


def look_up_shared(each: DataFrame) -> DataFrame:
    """The rows of buckets that more than one class is in."""
    counts = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return look_up(each, counts, "bucket", "n")
