"""Passages that texts share with reference items word for word: seeds of n words, grouped by diagonal, extended as far as they go.

A hit is an n-gram of a document that an item has too; hits of one document and item on one diagonal (difference of the two
positions) without a gap are one maximal passage.

* The items' n-grams, when few enough (``BROADCAST_NGRAMS``, counted first), go to every task as one sorted array: documents
  are never exchanged, whatever their size or how frequent an n-gram is. A task holds about PORTION bytes of text and HITS
  hits at a time, however many rows it has.
* Else the documents' n-grams meet the items' by their hash in an exchange, an n-gram that holds many rows being dealt out in
  ``SPREAD`` parts of the documents' side; passages then come from windows over (document, item, diagonal).

Edge cases: a null or short text has no n-gram; repeated documents give their passages each; repeated items (same id and
text) count once, an id with two texts as two items; null ids are kept; n-grams that occur twice in an item or a document
give a passage on each diagonal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from papyrine.operators.joins import HOT, look_up, stored
from papyrine.operators.shingles import PORTION, by_text, hash_words, ngrams, portions, stretches, words

N = 5
#: N-grams of items that are sent to all tasks at most (24 bytes each).
BROADCAST_NGRAMS = 1_000_000
#: Hits of documents' n-grams on items' that a task holds at once; those of one n-gram (``jaccards``: of one text) go together.
HITS = 1 << 18
#: Parts of the documents' side of a frequent n-gram, and from how many rows on it is frequent.
SPREAD, FREQUENT = 64, 10_000
PASSAGE = ["doc_start", "doc_end", "item_start", "item_end"]


def longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def grams(df: DataFrame, n: int) -> DataFrame:
    """``df`` (any columns and text) without text, a row (hash, at) for each n-gram."""

    def work(hashed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        found = ngrams(hashed, n)
        row = np.searchsorted(begins, np.arange(len(found)), "right") - 1
        inside = np.arange(len(found)) + n <= begins[row + 1]
        row = row[inside]
        return row, [pa.array(found[inside].view(np.int64)), pa.array(np.flatnonzero(inside) - begins[row])]

    return by_text(df, longs("hash", "at"), work)


def runs(keys: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Maximal runs of equal keys' spans, each of which begins right after the one before: their keys, first and last."""
    order = np.lexsort((first, *reversed(keys)))
    keys, first, last = [k[order] for k in keys], first[order], last[order]
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != last[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return [k[start] for k in keys], first[start], last[np.append(start[1:], len(last))[: len(start)] - 1]


def _items(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Stored (item_id, text, item) of distinct items, and (item, hash, at) of their n-grams."""
    items = items.select("item_id", "text").dropDuplicates().withColumn("item", F.monotonically_increasing_id())
    items = stored(items, "items")
    return items, stored(grams(items.drop("item_id"), n), "item-ngrams", PORTION)


def _named(found: DataFrame, items: DataFrame) -> DataFrame:
    """``found`` with item_id in place of item; any number of rows may be of one item."""
    found = stored(found, "found")
    counted = found.groupBy("item").agg(F.count("*").alias("n")).join(items.select("item", "item_id"), "item")
    return look_up(found, counted, "item", "n")


def passages(docs: DataFrame, items: DataFrame, n: int = N, broadcast_ngrams: int = BROADCAST_NGRAMS) -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, item_start, item_end): word positions from 0, ends exclusive. Texts in ``text``."""
    docs = docs.select("doc_id", "text")
    items, known = _items(items, n)
    if known.count() <= broadcast_ngrams:
        found = _in_tasks(docs, known, ["hash", "item", "at"], ["item", *PASSAGE], passages_of, n).join(F.broadcast(items.select("item", "item_id").join(known, "item", "left_semi")), "item")
    else:
        found = _named(_by_exchange(docs, known, n), items)
    return found.select("doc_id", "item_id", *PASSAGE)


def jaccards(docs: DataFrame, items: DataFrame, n: int = N, broadcast_ngrams: int = BROADCAST_NGRAMS) -> DataFrame:
    """(doc_id, item_id, shared, jaccard, containment) of the sets of n-grams of each document and item that share one.

    Containment is the share of the item's set. A repeated document has a row for each.
    """
    docs = docs.select("doc_id", "text")
    items, known = _items(items, n)
    known = stored(known.select("hash", "item").distinct(), "item-sets")
    if known.count() <= broadcast_ngrams:
        found = _in_tasks(docs, known, ["hash", "item"], ["size", "item", "shared"], sets_of, n)
    else:
        seeds = stored(grams(docs.withColumn("row", F.monotonically_increasing_id()), n).select("row", "doc_id", "hash").distinct(), "sets", PORTION)
        met = _meet(seeds, known, FREQUENT).groupBy("row", "item").agg(F.count("*").alias("shared"))
        found = stored(seeds.groupBy("row", "doc_id").agg(F.count("*").alias("size")).join(met, "row").drop("row"), "found")
    sizes = known.groupBy("item").agg(F.count("*").alias("item_size")).join(items.select("item", "item_id"), "item")
    counted = found.groupBy("item").agg(F.count("*").alias("n")).join(sizes, "item")
    rows = look_up(found, counted, "item", "n")
    return rows.select("doc_id", "item_id", "shared", (F.col("shared") / (F.col("size") + F.col("item_size") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("item_size")).alias("containment"))


#: A word with the white space before it.
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def characters(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``passages`` with start and end: the positions of their first character and after their last one in the document's text.

    Ids must be unique; a passage without its document, or beyond its words, is left out.
    """
    pieces = docs.select("doc_id", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)).alias("pieces")).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    upto = lambda n: F.char_length(F.array_join(F.slice("pieces", F.lit(1), F.col(n).cast("int")), "")).cast("long")
    first = F.element_at("pieces", (F.col("doc_start") + 1).cast("int"))
    blank = F.char_length(F.regexp_extract(first, r"^[\x20\x09-\x0D]*", 0))
    both = found.join(pieces, "doc_id").where(F.col("doc_end") <= F.size("pieces"))
    return both.withColumns({"start": upto("doc_start") + blank, "end": upto("doc_end")}).drop("pieces")


def _seeds(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of ``texts``: hash, text and position, sorted by text and position."""
    all_, begins = words(texts)
    found = ngrams(hash_words(all_), n).view(np.int64)
    row = np.searchsorted(begins, np.arange(len(found)), "right") - 1
    inside = np.flatnonzero(np.arange(len(found)) + n <= begins[row + 1])
    row = row[inside]
    return found[inside], row, inside - begins[row]


def _entries(low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries low, low + 1, .. (``many``) of each seed: the seed's number and the entry."""
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]


def passages_of(texts: pa.Array, hashes: np.ndarray, items: np.ndarray, ats: np.ndarray, n: int, most: int = HITS) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, item, *PASSAGE) of the passages in the entries sorted by hash, from about ``most`` hits at a time.

    A run that reaches the end of a stretch of hits goes on in the next one.
    """
    found, row, at = _seeds(texts, n)
    low = np.searchsorted(hashes, found)
    many = np.searchsorted(hashes, found, "right") - low
    hit = np.flatnonzero(many)
    row, at, low, many = row[hit], at[hit], low[hit], many[hit]
    going = [np.zeros(0, np.int64)] * 5
    for a, b in stretches(many, most):
        of, entry = _entries(low[a:b], many[a:b])
        here = at[a:b][of]
        *keys, first, last = (np.append(old, new) for old, new in zip(going, [row[a:b][of], items[entry], here - ats[entry], here, here]))
        keys, first, last = runs(keys, first, last)
        open_ = (keys[0] == row[b - 1]) & (last == at[b - 1]) & (b < len(many))
        going = [x[open_] for x in (*keys, first, last)]
        doc, item, diagonal, first, last = (x[~open_] for x in (*keys, first, last))
        yield doc, item, first, last + n, first - diagonal, last + n - diagonal


def sets_of(texts: pa.Array, hashes: np.ndarray, items: np.ndarray, n: int, most: int = HITS) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, size, item, shared) of the texts' sets that share entries, sorted by hash, from about ``most`` hits at a time.

    The hits of one text, at most the number of entries, go together.
    """
    found, row, _ = _seeds(texts, n)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    found, row = found[new], row[new]
    size = np.bincount(row, minlength=len(texts))
    low = np.searchsorted(hashes, found)
    many = np.searchsorted(hashes, found, "right") - low
    hit = np.flatnonzero(many)
    row, low, many = row[hit], low[hit], many[hit]
    begins = np.searchsorted(row, np.arange(len(texts) + 1))
    upto = np.append(0, np.cumsum(many))
    for a, b in stretches(np.diff(upto[begins]), most):
        part = slice(begins[a], begins[b])
        of, entry = _entries(low[part], many[part])
        doc, item = row[part][of], items[entry]
        order = np.lexsort((item, doc))
        doc, item = doc[order], item[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        start = np.flatnonzero(new)
        yield doc[start], size[doc[start]], item[start], np.diff(np.append(start, len(doc)))


def _in_tasks(docs: DataFrame, known: DataFrame, columns: list[str], names: list[str], work: Callable[..., Iterator[tuple[np.ndarray, ...]]], n: int) -> DataFrame:
    """(doc_id, *names) of ``work`` on the texts and ``columns`` of ``known``, which go to every task, sorted by them."""
    table = known.orderBy(*columns).toArrow()  # its size was checked
    sent = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in columns))
    schema = StructType([docs.schema["doc_id"], *longs(*names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1):
                for text, *made in work(batch.column(1), *sent.value, n):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text, pa.int64())), *(pa.array(x, pa.int64()) for x in made)], names=schema.names)

    return stored(docs.mapInArrow(run, schema), "found", PORTION)


def _meet(seeds: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """``seeds`` (row, hash, ..) with each of ``known`` (hash, ..) of their hash; a frequent hash's seeds are dealt out in SPREAD parts."""
    counts = stored(seeds.groupBy("hash").agg(F.count("*").alias("rows")), "ngram-counts")
    frequent = F.col("rows") > max(least, (counts.agg(F.sum("rows")).first()[0] or 0) / HOT)  # so there are fewer than HOT
    often = F.broadcast(counts.where(frequent).select("hash", F.lit(SPREAD).alias("parts")))
    parts = F.when(frequent, SPREAD).otherwise(1)
    spread = known.join(counts, "hash").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("rows")
    dealt = seeds.join(often, "hash", "left").withColumn("part", F.pmod(F.xxhash64(*seeds.columns), F.coalesce("parts", F.lit(1))).cast("int"))
    return dealt.join(spread, ["hash", "part"]).drop("part", "parts")


def _by_exchange(docs: DataFrame, known: DataFrame, n: int, least: int = FREQUENT) -> DataFrame:
    seeds = stored(grams(docs.withColumn("row", F.monotonically_increasing_id()), n), "ngrams", PORTION)
    hits = _meet(seeds, known.withColumnRenamed("at", "item_at"), least).select("row", "doc_id", "item", (F.col("at") - F.col("item_at")).alias("diagonal"), "at")
    along = Window.partitionBy("row", "item", "diagonal").orderBy("at")
    numbered = hits.withColumn("group", F.col("at") - F.row_number().over(along))
    joined = numbered.groupBy("row", "doc_id", "item", "diagonal", "group").agg(F.min("at").alias("first"), (F.max("at") + n).alias("end"))
    return joined.select("doc_id", "item", F.col("first").alias("doc_start"), F.col("end").alias("doc_end"), (F.col("first") - F.col("diagonal")).alias("item_start"), (F.col("end") - F.col("diagonal")).alias("item_end"))
