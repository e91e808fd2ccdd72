"""Operator 2: exact top-k search by BM25 over sharded inverted indexes with block-max WAND pruning.

Each shard holds an inverted index whose impacts use global document frequencies, counts and mean length (see ``shards``);
similar documents lie together in blocks, so that blocks differ in what they can score. For a query, the short lists (terms
in few documents of the shard) are read whole: their blocks' maxima are as long as they. For all other terms each block
has its largest impact. Their sum and the best by the short lists bound a block's scores. Blocks with the highest bounds
come first and give a threshold, as do the k best of the shards asked before, a few first and then more; only blocks whose bound
reaches it are completed, for all queries that need the block at once. What is skipped can't be among the k best, so each
shard's answer is exact, and so is the merge. Completed scores are sums of 32-bit products; what comes within their error of
a threshold is scored again in 64 bits. Queries go to the shards in sets of bounded size.

A document is never an answer to itself. Terms that occur in one document only can't match another and are left out of
the indexes. Edge cases: null and empty texts match nothing and ask for nothing; null doc_ids are answers but no queries;
ties go to the smaller doc_id (nulls last); repeated rows are separate answers; query rows that share an id keep the
k best answers of all of them, each row once by its best score; fewer than k answers are possible.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import byte_texts, materialize, pick
from papyrine.llm.shards import count_globally, make_shards, pack, pack_sorted, totals, unpack, unpack_sorted

K, K1, B = 10, 1.2, 0.75
SHARD_BYTES = 16 << 20
BLOCK = 128
#: Queries that a shard answers together.
TOGETHER, AT_ONCE = 256, 8
#: A term in more than one of so many documents of a shard has a long list there; so many of them put documents in order.
LONG, FEATURES = 32, 256
NO_ID = np.iinfo(np.int64).max
#: No sum of 32-bit products is off by as much, as a part of the largest possible score.
ERROR = 1e-5
#: Packed bytes of the queries that are sent to all shards at once; how many times as many shards each round asks.
PASS_BYTES, GROW = 32 << 20, 4


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct words (ASCII lower case), where each one's postings start, their documents and counts,
    and the documents' lengths."""
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(kind), "")))
    word = pc.list_flatten(split)
    document = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(word), 0)
    document = document[full.to_numpy(zero_copy_only=False)]
    coded = word.filter(full).dictionary_encode()
    n = len(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, byte_texts(coded.dictionary)), np.uint64, len(coded.dictionary))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(place[coded.indices.to_numpy(zero_copy_only=False)] * max(1, n) + document, return_counts=True)
    term, found = np.divmod(key, max(1, n))
    return hashes[order], np.searchsorted(term, np.arange(len(order) + 1)), found, tf, np.bincount(document, minlength=n)


def _store(batch: pa.RecordBatch) -> tuple[bytes, int]:
    """A shard's packed postings, and its number of words."""
    terms, first, document, tf, size = _terms(batch.column(1))
    row = [[pack_sorted(terms), pack(first.astype(np.int64)), pack(document.astype(np.int32)), pack(tf.astype(np.int32)), pack(size.astype(np.int64))], batch.column(0).to_pylist()]
    out = pa.RecordBatch.from_arrays([pa.array([row[0]], pa.list_(pa.binary())), pa.array([row[1]], pa.list_(pa.int64()))], names=["parts", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, out.schema) as stream:
        stream.write_batch(out)
    return sink.getvalue().to_pybytes(), int(size.sum())


def _load(data: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row = pa.ipc.open_stream(data).read_next_batch()
    terms, *rest = row.column(0)[0].as_py()
    return row.column(1)[0].as_py(), unpack_sorted(terms), *(unpack(x, kind) for x, kind in zip(rest, (np.int64, np.int32, np.int32, np.int64)))


class Shard:
    """An open shard and the total counts of its terms."""

    def __init__(self, data: bytes):
        self.parts = _load(data)

    def items(self, _: int) -> tuple[np.ndarray, np.ndarray]:
        return self.parts[1], np.diff(self.parts[2])

    def learn(self, _: int, hashes: np.ndarray, total: np.ndarray) -> None:
        self.total = total


class Block:
    """Queries that are asked together: their own ids, their terms as places in one sorted vocabulary, and the terms' weights
    (one each, unless they are given)."""

    def __init__(self, queries: list[tuple[int, np.ndarray]], weights: np.ndarray | None = None):
        self.weights = weights
        self.own = np.array([q for q, _ in queries], np.int64)  # those asked together should have terms in common, see ``alike``
        self.first = np.cumsum([0, *(len(t) for _, t in queries)])
        self.vocabulary, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t in queries)]), return_inverse=True)
        self.code = code.astype(np.int32)


def cluster(rows: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order in which similar columns of ``rows`` (terms, documents) lie together: halves along the main direction, and so on."""

    def split(some: np.ndarray) -> list[np.ndarray]:
        if len(some) <= block:
            return [some]
        x = rows[:, some]
        x = x - x.mean(1, keepdims=True)
        v = np.random.default_rng(len(some)).normal(size=len(some)).astype(np.float32)
        for _ in range(8):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) or 1.0
        order = some[np.argsort(v, kind="stable")]
        half = -(-len(some) // (2 * block)) * block
        return split(order[:half]) + split(order[half:])

    return np.concatenate(split(np.arange(rows.shape[1]))) if rows.shape[1] else np.zeros(0, np.int64)


def alike(queries: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """The queries in an order in which those that share frequent terms are asked together: a shard's products then have fewer terms."""
    block = Block(queries)
    often = np.argsort(-np.bincount(block.code, minlength=len(block.vocabulary)), kind="stable")[:FEATURES]
    row = np.full(len(block.vocabulary), -1)
    row[often] = np.arange(len(often))
    at, query = row[block.code], np.repeat(np.arange(len(queries)), np.diff(block.first))
    rows = np.zeros((len(often), len(queries)), np.float32)
    rows[at[at >= 0], query[at >= 0]] = 1
    return [queries[i] for i in cluster(rows, TOGETHER)]


def long_rows(n: int, first: np.ndarray, document: np.ndarray, impact: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Terms with long lists (the ``most`` frequent of them), and their impacts by document (terms, documents)."""
    size = np.diff(first)
    some = np.flatnonzero(size * LONG > n)
    if most is not None and len(some) > most:
        some = np.sort(some[np.argsort(-size[some], kind="stable")[:most]])
    rows = np.zeros((len(some), n), np.float32)
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[t], first[t + 1]) for t in some)])
    rows[np.repeat(np.arange(len(some)), size[some]), document[at]] = impact[at]
    return some, rows


class Index:
    """One shard: terms with their postings' impacts, and by block the impacts and maxima of the terms with long lists."""

    def __init__(self, ids: list, terms: np.ndarray, first: np.ndarray, document: np.ndarray, impact: np.ndarray):
        self.n, self.blocks = len(ids), -(-len(ids) // BLOCK)
        self.terms, self.first, self.document, self.impact = terms, first, document, impact
        self.repeats = max(Counter(i for i in ids if i is not None).values(), default=1)  # rows that may be the query itself
        self.known = np.array([i is not None for i in ids], bool)
        self.id = np.array([i or 0 for i in ids], np.int64)
        order = np.lexsort((self.id, ~self.known))
        self.rank = np.empty(len(order), np.int64)  # order among ties
        self.rank[order] = np.arange(len(order))
        term = np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(first))
        order = np.argsort(document.astype(np.uint16) if self.n <= 1 << 16 else document, kind="stable")  # the postings by document; 16 bits sort by radix
        self.by_term, self.by_impact = term[order], impact[order]
        self.start = np.searchsorted(document[order], np.arange(self.n + 1))
        some = np.flatnonzero(np.diff(first) * LONG > self.n)
        self.row = np.full(len(terms), -1)
        self.row[some] = np.arange(len(some))
        self.most, self.used, self.dense = np.zeros((len(some), self.blocks), np.float32), [], []
        for b in range(self.blocks):  # of each block only the rows that it has
            low, high = b * BLOCK, min(self.n, (b + 1) * BLOCK)
            some = slice(self.start[low], self.start[high])
            row = self.row[self.by_term[some]]
            has = np.bincount(row[row >= 0], minlength=len(self.most)) > 0
            dense = np.zeros((int(has.sum()), high - low), np.float32)
            dense[(np.cumsum(has) - 1)[row[row >= 0]], np.repeat(np.arange(high - low), np.diff(self.start[low : high + 1]))[row >= 0]] = self.by_impact[some][row >= 0]
            self.used.append(np.flatnonzero(has))
            self.dense.append(dense)
            self.most[has, b] = dense.max(1)

    def search(self, block: Block, k: int = K, least: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best for each query: numbers of queries, ascending; of documents, best first; and scores.

        Only what is over ``least``, or as good and of an id up to ``last``.
        """
        place = np.searchsorted(self.terms, block.vocabulary)
        place[place == len(self.terms)] = 0
        place[self.terms[place] != block.vocabulary if len(self.terms) else slice(None)] = -1
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for start in range(0, len(block.own) if self.n else 0, TOGETHER):
            own = block.own[start : start + TOGETHER]
            first = block.first[start : start + len(own) + 1]
            at = place[block.code[first[0] : first[-1]]]
            query = np.repeat(np.arange(len(own)), np.diff(first))[at >= 0]
            weight = (np.ones(len(at)) if block.weights is None else block.weights[first[0] : first[-1]])[at >= 0]
            above = np.zeros(len(own)) if least is None else least[start : start + TOGETHER]
            until = np.full(len(own), NO_ID) if last is None else last[start : start + TOGETHER]
            query, found, score = self._together(own, query, at[at >= 0], weight, k, above, until)
            parts.append((query + start, found, score))
        return tuple(map(np.concatenate, zip(*parts)))

    def _together(self, own: np.ndarray, query: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, n = len(own), self.n
        rows, asker = self.row[at], query
        asked, column = np.unique(rows[rows >= 0], return_inverse=True)  # rows that any of these queries asks for
        asks = np.zeros((q, len(asked)), np.float32)
        asks[query[rows >= 0], column] = weight[rows >= 0]
        place = np.full(len(self.most), -1)
        place[asked] = np.arange(len(asked))
        short, whose, factor = at[rows < 0], query[rows < 0], weight[rows < 0]
        score, plain = np.empty((q, n)), bool((factor == 1).all())
        cuts = np.searchsorted(whose, np.arange(0, q + AT_ONCE, AT_ONCE))
        for low, x, y in zip(range(0, q, AT_ONCE), cuts, cuts[1:]):  # so many queries' lists at once as caches hold
            size = self.first[short[x:y] + 1] - self.first[short[x:y]]
            where = np.repeat(self.first[short[x:y]] - (np.cumsum(size) - size), size)
            where += np.arange(len(where))
            cell = np.repeat((whose[x:y] - low) * n, size)
            cell += self.document[where]
            some = min(AT_ONCE, q - low)
            part = self.impact[where] if plain else self.impact[where] * np.repeat(factor[x:y], size)
            score[low : low + some] = np.bincount(cell, weights=part, minlength=some * n).reshape(some, n)
        edges = np.arange(self.blocks) * BLOCK
        bound = np.maximum.reduceat(score, edges, axis=1) + asks @ self.most[asked]
        slack = ERROR * np.maximum(1.0, bound.max(1))
        done = np.zeros(bound.shape, bool)

        def complete(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                some, column = np.flatnonzero(wanted[:, b]), place[self.used[b]]
                both = column >= 0
                score[some, b * BLOCK : (b + 1) * BLOCK] += asks[some][:, column[both]] @ self.dense[b][both]
            done[wanted] = True

        # the blocks with the highest bounds give a first threshold of their own: the k-th best in them, rows of the query aside
        threshold, most = least - slack, min(n, k + self.repeats)
        pivots = min(self.blocks, -(-most // BLOCK) + 1)
        chosen = np.argpartition(bound, self.blocks - pivots, axis=1)[:, self.blocks - pivots :]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, chosen, True, 1)
        complete(first & (bound >= threshold[:, None]))
        inside = (chosen[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(q, -1)
        seen = np.where((inside < n) & np.repeat(np.take_along_axis(done, chosen, 1), BLOCK, axis=1), np.take_along_axis(score, np.minimum(inside, n - 1), 1), 0.0)
        threshold = np.maximum(threshold, np.partition(seen, seen.shape[1] - most, axis=1)[:, seen.shape[1] - most] - 2 * slack)
        complete(~done & (bound >= threshold[:, None]))
        query, found = np.divmod(np.flatnonzero(score >= np.maximum(threshold, 1e-12)[:, None]), n)
        kept = done[query, found // BLOCK] & ~(self.known[found] & (self.id[found] == own[query]))
        query, found = query[kept], found[kept]
        value = score[query, found]
        # what is among the k best but for the error
        order = np.lexsort((-value, query))
        query, found, value = query[order], found[order], value[order]
        begin = np.searchsorted(query, np.arange(q))
        worst = np.minimum(begin + k - 1, np.searchsorted(query, np.arange(q), "right") - 1)
        kept = value >= (value[np.maximum(worst, 0)] - 2 * slack)[query] if len(value) else np.zeros(0, bool)
        query, found = query[kept], found[kept]
        value = np.round(self._exactly(at, weight, asker, query, found), 9)
        order = np.lexsort((self.rank[found], -value, query))
        query, found, value = query[order], found[order], value[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        tie = (value == least[query]) & (np.where(self.known[found], self.id[found], NO_ID) <= last[query])
        kept = (nth < k) & (value > 0) & ((value > least[query]) | tie)
        return query[kept], found[kept], value[kept]

    def _exactly(self, term: np.ndarray, weight: np.ndarray, whose: np.ndarray, query: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Scores of documents for queries (ascending) that ask for ``term``, summed in 64 bits in the order of the terms."""
        out, asked = np.zeros(len(query)), np.zeros(len(self.terms))
        begin, mine = np.searchsorted(query, np.arange(int(whose.max(initial=-1)) + 2)), np.searchsorted(whose, np.arange(int(whose.max(initial=-1)) + 2))
        for q in np.unique(query).tolist():
            some = slice(begin[q], begin[q + 1])
            d = found[some]
            asked[term[mine[q] : mine[q + 1]]] = weight[mine[q] : mine[q + 1]]
            size = self.start[d + 1] - self.start[d]
            where = np.repeat(self.start[d] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out[some] = np.bincount(np.repeat(np.arange(len(d)), size), weights=self.by_impact[where] * asked[self.by_term[where]], minlength=len(d))
            asked[term[mine[q] : mine[q + 1]]] = 0
        return out


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, each document's row once; found has (query_id, at, doc_id, score)."""
    once = found.groupBy("query_id", "at").agg(F.max("score").alias("score"), F.first("doc_id").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "at"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(df: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best other documents for each whose id is divisible by ``every``."""
    spark = df.sparkSession
    # shards of rows from everywhere: what a few shards reach is a good threshold for all
    mixed = pick(df, "doc_id", "text").repartition(max(1, df.rdd.getNumPartitions()))
    shards = make_shards(mixed, SHARD_BYTES, "search-shards", _store)
    n_docs, n_words = totals(shards)
    mean = max(1.0, n_words / max(1, n_docs))

    def impacts(total: np.ndarray, first: np.ndarray, document: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        idf = np.log(1 + (n_docs - total + 0.5) / (total + 0.5))
        return np.repeat(idf, np.diff(first)) * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * size / mean))[document])

    def build(shard: Shard) -> Iterator[pa.RecordBatch]:
        (ids, terms, first, document, tf, size), total = shard.parts, shard.total
        size_of = np.diff(first)
        used = total > 1
        posting = np.repeat(used, size_of)
        document, tf, term = document[posting], tf[posting], np.repeat(terms, size_of)[posting]
        terms, total, first = terms[used], total[used].astype(np.int64), np.cumsum(np.append(0, size_of[used])).astype(np.int64)
        moved = cluster(long_rows(len(ids), first, document, impacts(total, first, document, tf, size), FEATURES)[1])
        to = np.empty(len(moved), np.int64)
        to[moved] = np.arange(len(moved))
        ids, size, document = [ids[i] for i in moved], size[moved], to[document].astype(np.int32)
        order = np.lexsort((document, np.repeat(np.arange(len(terms)), np.diff(first))))
        document, tf = document[order], tf[order]
        index = [pack_sorted(terms), *map(pack, (total, first, document, tf, size))]
        parts = [("index", None, index)]
        order = np.argsort(document, kind="stable")
        cut = np.searchsorted(document[order], np.arange(len(ids) + 1))
        parts += [("query", q, [pack_sorted(term[order[cut[i] : cut[i + 1]]])]) for i, q in enumerate(ids) if q is not None and q % every == 0 and cut[i + 1] > cut[i]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.list_(pa.binary())), pa.array([ids if p[0] == "index" else None for p in parts], pa.list_(pa.int64()))], names=["kind", "query_id", "parts", "ids"])

    def open_index(parts: list[bytes], ids: list) -> Index:
        terms = unpack_sorted(parts[0])
        total, first, document, tf, size = (unpack(p, kind) for p, kind in zip(parts[1:], (np.int64, np.int64, np.int32, np.int32, np.int64)))
        return Index(ids, terms, first, document, impacts(total, first, document, tf, size))

    built = materialize(count_globally(shards, Shard, n_words, build, "kind string, query_id long, parts array<binary>, ids array<long>"), "search-index")
    queries, indexes = built.where("kind = 'query'").select("query_id", F.get("parts", 0).alias("terms")), built.where("kind = 'index'").select("parts", "ids")
    passes = max(1, math.ceil((queries.agg(F.sum(F.length("terms"))).first()[0] or 0) / PASS_BYTES))
    schema = "query_id long, at long, doc_id long, score double"

    def ask(some: DataFrame, asked: Block, least: np.ndarray, last: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((asked, least, last))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, least, last = sent.value
            for batch in batches:
                for at in range(batch.num_rows):
                    index = open_index(batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
                    query, found, score = index.search(asked, k, least, last)
                    full = np.flatnonzero(np.bincount(query, minlength=len(asked.own)) >= k)  # what k documents reach is a threshold for the task's next shards
                    least, last, tenth = least.copy(), last.copy(), np.searchsorted(query, full) + k - 1
                    reached, ids = score[tenth], np.where(index.known[found[tenth]], index.id[found[tenth]], NO_ID)
                    last[full] = np.where(reached > least[full], ids, np.minimum(last[full], ids))  # nothing here is under ``least``
                    least[full] = reached
                    name = xxhash.xxh64_intdigest(b"".join([*batch.column(0)[at].as_py(), index.id.tobytes()])) >> 1  # of the shard
                    row = (np.uint64(name) + found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(asked.own[query]), pa.array(row), pa.array(index.id[found], mask=~index.known[found]), pa.array(score)], names=["query_id", "at", "doc_id", "score"])

        out = materialize(some.mapInArrow(run, schema), "search-answers")
        sent.unpersist()
        return out

    answers: list[DataFrame] = []
    n_shards = indexes.count()
    shares = [GROW ** -i for i in range(math.ceil(math.log(max(1, n_shards), GROW)), -1, -1)]
    order = F.xxhash64("ids").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    for number in range(passes):
        asked = Block(alike([(r.query_id, unpack_sorted(bytes(r.terms))) for r in queries.where(F.pmod(F.xxhash64("query_id", "terms"), F.lit(passes)) == number).collect()]))  # about PASS_BYTES
        least, last, mine = np.zeros(len(asked.own)), np.full(len(asked.own), NO_ID), []
        for low, high in zip([0.0, *shares], shares):  # a draw of the shards that grows: what the k best of it reach is a threshold for the others
            mine.append(ask(indexes.where((order >= low) & (order < high) if high < 1 else order >= low), asked, least, last))
            if high < 1:
                reached = {r.query_id: (r.score, NO_ID if r.doc_id is None else r.doc_id) for r in best(reduce(DataFrame.unionByName, mine), k).where(F.col("rank") == k).select("query_id", "score", "doc_id").collect()}  # a row a query
                pairs = [reached.get(x, (0.0, NO_ID)) for x in asked.own.tolist()]
                least, last = np.array([x for x, _ in pairs]), np.array([x for _, x in pairs], np.int64)
        answers += mine
    return best(reduce(DataFrame.unionByName, answers), k).select("query_id", "rank", "doc_id", "score")


#: The same answers by scoring every document that shares a word, for DuckDB, over documents.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS term FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY r, term),
s AS (SELECT r, sum(tf) AS size FROM p GROUP BY r),
a AS (SELECT count(*) AS n, greatest(1.0, coalesce(sum(size), 0) / greatest(1, count(*))) AS mean FROM d LEFT JOIN s USING (r)),
f AS (SELECT term, count(*) AS total FROM p GROUP BY term HAVING count(*) > 1),
i AS (SELECT r, doc_id, term, ln(1 + (n - total + 0.5) / (total + 0.5)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * size / mean)) AS impact
      FROM p JOIN f USING (term) JOIN s USING (r), a),
m AS (SELECT q.r AS asker, any_value(q.doc_id) AS query_id, i.r, any_value(i.doc_id) AS doc_id, round(sum(impact), 9) AS score
      FROM p AS q JOIN i USING (term) WHERE q.doc_id % 20 = 0 AND q.doc_id IS DISTINCT FROM i.doc_id GROUP BY q.r, i.r),
o AS (SELECT query_id, r, any_value(doc_id) AS doc_id, max(score) AS score FROM m GROUP BY query_id, r),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM o)
SELECT query_id, CAST(place AS INT) AS rank, doc_id, score FROM n WHERE place <= {K}
"""
