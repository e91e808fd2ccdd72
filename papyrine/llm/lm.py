"""Operator 4: stupid-backoff scores against counts of the whole corpus, a document's own counts taken out.

Counts of n-grams up to an order (words, pairs and triples by default) are tables partitioned by hash, an order at a time; each
shard's exploded n-grams meet their totals there (see ``shards``) and are summed per document. For a word w after the
context h in document d, with all counts less those of d: c(h w) / c(h) if the n-gram occurs elsewhere, else 0.4 times the
same with a context shorter by a word, down to 0.4^(order-1) c(w) / N, and for a word of d alone 0.4^order / (N + 1). A
document starts with one start mark, and its end mark is scored as a word; n-grams that would begin before the start mark
don't exist.

An n-gram can only occur in another document if both of the n-grams one word shorter inside it do, so only such ones
are counted: what is left out has the count zero anyway. Rows are packed by shard and bucket (sorted hash differences), as
plain rows of (hash, document, count) would be some eight times the input in exchanges.

Edge cases: a null, empty or blank text is scored on its end mark alone; equal texts in other rows count as other
documents; null doc_ids are kept; a table of one document has only the last case; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyrine.llm.common import byte_texts
from papyrine.llm.shards import count_globally, make_shards, pack, pack_sorted, totals, unpack, unpack_sorted, word_hashes, words

BACKOFF, ORDER = 0.4, 3
#: Decimals of the scores that the query gives; sums differ in the last bits by the order of their parts.
DIGITS = 6
SHARD_BYTES = 8 << 20
START, END = np.uint64(0x9D8A0F1E2C3B4A59), np.uint64(0x1F2E3D4C5B6A7988)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shard:
    """The words (and end marks) of a shard's documents, and what it has learnt of their n-grams."""

    def __init__(self, data: bytes):
        row = pa.ipc.open_stream(data).read_next_batch()
        vocabulary, code, size = row.column(0)[0].as_py()
        self.ids = row.column(1).flatten()
        self.size = unpack(size, np.int64)
        self.vocabulary, self.code = unpack_sorted(vocabulary), unpack(code, np.uint32)
        self.document = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.code)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        #: By order less one: hashes of the n-grams that each word closes; their occurrences in other documents.
        self.hash, self.left = [self.vocabulary[self.code]], []

    def grams(self, number: int) -> np.ndarray:
        """Positions of the words that close an n-gram of ``number + 1`` words which may occur elsewhere."""
        if not number:
            return np.arange(len(self.code))
        if len(self.hash) == number:
            before = np.concatenate([[START], self.hash[-1][:-1]]).astype(np.uint64)[: len(self.code)]
            if number == 1:
                before[self.place == 0] = START
            self.hash.append(mix(before, self.hash[0]))
        return np.flatnonzero((self.left[number - 1] > 0) & (self.context(number) > 0) & (self.place >= number - 1))

    def context(self, number: int, n_docs: int = 2) -> np.ndarray:
        """Occurrences elsewhere of the n-grams less their last words; a start mark is in every document."""
        out = np.concatenate([[0], self.left[number - 1][:-1]])[: len(self.code)]
        return np.where(self.place == 0, n_docs - 1, out) if number == 1 else out

    def items(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if not number:
            return self.vocabulary, np.bincount(self.code, minlength=len(self.vocabulary))
        at = self.grams(number)
        return np.unique(self.hash[number][at], return_counts=True)

    def learn(self, number: int, hashes: np.ndarray, total: np.ndarray) -> None:
        at = self.grams(number)
        code = np.searchsorted(hashes, self.hash[number][at]) if number else self.code.astype(np.int64)
        _, own, count = np.unique(self.document[at] * max(1, len(hashes)) + code, return_inverse=True, return_counts=True)
        left = np.zeros(len(self.code), np.int64)
        left[at] = total[code] - count[own]
        self.left.append(left)


def _read(batch: pa.RecordBatch) -> tuple[bytes, int]:
    """A shard's documents as codes of a vocabulary of hashes, and their number of words."""
    documents = [words(t) for t in byte_texts(batch.column(1))]
    size = np.array([len(d) + 1 for d in documents], np.int64)
    word = np.full(int(size.sum()), END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[np.cumsum(size) - 1] = False
    word[inner] = word_hashes(documents)
    vocabulary, code = np.unique(word, return_inverse=True)
    parts, ids = [pack_sorted(vocabulary), pack(code.astype(np.uint32)), pack(size)], batch.column(0)
    row = pa.RecordBatch.from_arrays([pa.array([parts], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=["parts", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes(), int(inner.sum())


def lm_scores(df: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, logprob, per_token): base-10 logarithms summed over the words and the end mark, and their mean."""
    shards = make_shards(df, SHARD_BYTES, "lm-shards", _read)
    n_docs, n_words = totals(shards)
    everything = n_words + n_docs
    key = df.schema["doc_id"].dataType.simpleString()

    def score(shard: Shard) -> Iterator[pa.RecordBatch]:
        n = everything - shard.size[shard.document]
        s = np.where(shard.left[0] > 0, BACKOFF ** (order - 1) * shard.left[0] / np.maximum(n, 1), BACKOFF**order / (n + 1))
        for number in range(1, order):
            count = shard.left[number]
            s = np.where(count > 0, BACKOFF ** (order - 1 - number) * count / np.maximum(shard.context(number, n_docs), 1), s)
        sums = np.add.reduceat(np.log10(s), np.flatnonzero(shard.place == 0)) if len(s) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([shard.ids, pa.array(shard.size), pa.array(sums), pa.array(sums / shard.size)], names=["doc_id", "n_tokens", "logprob", "per_token"])

    return count_globally(shards, Shard, everything, score, f"doc_id {key}, n_tokens long, logprob double, per_token double", order)


def _oracle() -> str:
    """The same scores for DuckDB, over documents, as the query rounds them; the marks are a blank and the empty word."""
    n = range(1, ORDER + 1)
    gram = {k: ", ".join(f"w{j}" for j in range(k)) for k in n}
    before = ", ".join(f"lag(w0, {j}, ' ') OVER x AS w{j}" for j in n[:-1])
    left = ", ".join(f"CASE WHEN place >= {k - 2} THEN count(*) OVER (PARTITION BY {gram[k]}, place >= {k - 2}) - count(*) OVER (PARTITION BY r, {gram[k]}, place >= {k - 2}) ELSE 0 END AS l{k}" for k in n)
    context = ", ".join(f"lag(l{k - 1}, 1, {'n_docs - 1' if k == 2 else 0}) OVER x AS h{k}" for k in n[1:])
    cases = " ".join(f"WHEN l{k} > 0 THEN {BACKOFF ** (ORDER - k)!r}::DOUBLE * l{k} / greatest({f'h{k}' if k > 1 else 'everything - size'}, 1)" for k in reversed(n))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, doc_id, list_append(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), '') AS words FROM d),
u AS (SELECT r, doc_id, unnest(words) AS w0, unnest(range(len(words))) AS place, len(words) AS size FROM t),
b AS (SELECT *, {before} FROM u WINDOW x AS (PARTITION BY r ORDER BY place)),
c AS (SELECT *, {left} FROM b),
e AS (SELECT count(*) AS n_docs, sum(len(words)) AS everything FROM t),
h AS (SELECT *, {context} FROM c, e WINDOW x AS (PARTITION BY r ORDER BY place)),
s AS (SELECT r, doc_id, size, log10(CASE {cases} ELSE {BACKOFF**ORDER!r}::DOUBLE / (everything - size + 1) END) AS part FROM h)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(size) AS BIGINT) AS n_tokens, round(sum(part), {DIGITS}) AS logprob, round(sum(part) / any_value(size), {DIGITS}) AS per_token FROM s GROUP BY r
"""


ORACLE_SQL = _oracle()
