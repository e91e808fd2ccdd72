"""Operator 3: toxicity by the nearest labelled examples.

Labelled examples are TF-IDF vectors over all words of theirs: (1 + log tf) idf, times how strongly the word goes with
either label (the size of its z-value among the examples), scaled to length one. They lie in a block-max inverted index (see
``search.Index``): short lists are read whole, long ones have maxima by block, and only blocks that can hold one of the
k nearest are completed, so the k nearest examples by cosine are exact. They vote with weights that fall with distance; a
logistic curve turns votes into probabilities. It is fitted on votes of one half of the examples, whose weights and index
come from the other half. The neighbours are returned as evidence.

Bound of the training sample, a parameter: about ``PER_CLASS`` labelled rows of each label (drawn by a hash of doc_id). All
their words are kept; document frequencies are counted over all documents.

Edge cases: null and empty texts and texts without a known word get the share of toxic examples without one; null labels and
null doc_ids aren't learnt from, a doc_id with both labels counts as toxic; repeated rows score alike; equal examples are
one entry with its counts of either label; ties between entries go to the lower entry; without examples of both labels
every score is the share of toxic labels; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from papyrine.llm.common import append_columns, byte_texts, chance, decode_texts, give_back, materialize, pick, remainder, returning, slices
from papyrine.llm.search import TOGETHER, Block, Index

PER_CLASS = 4000
NEIGHBOURS, MASS = 10, 0.2
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W_]+")
#: Text that is split, or scored, at once: Python's strings and the index's sums take many times as much.
SPLIT_BYTES, SCORE_BYTES = 256 << 10, 512 << 10


def count_words(text: str | None) -> Counter:
    return Counter(WORDS.findall(text.lower())) if text else Counter()


class Numbers:
    """The places of words in a vocabulary of distinct ones, by sorted hashes: a dict of Python strings takes ten times as much."""

    def __init__(self, vocabulary: pa.Array):
        self.vocabulary, self.seed = vocabulary, 0
        while True:
            hashes = np.concatenate([np.zeros(0, np.uint64), *(self._hashes(vocabulary.slice(i, 1 << 14)) for i in range(0, len(vocabulary), 1 << 14))])
            self.place = np.argsort(hashes, kind="stable").astype(np.int32)
            self.hashes = hashes[self.place]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                return
            self.seed += 1  # no two words may share a hash

    def __len__(self) -> int:
        return len(self.vocabulary)

    def _hashes(self, words: pa.Array) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, self.seed) for w in byte_texts(words)), np.uint64, len(words))

    def of(self, words: pa.Array) -> np.ndarray:
        """The words' places; -1 for others."""
        if not len(self):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes := self._hashes(words)), len(self) - 1)
        like = np.flatnonzero(self.hashes[at] == hashes)
        place = self.place[at[like]]
        same = pc.equal(self.vocabulary.take(pa.array(place)), words.take(pa.array(like))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1)
        out[like[same]] = place[same]
        return out


def coded(texts: list[str | None], number: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, numbers and counts of the known words of texts, by row and number."""
    found = [pa.array(WORDS.findall(t.lower()) if t else [], pa.string()) for t in texts]  # as Python strings one text's at a time
    words = pa.concat_arrays([pa.array([], pa.string()), *found]).dictionary_encode()
    term = number.of(words.dictionary)[words.indices.to_numpy()]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    key, count = np.unique(row[term >= 0] * max(1, len(number)) + term[term >= 0], return_counts=True)
    return *np.divmod(key, max(1, len(number))), count.astype(float)


@dataclass
class Examples:
    """Labelled entries as sorted rows (entry, term, count), and how many rows of either label each stands for."""

    entry: np.ndarray
    term: np.ndarray
    count: np.ndarray
    clean: np.ndarray
    toxic: np.ndarray

    def some(self, keep: np.ndarray) -> Examples:
        place = (np.cumsum(keep) - 1).astype(np.int32)
        rows = keep[self.entry]
        return Examples(place[self.entry[rows]], self.term[rows], self.count[rows], self.clean[keep], self.toxic[keep])


def weigh(n_words: int, idf: np.ndarray, examples: Examples) -> np.ndarray:
    """idf times how strongly a word goes with either label: the size of its z-value among the examples."""
    n = examples.clean.sum() + examples.toxic.sum()
    of = lambda x: np.bincount(examples.term, weights=x[examples.entry], minlength=n_words)
    toxic = of(examples.toxic)
    share = (of(examples.clean) + toxic) / max(1, n)
    expected = examples.toxic.sum() * share
    z = (toxic - expected) / np.sqrt(expected * (1 - share) + 1e-9)
    return idf * np.abs(z) * (share > 0)


def vectors(weight: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The weights of the terms of n rows, each row of length one."""
    out = weight[term]
    out *= 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, weights=out * out, minlength=n))
    out /= np.where(norm > 0, norm, 1)[row]
    return out


class Model:
    """Weights of the terms, the entries' index, and what turns a vote into a probability. The terms stay in Arrow: as Python
    strings they would be most of the memory that learning takes."""

    def __init__(self, vocabulary: pa.Array, idf: np.ndarray, examples: Examples, class_weight: tuple[float, float], prior: float):
        self.vocabulary, self.prior, self.none = vocabulary, prior, prior
        self.slope, self.shift = 1.0, 0.0
        self.clean, self.toxic = examples.clean * class_weight[0], examples.toxic * class_weight[1]
        self.weight = weigh(len(vocabulary), idf, examples)
        value = vectors(self.weight, examples.entry, examples.term, examples.count, len(examples.clean))
        order = np.lexsort((examples.entry, examples.term))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(examples.term, minlength=len(vocabulary)))])
        self.document, self.impact = examples.entry[order], value[order]
        self._index: Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    @property
    def words(self) -> list[str]:
        return self.vocabulary.to_pylist()

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index(list(range(len(self.clean))), np.arange(len(self.vocabulary)).astype(np.uint64), self.first, self.document, self.impact)
        return self._index

    def nearest(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, entries and cosines of each row's k nearest entries that share a term of weight, best first; sorted rows given."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for low in range(0, n, TOGETHER):  # as many as the index answers at once
            some = min(TOGETHER, n - low)
            cut = np.searchsorted(row, np.arange(low, low + some + 1))
            ours = slice(cut[0], cut[-1])
            value = vectors(self.weight, row[ours] - low, term[ours], count[ours], some)
            block = Block([(-1, term[a:b].astype(np.uint64)) for a, b in zip(cut, cut[1:])], value)
            asker, entry, cosine = self.index.search(block, k)
            parts.append((asker + low, entry, cosine))
        return tuple(map(np.concatenate, zip(*parts)))

    def votes(self, row: np.ndarray, entry: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """Share of toxic weight among the neighbours and a prior of weight ``MASS``; one at distance d (1 less its cosine)
        weighs (1 - d) squared; rows without neighbours have -1."""
        w = cosine * cosine
        toxic, clean = (np.bincount(row, weights=w * x[entry], minlength=n) for x in (self.toxic, self.clean))
        share = (self.prior * MASS + toxic) / (MASS + toxic + clean)
        return np.where(np.bincount(row, minlength=n) > 0, share, -1.0)

    def probability(self, vote: np.ndarray) -> np.ndarray:
        v = np.clip(vote, 1e-6, 1 - 1e-6)
        made = 1 / (1 + np.exp(-np.clip(self.slope * np.log(v / (1 - v)) + self.shift, -35, 35)))
        return np.where(vote < 0, self.none, made)

    def names(self) -> list[str]:
        """Each entry's label and its terms of most weight."""
        order = np.lexsort((-self.impact, self.document))
        cut = np.searchsorted(self.document[order], np.arange(len(self.clean) + 1))
        some = [order[a : min(b, a + 3)] for a, b in zip(cut, cut[1:])]
        at = np.concatenate([np.zeros(0, np.int64), *some])
        term = np.searchsorted(self.first, at, "right") - 1
        words = iter(self.vocabulary.take(pa.array(term)).to_pylist())
        label = np.where(self.toxic > self.clean, "toxic", "clean")
        return [f"{x}:{'+'.join(next(words) for _ in s)}" for x, s in zip(label, some)]


def _curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on the votes' logits by Newton steps, held near the identity by a small penalty."""
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], 1)
    w, start, hold = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - toxic)) + hold * (w - start)
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + hold * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.1, float(w[0])), float(w[1])


def _no_examples(prior: float) -> Model:
    none = np.zeros(0, np.int64)
    return Model(pa.array([], pa.string()), np.zeros(0), Examples(none, none, none, none, none), (1.0, 1.0), prior)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of rows whose crc32 remainder isn't 1, and the texts of ``documents``."""
    documents = pick(documents, "doc_id", "text")
    known = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, per_class / n) for c, n in total.items()}
    chosen = known.where(chance("toxicity", "doc_id") < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # about ``per_class`` rows of each label: broadcast by construction; rows that share a drawn id have one text each
    drawn = documents.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    sample = materialize(drawn.select("toxic", "text"), "toxicity-sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SPLIT_BYTES):
                found = [sorted(count_words(t).items()) for t in decode_texts(batch.column(1))]
                words, counts = pa.array([[w for w, _ in x] for x in found], pa.list_(pa.string())), pa.array([[n for _, n in x] for x in found], pa.list_(pa.int32()))
                key = [xxhash.xxh3_64_intdigest(repr(x)) >> 1 for x in found]  # equal examples have equal keys
                yield pa.RecordBatch.from_arrays([batch.column(0), words, counts, pa.array(key, pa.int64())], names=["toxic", "words", "counts", "key"])

    # about ``per_class`` rows of each label
    table = sample.mapInArrow(returning(split), "toxic int, words array<string>, counts array<int>, key long").toArrow().combine_chunks()
    prior = total.get(1, 0) / max(1, sum(total.values()))
    toxic, key, length = table.column("toxic").to_numpy(), table.column("key").to_numpy(), pc.list_value_length(table.column("words")).to_numpy()
    size = Counter(toxic.tolist())
    if not size[0] or not size[1]:
        return _no_examples(prior)
    none = np.bincount(toxic[length == 0], minlength=2)
    flat = pc.list_flatten(table.column("words")).combine_chunks().dictionary_encode()
    rank = pc.sort_indices(flat.dictionary).to_numpy()  # as Python sorts them: by bytes of UTF-8, or code points
    vocabulary, place = flat.dictionary.take(pa.array(rank)), np.empty(len(rank), np.int32)
    place[rank] = np.arange(len(rank))
    term = place[flat.indices.to_numpy()]
    count = pc.list_flatten(table.column("counts")).to_numpy().astype(np.float32)
    del table, flat, rank, place
    _, one, entry = np.unique(np.where(length > 0, key, -1), return_index=True, return_inverse=True)
    labelled = [np.bincount(entry[toxic == label], minlength=len(one)).astype(float) for label in (0, 1)]
    stays = np.zeros(len(length), bool)
    stays[one[length[one] > 0]] = True  # the first of equal examples, none of the empty ones
    place, rows = np.cumsum(stays) - 1, np.repeat(stays, length)
    examples = Examples(np.repeat(place, length)[rows].astype(np.int32), term[rows], count[rows], labelled[0][entry[stays]], labelled[1][entry[stays]])
    del term, count, key, rows, entry, place
    give_back()

    def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(vocabulary)
        n = np.zeros(len(number) + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, 0):
                n[-1] += batch.num_rows
                n[:-1] += np.bincount(coded(decode_texts(batch.column(0)), number)[1], minlength=len(number))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["term", "n"])

    frequency = documents.select("text").mapInArrow(returning(count_documents), StructType([StructField("term", IntegerType()), StructField("n", LongType())]))
    df, counted = np.zeros(len(vocabulary) + 1), frequency.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a known word
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # entries with the same word of most weight lie together
    everything = sum(total.values()) / sum(size.values())
    weight = (total[0] / size[0] / everything, total[1] / size[1] / everything)
    examples = _together(len(vocabulary), idf, examples)
    give_back()
    votes, truth, weights = [], [], []
    half = np.arange(len(examples.clean)) % 2 == 0
    for ours in (half, ~half):
        theirs, asked = examples.some(~ours), examples.some(ours)
        if not theirs.clean.sum() or not theirs.toxic.sum() or not ours.any():
            continue
        other, n = Model(vocabulary, idf, theirs, weight, prior), len(asked.clean)
        found = other.votes(*other.nearest(asked.entry, asked.term, asked.count, n), n)
        del other, theirs
        for label, many in ((0, asked.clean), (1, asked.toxic)):
            some = (many > 0) & (found >= 0)
            votes.append(found[some]), truth.append(np.full(int(some.sum()), label)), weights.append(many[some] * weight[label])
        del asked
    model = Model(vocabulary, idf, examples, weight, prior)
    model.none = (none[1] * weight[1] + prior) / (none[0] * weight[0] + none[1] * weight[1] + 1)
    if votes:
        model.slope, model.shift = _curve(*map(np.concatenate, (votes, truth, weights)))
    give_back()
    return model


def _together(n_words: int, idf: np.ndarray, examples: Examples) -> Examples:
    """The examples in the order of their words of most weight, so that blocks differ in what they can score."""
    n = len(examples.clean)
    value = vectors(weigh(n_words, idf, examples), examples.entry, examples.term, examples.count, n)
    order = np.lexsort((-value, examples.entry))
    lead = examples.term[order[np.searchsorted(examples.entry, np.arange(n))]]
    del value, order
    place = np.empty(n, np.int32)
    moved = np.lexsort((np.arange(n), lead))
    place[moved] = np.arange(n)
    entry = place[examples.entry]
    rows = np.lexsort((examples.term, entry))
    return Examples(entry[rows], examples.term[rows], examples.count[rows], examples.clean[moved], examples.toxic[moved])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (probability that the text is toxic) and ``evidence``."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        model = sent.value
        number, names = Numbers(model.vocabulary), model.names()
        give_back()
        model.index  # made before the first texts are in memory
        give_back()

        def run(column: pa.Array) -> list:
            n = len(column)
            near = model.nearest(*coded(decode_texts(column), number), n)
            cut = np.searchsorted(near[0], np.arange(n + 1))
            said = [";".join(f"{names[e]}={c:.3f}" for e, c in zip(near[1][a : min(b, a + 3)].tolist(), near[2][a : min(b, a + 3)].tolist())) for a, b in zip(cut, cut[1:])]
            return [model.probability(model.votes(*near, n)), said]

        return run

    return append_columns(df, StructType([StructField("score", DoubleType()), StructField("evidence", StringType())]), make, text, SCORE_BYTES)
