"""Extractive summaries by LexRank (Erkan and Radev, JAIR 2004), one document's sentences at a time."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import sentences

WORD = re.compile(r"[^\W_]+")


#: Products and similarities that are held at once, sentences that are ranked together.
HELD, TOGETHER = 1 << 19, 2_000


def _links(row: np.ndarray, column: np.ndarray, value: np.ndarray, start: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sentences that are similar, by rows; ``start`` and ``n`` are the first sentence and the number of them of each one's document."""
    # postings by word, so similarities need no matrix; rows are worked on as long as what they take is bounded
    order = np.argsort(column, kind="stable")
    by_row, by_value = row[order], value[order]
    many = np.bincount(column)
    first = (np.cumsum(many) - many)[column]
    many = many[column]
    upto, ends, base = (np.append(0, np.cumsum(x)) for x in (many, np.bincount(row, minlength=len(n)), n))
    cost = upto[ends] + base
    out, low = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(cost, cost[low] + HELD, "right")) - 1)
        x, y = ends[low], ends[high]
        of = np.repeat(np.arange(x, y), many[x:y])
        at = np.arange(len(of)) + np.repeat(first[x:y] - (upto[x:y] - upto[x]), many[x:y])
        cell = (base[:-1] - base[low] - start)[row[of]] + by_row[at]
        near = np.bincount(cell, weights=value[of] * by_value[at], minlength=base[high] - base[low])
        hit = np.flatnonzero(near >= threshold) + base[low]
        i = np.searchsorted(base, hit, "right") - 1
        out.append((i, hit - base[i] + start[i]))
        low = high
    return tuple(map(np.concatenate, zip(*out)))


def _walk(i: np.ndarray, j: np.ndarray, document: np.ndarray, sizes: np.ndarray, damping: float) -> np.ndarray:
    """The rank of each sentence; documents without sentences aside, they are walked together, each until it stands."""
    n = sizes[document]
    rank, final = 1 / n, np.zeros(len(n))
    here, place = np.arange(len(n)), document  # sentences of documents still walked, and the number of each one's document among these
    for _ in range(100):
        if not len(here):
            break
        size, degree = n[here], np.bincount(i, minlength=len(here))
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        share = np.divide(rank, degree, out=np.zeros(len(here)), where=degree > 0)
        lost = np.add.reduceat(np.where(degree == 0, rank, 0.0), starts)[place] / size
        new = (1 - damping) / size + damping * (np.bincount(j, weights=share[i], minlength=len(here)) + lost)
        stands = np.maximum.reduceat(np.abs(new - rank), starts) < 1e-9
        if stands.any():
            done = stands[place]
            final[here[done]] = rank[done]
            to = np.cumsum(~done) - 1
            goes = ~done[i]
            i, j, here, new = to[i[goes]], to[j[goes]], here[~done], new[~done]
            place = (np.cumsum(~stands) - 1)[place[~done]]
        rank = new
    final[here] = rank
    return final


def lexrank_orders(documents: list[list[str]], threshold: float = 0.1, damping: float = 0.85) -> list[list[int]]:
    """Each document's sentence numbers from the most central down; ties by position."""
    sizes = np.array([len(d) for d in documents if d], np.int64)
    document = np.repeat(np.arange(len(sizes)), sizes)
    found = [WORD.findall(t.lower()) for d in documents for t in d]
    length = np.array([len(f) for f in found], np.int64)
    names: dict[str, int] = {}
    word = np.fromiter((names.setdefault(w, len(names)) for f in found for w in f), np.int64, length.sum())
    row = np.repeat(np.arange(len(found)), length)
    # the distinct words of each sentence in the order they come
    _, at, count = np.unique(row * max(1, len(names)) + word, return_index=True, return_counts=True)
    order = np.argsort(at)
    at, count = at[order], count[order]
    row, word = row[at], word[at]
    _, column, df = np.unique(document[row] * max(1, len(names)) + word, return_inverse=True, return_counts=True)
    kinds, kind = np.unique(sizes[document[row]] << 32 | df[column], return_inverse=True)
    value = count * np.array([math.log((k >> 32) / (k & 0xFFFFFFFF)) + 1 for k in kinds.tolist()])[kind] if len(row) else np.zeros(0)
    value = value / np.sqrt(np.bincount(row, weights=value * value, minlength=len(found)))[row]
    begins = np.cumsum(sizes) - sizes
    i, j = _links(row, column, value, begins[document], sizes[document], threshold)
    rank = np.split(_walk(i, j, document, sizes, damping), begins[1:]) if len(sizes) else []
    ranks = iter(rank)
    return [sorted(range(len(d)), key=[(-round(x, 9), k) for k, x in enumerate(next(ranks).tolist())].__getitem__) if d else [] for d in documents]


def lexrank_order(texts: list[str], threshold: float = 0.1, damping: float = 0.85) -> list[int]:
    """Sentence numbers from the most central down; ties by position."""
    return lexrank_orders([texts], threshold, damping)[0]


def summarize(text: Column, n: int = 2) -> Column:
    """The ``n`` most central sentences in text order, joined by a blank; null without a sentence.

    Texts of any length are ranked as a whole, short ones many at a time; only links are held, eight bytes an end.
    """

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        out: list[str | None] = []
        some: list[list[str]] = []

        def rank() -> None:
            for found, order in zip(some, lexrank_orders(some)):
                out.append(" ".join(found[i] for i in sorted(order[:n])) or None)
            some.clear()

        held = 0
        for found in rows:
            some.append([] if found is None else list(found))
            held += len(some[-1])
            if held >= TOGETHER:
                rank()
                held = 0
        rank()
        return pd.Series(out, rows.index, dtype=object)

    return run(sentences(text))
