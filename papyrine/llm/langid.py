"""Operator 6: language identification by a byte convolutional network.

Bytes are read as ``CLASSES`` codes, ASCII letters regardless of case. Filters of several widths run over windows of ``WINDOW`` bytes; their maxima over the window feed a softmax. Training is
stochastic gradient descent (Adam) in numpy on windows of a bounded sample of labelled documents. For prediction every
filter bank is a table over code n-grams, so a convolution is one look-up a byte; all windows of a whole text vote by
their mean log-probability, weighted by their bytes.

Bounds of the training sample, all parameters: about ``PER_LANGUAGE`` documents of each language (drawn by a hash of doc_id
and text, equal texts of a language once), ``WINDOWS`` windows from anywhere in each. All labels are learnt; they are taken
to be languages, so their list goes to the driver.

Edge cases: null texts and texts without a letter are ``und`` with score 0; short texts are one padded window; if no row
is labelled every text is ``und``; ties go to the label that sorts first; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from papyrine.llm.common import append_columns, byte_texts, chance, pick, remainder, slices

WINDOW, WIDTHS, FILTERS, CLASSES = 256, (2, 3, 4), 16, 256
PER_LANGUAGE, WINDOWS, EPOCHS = 1500, 4, 8
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Windows that are looked up together.
TOGETHER = 128


def _codes() -> np.ndarray:
    code = np.arange(CLASSES, dtype=np.int32)
    code[65:91] += 32
    return code


CODES = _codes()


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # by width: (width, CLASSES, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, tables over one or two codes whose entries add up to the responses."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        return [[pair(f[i], f[i + 1]) if i + 1 < len(f) else f[i] for i in range(0, len(f), 2)] for f in self.filters]

    def pooled(self, codes: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """codes (bytes, windows) -> maxima (windows, all filters)."""
        two = codes[:-1] * CLASSES + codes[1:]
        out = []
        for width, table in zip(WIDTHS, tables):
            n = len(codes) - width + 1
            r = table[0][two[:n]]
            for k, t in enumerate(table[1:], 1):
                r += t[(two if 2 * k + 1 < width else codes)[2 * k : 2 * k + n]]
            out.append(r.max(0))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def log_probabilities(self, codes: np.ndarray, tables) -> np.ndarray:
        z = self.pooled(codes, tables) @ self.dense + self.shift
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(codes: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """codes: (windows, WINDOW); label: their languages' numbers."""
    rng = np.random.default_rng(seed)
    k, total = len(languages), FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.5 / w**0.5, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(total, np.float32), rng.normal(0, 0.2, (total, k)).astype(np.float32), np.zeros(k, np.float32))
    parameters = [*net.filters, net.bias, net.dense, net.shift]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step, rate = 0, 0.01
    share = np.bincount(label, minlength=k)
    weight = (len(label) / (k * np.maximum(share, 1)))[label].astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            x, y = np.ascontiguousarray(codes[some].T), label[some]
            n = len(some)
            place, value = [], []
            for f in net.filters:
                m = len(x) - len(f) + 1
                r = f[0][x[:m]]
                for j in range(1, len(f)):
                    r += f[j][x[j : j + m]]
                p = r.argmax(0)
                place.append(p)
                value.append(np.take_along_axis(r, p[None], 0)[0])
            raw = np.concatenate(value, 1) + net.bias
            h = np.maximum(raw, 0)
            z = h @ net.dense + net.shift
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(n), y] -= 1
            prob *= weight[some][:, None] / n
            back = (prob @ net.dense.T) * (raw > 0)
            gradients = []
            for i, (width, p) in enumerate(zip(WIDTHS, place)):
                g, part = np.zeros_like(net.filters[i]), back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(width):
                    np.add.at(g[j], (x[p + j, np.arange(n)[:, None]], np.arange(FILTERS)[None]), part)
                gradients.append(g)
            gradients += [back.sum(0), h.T @ prob, prob.sum(0)]
            step += 1
            for p, g, m, v in zip(parameters, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        rate *= 0.8
    return net


def windows(text: bytes) -> np.ndarray:
    """All windows of a text as codes (windows, WINDOW), the last one padded."""
    n = -(-len(text) // WINDOW)
    return CODES[np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8)].reshape(n, WINDOW)


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Network | None:
    """Learn from (doc_id, text, lang) of the rows whose crc32 remainder isn't 1; None if none has a label."""
    known = pick(documents, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 1))
    share = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not share:
        return None
    languages = sorted(r.lang for r in share)
    below = F.create_map(*(x for r in share for x in (F.lit(r.lang), F.lit(min(1.0, per_language / r.n)))))[F.col("lang")]
    drawn = known.where(chance("language", "doc_id", "text") < below).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                lang, part = [], []
                for code, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                    rng = np.random.default_rng(len(text))
                    for k in range(WINDOWS if len(text) > WINDOW else 1):
                        at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
                        size = WINDOW if k % 2 == 0 else int(rng.integers(24, WINDOW))  # short ones teach short texts
                        lang.append(code)
                        part.append(text[at : at + size].ljust(WINDOW, b"\0"))
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.binary())], names=["lang", "part"])

    rows = drawn.mapInArrow(cut, StructType([StructField("lang", StringType()), StructField("part", BinaryType())])).collect()  # about PER_LANGUAGE * WINDOWS windows a language
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.part)))
    codes = CODES[np.frombuffer(b"".join(bytes(r.part) for r in rows), np.uint8)].reshape(-1, WINDOW)
    number = {x: i for i, x in enumerate(languages)}
    return train(codes, np.array([number[r.lang] for r in rows]), languages, epochs)


def predict(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, its probability."""

    def make():
        tables = net.tables() if net else None

        def run(column: pa.Array) -> list:
            texts = byte_texts(column)
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if net and t and LETTER.search(t.decode("utf-8", "replace"))]
            if some:
                counts = np.array([-(-len(texts[i]) // WINDOW) for i in some])
                whole = CODES[np.frombuffer(b"".join(texts[i].ljust(n * WINDOW, b"\0") for i, n in zip(some, counts.tolist())), np.uint8)].reshape(-1, WINDOW)
                logs = np.concatenate([net.log_probabilities(np.ascontiguousarray(whole[a : a + TOGETHER].T), tables) for a in range(0, len(whole), TOGETHER)])
                size = (whole != 0).sum(1, keepdims=True) + 1e-9
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                mean = np.add.reduceat(logs * size, first) / np.add.reduceat(size, first)
                prob = np.exp(mean - mean.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                for i, k, p in zip(some, prob.argmax(1).tolist(), prob.max(1).tolist()):
                    lang[i], score[i] = net.languages[k], p
            return [lang, score]

        return run

    return append_columns(df, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]), make, text)
