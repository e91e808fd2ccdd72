"""Operator 8: secret scans by a trigram inverted index.

For each slice of a partition the lower-cased bytes are indexed: of the trigrams that any rule asks for, the postings list
the texts that hold them. Each rule's Boolean trigram query, derived from its regular expression, is answered by
intersecting and uniting postings, and only the candidates are searched by the expression. Rules without mandatory
trigrams, such as long hexadecimal runs, scan every text.

Spans are in code points, end exclusive; each kind's are leftmost and don't overlap, kinds may overlap each other.
Edge cases: a null or empty text has none; a text of any length is scanned whole; null doc_ids, repeated rows and other
columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from papyrine.llm.common import append_columns, byte_texts, pick
from papyrine.llm.trigrams import ANY, query, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an ASCII expression, the group that is measured and its least length."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False


BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("session_access", r"ASIA[A-Z0-9]+", 16),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D/@:]+@"),
]
RULES = BASE + MORE
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
MARK = "[SECRET]"


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.queries = [query(r.pattern) for r in rules]
        self.search = [re.compile(self._least(r).encode(), re.I if r.fold else 0) for r in rules]
        wanted = sorted({t for q in self.queries for t in trigrams(q)})
        self.wanted = {t: i + 1 for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for t, i in self.wanted.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i

    @staticmethod
    def _least(rule: Rule) -> str:
        """A lone greedy class with a least length can say so itself: its runs are the same."""
        return f"{rule.pattern[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Sorted numbers of the texts that hold each wanted trigram, in either case."""
        whole = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        if len(whole) < 3:
            return {}
        starts = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
        code = whole[:-2].astype(np.int32) << 16
        code |= whole[1:-1].astype(np.int32) << 8
        code |= whole[2:]
        hits = self.table[code]
        at = np.flatnonzero(hits)
        pairs = np.unique(hits[at].astype(np.int64) << 32 | (np.searchsorted(starts, at, "right") - 1))
        kind, text = pairs >> 32, pairs & 0xFFFFFFFF
        cut = np.searchsorted(kind, np.arange(len(self.wanted) + 2))
        return {t: text[cut[i] : cut[i + 1]] for t, i in self.wanted.items()}

    def _answer(self, q, postings: dict[str, np.ndarray]) -> np.ndarray:
        if isinstance(q, str):
            return postings.get(q, np.zeros(0, np.int64))
        parts = sorted((self._answer(x, postings) for x in q[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, True) if q[0] == "and" else np.union1d(out, part)
        return out

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        texts = [t or b"" for t in texts]
        postings = self.postings(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, q, search) in enumerate(zip(self.rules, self.queries, self.search)):
            for i in range(len(texts)) if q is ANY else self._answer(q, postings).tolist():
                for m in search.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        out = []
        for text, spans in zip(texts, found):
            spans.sort()
            wide = bool(spans) and not text.isascii()
            point = (lambda n: len(text[:n].decode("utf-8", "replace"))) if wide else int
            out.append([(self.rules[k].kind, point(a), point(b)) for a, k, b in spans])
        return out


def find_secrets(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``df`` with ``spans``: structs (kind, start, end) by start, then in the rules' order."""

    def make():
        scanner = Scanner(rules)
        return lambda column: [scanner.scan(byte_texts(column))]

    return append_columns(df, StructType([StructField("spans", SPANS)]), make, text)


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars", rules: list[Rule] = RULES, mark: str = MARK) -> DataFrame:
    """``df`` with each span of ``text`` (overlapping ones as one) replaced by ``mark`` and ``length`` set anew where text changed."""

    def make():
        scanner = Scanner(rules)

        def run(column: pa.Array) -> list:
            texts = byte_texts(column)
            out, sizes = [], []
            for t, spans in zip(texts, scanner.scan(texts)):
                if not spans:
                    out.append(None if t is None else t.decode("utf-8", "replace"))
                    sizes.append(None)
                    continue
                s, parts, at, end = t.decode("utf-8", "replace"), [], 0, -1
                for _, a, b in spans:
                    if a >= end:
                        parts += [s[at:a], mark]
                    at = end = max(end, b)
                out.append("".join([*parts, s[at:]]))
                sizes.append(len(out[-1]))
            return [out, sizes]

        return run

    columns = df.columns
    made = append_columns(df.withColumn("__source", F.col(f"`{text}`")), StructType([StructField(text, StringType()), StructField("__length", LongType())]), make, "__source")
    made = pick(made, *columns, "__length")
    return made.select(*(F.coalesce("__length", f"`{c}`").cast(df.schema[c].dataType).alias(c) if c == length else F.col(f"`{c}`") for c in columns))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
