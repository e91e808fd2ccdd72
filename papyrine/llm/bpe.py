"""Operator 1: byte-level BPE encoding and decoding.

Each match of the split pattern is encoded on its own. A segment tree over the byte positions of a piece holds, at the leaf
of every live part, the rank of merging it with its right neighbour (ties: leftmost), so its root is the next merge; a
merge is three point updates of logarithmic cost. Short pieces, which are nearly all, go through the same tree many
pieces at a time in numpy; long ones through a scalar tree.

Edge cases: a null or empty text has no ids and decodes to no bytes; bytes that aren't UTF-8 are read as U+FFFD; a text
without spaces or of any length is encoded whole; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gc
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from papyrine.llm.common import append_columns, decode_texts

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Largest piece, in bytes, for the trees that run many at a time.
WIDE = 128
#: Entries that the cache of a worker holds at most; a full cache is emptied.
CACHE = 400_000
#: White space by any library's reading: chunks that touch it aren't cut at blanks.
ODD = r"\s\x1c-\x1f\u180e\u200b\ufeff"
#: A blank that sets chunks apart, and what stands for it among packed ids.
APART, STAND_IN = "\u2003", b"\xff\xff\xff\xff"
TOUCH = re.compile(f"{APART}[{ODD}]|[{ODD}]{APART}")


class Encoder:
    """Ranks of byte strings and what is derived from them."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.slots = 1 << (4 * len(keys)).bit_length()
        self.pair_keys, self.pair_ranks = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):  # open addressing: of those that want a free slot the last one written gets it
            free = self.pair_keys[slot] < 0
            self.pair_keys[slot[free]] = keys[rest[free]]
            self.pair_ranks[slot[free]] = np.array(whole, np.int64)[rest[free]]
            waits = self.pair_keys[slot] != keys[rest]
            rest, slot = rest[waits], (slot[waits] + 1) & (self.slots - 1)
        self.kind = np.int32 if len(self.tokens) * 2 * WIDE < 2**31 else np.int64  # of a rank with its position
        self.pairs = dict(zip(zip(left, right), whole))
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.single = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}

    def _merge_ranks(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        keys = a << 32 | b
        slot = self._slot(keys)
        held = self.pair_keys[slot]
        out = np.where(held == keys, self.pair_ranks[slot], none)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (self.slots - 1)
            held = self.pair_keys[slot]
            hit = held == keys[rest]
            out[rest[hit]] = self.pair_ranks[slot[hit]]
            more = ~hit & (held >= 0)
            rest, slot = rest[more], slot[more]
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B97F4A7C1) >> 30) & (self.slots - 1)

    def _many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of 2 to ``size`` bytes, one tree each, all advanced together."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        position = np.arange(size)
        token = np.full((n, size + 1), -1, np.int64)
        token[:, :size] = np.where(position < lengths[:, None], self.byte_rank[raw], -1)
        none = len(self.tokens) + 1
        tree = np.empty((n, 2 * size), self.kind)
        inside = position[: size - 1] + 1 < lengths[:, None]
        tree[:, size:] = none * size
        ranks = self._merge_ranks(token[:, : size - 1].ravel(), token[:, 1:size].ravel(), none).reshape(n, size - 1)
        tree[:, size : 2 * size - 1] = np.where(inside, ranks * size + position[: size - 1], none * size)
        for level in range(size.bit_length() - 2, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        right = np.tile(np.arange(1, size + 2), (n, 1))
        right[right >= lengths[:, None]] = size
        left = np.tile(np.arange(-1, size), (n, 1))
        flat, w = tree.ravel(), 2 * size
        tokens, rights, lefts, v = token.ravel(), right.ravel(), left.ravel(), size + 1
        live = np.arange(n)
        while len(live):
            top = flat[live * w + 1].astype(np.int64)
            some = top < none * size
            if not some.all():
                live, top = live[some], top[some]
                if not len(live):
                    break
            rank, at = np.divmod(top, size)
            row = live * v
            gone = rights[row + at]
            after = rights[row + gone]
            before = lefts[row + at]
            tokens[row + at] = rank
            tokens[row + gone] = -1
            rights[row + at] = after
            lefts[row + after] = at
            base = live * w
            follows = np.where(after < size, self._merge_ranks(rank, tokens[row + after], none), none)
            flat[base + size + gone] = none * size
            flat[base + size + at] = np.where(follows < none, follows * size + at, none * size)
            has = before >= 0
            prior = np.where(has, before, at)
            precedes = self._merge_ranks(tokens[row + prior], rank, none)
            leaf = np.where(precedes < none, precedes * size + prior, none * size)
            flat[(base + size + prior)[has]] = leaf[has]
            for leaf_at in (at, gone, prior):
                node = leaf_at + size
                while node[0] > 1:
                    node = node >> 1
                    i = base + 2 * node
                    flat[base + node] = np.minimum(flat[i], flat[i + 1])
        body = token[:, :size]
        alive = body >= 0
        ids = body[alive].astype("<u4")
        ends = np.cumsum(alive.sum(1)).tolist()
        data, start, out = ids.tobytes(), 0, []
        for end in ends:
            out.append(data[4 * start : 4 * end])
            start = end
        return out

    def _one(self, piece: bytes) -> bytes:
        """A piece of any length: the same tree in plain lists."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        pairs, none = self.pairs, (1 << 60)
        token = [int(self.byte_rank[b]) for b in piece]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get((token[i], token[i + 1]))) is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                best = a if a < b else b
                if tree[i] == best:
                    return
                tree[i] = best

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = right[at]
            after, before = right[gone], left[at]
            token[at], token[gone], right[at] = rank, -1, after
            put(gone, none)
            r = None
            if after < n:
                left[after] = at
                r = pairs.get((rank, token[after]))
            put(at, none if r is None else r * size + at)
            if before >= 0:
                r = pairs.get((token[before], rank))
                put(before, none if r is None else r * size + before)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece; a piece with a rank of its own is that one id."""
        out = list(map(self.single.get, pieces))
        rest = [i for i, ids in enumerate(out) if ids is None]
        lengths = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        order = np.argsort(lengths, kind="stable")
        rest, lengths = np.array(rest, np.int64)[order], lengths[order]
        at = int(np.searchsorted(lengths, 1))
        for i in rest[:at].tolist():
            out[i] = b""
        size = 2
        while size <= WIDE:
            end = int(np.searchsorted(lengths, size, "right"))
            step = max(1, (1 << 19) // size)
            for k in range(at, end, step):
                some = rest[k : min(end, k + step)].tolist()
                for i, ids in zip(some, self._many([pieces[j] for j in some], size)):
                    out[i] = ids
            at, size = max(at, end), size * 2
        for i in rest[at:].tolist():
            out[i] = self._one(pieces[i])
        return out

    def _chunks(self, chunks: list[str], head: str) -> list[bytes]:
        """Packed ids of each chunk. All are matched at once, with a blank between them that no chunk holds or touches
        and so is always a match of its own; its stand-in can't occur within or across ids, whose upper halves are 0."""
        if not chunks:
            return []
        found = self.pattern.findall(head + (APART + head).join(chunks))
        ids = self._distinct(found)
        ids[APART] = STAND_IN
        return b"".join(map(ids.__getitem__, found)).split(STAND_IN)

    @staticmethod
    def _odd(parts: list[str]) -> set[str]:
        """Chunks that are empty or touch white space of any kind."""
        whole = APART.join(parts)
        if "" not in parts and whole.count(APART) == len(parts) - 1 and not TOUCH.search(APART + whole + APART):
            return set()
        return {p for p in parts if not p or APART in p or TOUCH.search(APART + p + APART)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian ids of each text.

        The pattern always starts a new match at a single blank between two other characters, so texts are cut there
        and what a chunk gives is cached. A chunk that is empty or touches other white space shows that its text
        can't be cut this way; that text is matched whole.
        """
        if len(self.first) + len(self.after) > self.cache:
            self.first.clear()
            self.after.clear()
        split = [t.split(" ") if t else None for t in texts]
        odd: set[str] = set()
        heads = {s[0] for s in split if s}
        tails = set().union(*(s[1:] for s in split if s)) if split else set()
        for cache, head, wanted in ((self.first, "", heads), (self.after, " ", tails)):
            missing = list(wanted.difference(cache))
            if missing and (bad := self._odd(missing)):
                odd |= bad
                missing = [p for p in missing if p not in bad]
            cache.update(zip(missing, self._chunks(missing, head)))
        out = []
        for text, parts in zip(texts, split):
            if parts is None:
                out.append(b"")
            elif odd and not odd.isdisjoint(parts):
                out.append(self.whole(text))
            else:
                out.append(self.first[parts[0]] + b"".join(map(self.after.__getitem__, parts[1:])))
        return out

    def whole(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        return b"".join(map(self._distinct(found).__getitem__, found))

    def _distinct(self, found: list[str]) -> dict[str, bytes]:
        distinct = list(set(found))
        return dict(zip(distinct, self.pieces([p.encode() for p in distinct])))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One per worker process and rank file; its tables are left out of garbage collection."""
    made = Encoder(path, cache)
    gc.freeze()
    return made


def bpe_encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit ids of ``text``) and ``n_tokens``."""
    path = path or public_tokenizers.path(RANK_FILE)

    def make():
        def run(column: pa.Array) -> list:
            ids = encoder(path).encode(decode_texts(column))
            return [ids, [len(x) // 4 for x in ids]]

        return run

    return append_columns(df, StructType([StructField("ids", BinaryType()), StructField("n_tokens", LongType())]), make, text)


def bpe_decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (binary: the bytes that ``ids`` stand for; of a null: none)."""
    path = path or public_tokenizers.path(RANK_FILE)

    def make():
        def run(column: pa.Array) -> list:
            enc = encoder(path)
            return [[enc.decode(x or b"") for x in column.to_pylist()]]

        return run

    return append_columns(df, StructType([StructField("decoded", BinaryType())]), make, ids, 4 << 20)
