"""Operators of the search for reused text against plain Python: whole results, odd rows, hot keys, both ways of each size check."""

import html
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from papyrine.operators import joins, minhash, overlap, shingles, spans, tfidf, topk, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sentence(rnd, n, size=60):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = [sentence(rnd, rnd.randint(30, 90), 4000) for _ in range(12)]
    near = []
    for i, t in enumerate(base):
        for k in range(i):
            w = t.split(" ")
            w[rnd.randrange(len(w))] = f"x{k}"
            near.append(" ".join(w))
    odd = [None, "", " \n", "a", "A", "a b c", "É é", "one two three four five", "x " * 300, "y" * 5000, "w1", base[0].upper(), base[1] + "\n", base[2].replace(" ", "\t\r\n")]
    out = base + near + odd + base[:4] * 6
    return [(None if i in (3, 40) else i if i != 50 else 51, t) for i, t in enumerate(out)]


def frame(spark, rows, types="doc_id long, text string, size string, hash string"):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], types).repartition(5)


def reach(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 2])
def test_near_copies(spark, texts, chunk, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 3)
    monkeypatch.setattr(joins, "HOT_BYTES", 300)
    def shingle_set(t):
        w = WORD.findall(lower(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingle_set(t)) for i, t in texts]
    ids = defaultdict(list)
    for i, s in sets:
        ids[s] += [i] if i is not None else []
    distinct = [s for s in ids if s]
    near = [(a, b) for a in range(len(distinct)) for b in range(a) if len(distinct[a] & distinct[b]) >= 0.8 * len(distinct[a] | distinct[b])]
    roots = reach(near, range(len(distinct)))
    least = lambda many: min((x for x in many if x is not None), default=None)
    group = defaultdict(list)
    for k, s in enumerate(distinct):
        group[roots[k]].append(least(ids[s]))
    want = Counter((i, len(s), least(ids[s]) if s else i, least(group[roots[distinct.index(s)]]) if s else i) for i, s in sets)
    found = minhash.near_copies(frame(spark, texts), chunk=chunk)
    assert Counter(map(tuple, found.collect())) == want
    assert minhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recall_of_bands():
    """Of pairs with a similarity of 0.8 to 0.85 at least 99 of 100 share a bucket."""
    rnd = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        common, own = rnd.integers(0, 1 << 63, 320).astype(np.uint64), rnd.integers(0, 1 << 63, (2, 38)).astype(np.uint64)
        a, b = (minhash.band_hashes(minhash.signature(np.concatenate([common, x]))) for x in own)
        met += bool((a == b).any())
    assert met >= 396


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 380)] + [(500, k) for k in range(501, 600)] + [(7, 7), (1, 2), (2, 1)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = reach(links, {x for p in links for x in p})
    found = joins.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((n, want[n]) for n in nodes)
    assert joins.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("marks", [joins.MARKS, 40_000])
def test_semi_join_by_bitmap(spark, monkeypatch, marks):
    monkeypatch.setattr(joins, "MARKS", marks)
    rows = [(k if k % 50 else None, f"t{k}") for k in range(-3000, 3000)]
    some = [(k,) for k in range(-900, 7000, 7)] * 2 + [(None,)]
    found = joins.only_of(spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame(some, "x long"), "k").collect()
    assert sorted(map(tuple, found), key=repr) == sorted((r for r in rows if (r[0],) in set(some)), key=repr)
    rest = joins.without(spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame(some, "x long"), "k").collect()
    assert sorted(map(tuple, rest), key=repr) == sorted((r for r in rows if (r[0],) not in set(some)), key=repr)
    assert joins.only_of(spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame([], "x long"), "k").collect() == []


@pytest.mark.parametrize("most", [overlap.BROADCAST_NGRAMS, 0])
def test_passages(spark, texts, most, monkeypatch):
    monkeypatch.setattr(overlap, "SPREAD", 3)
    monkeypatch.setattr(overlap._by_exchange, "__defaults__", (5,))
    rnd = random.Random(9)
    body = [t for _, t in texts if t and len(t) > 150]
    items = [(k, " ".join(rnd.choice(body).split(" ")[3:20]) + " " + sentence(rnd, 5)) for k in range(8)] + [(1, "x " * 9), (None, body[0]), (2, None), (3, ""), (4, "a b"), (5, body[1]), (5, body[1])]
    want = Counter()
    for i, t in texts:
        w = WORD.findall(lower(t))
        for k, u in set(items):
            v = WORD.findall(lower(u))
            hits = {(a, b) for b in range(len(v) - 4) for a in range(len(w) - 4) if w[a : a + 5] == v[b : b + 5]}
            for a, b in hits:
                if (a - 1, b - 1) not in hits:
                    n = 0
                    while (a + n, b + n) in hits:
                        n += 1
                    want[i, k, a, a + n + 4, b, b + n + 4] += 1
    sets = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(lower(t))] for i in range(len(w) - 4)}
    near = Counter((i, k, len(a & b), len(a & b) / len(a | b), len(a & b) / len(b)) for i, t in texts for k, u in set(items) for a, b in [(sets(t), sets(u))] if a & b)
    items = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, item string")
    assert Counter(map(tuple, overlap.jaccards(frame(spark, texts), items, broadcast_ngrams=most).collect())) == near
    assert Counter(map(tuple, overlap.passages(frame(spark, texts), items, broadcast_ngrams=most).collect())) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert overlap.passages(empty, items, broadcast_ngrams=most).collect() == [] == overlap.passages(frame(spark, texts), empty.withColumnRenamed("doc_id", "item_id"), broadcast_ngrams=most).collect()


@pytest.mark.parametrize("most", [1, 7, overlap.HITS])
def test_hits_a_stretch_at_a_time(most):
    """Equal results, and nothing larger than a stretch and what goes together, where many texts share an n-gram with many items."""
    texts = ["x " * 12 + "a b c d e f x x x x x", None, "", "a b c d e f g h i j", "q r s t u"] + ["k l m n o"] * 20
    items = ["x " * 7, "a b c d e f g h", "b c d e f g h i j", "A  b c d e f x x x x"] + [f"k l m n o {i}" for i in range(30)]
    grams = lambda t: [tuple(w[i : i + 5]) for w in [WORD.findall(lower(t))] for i in range(len(w) - 4)]
    hashes, item, at = overlap._seeds(pa.array(items), 5)
    order = np.argsort(hashes, kind="stable")
    table = hashes[order], item[order], at[order]
    want, near = set(), {}
    for i, t in enumerate(texts):
        for k, u in enumerate(items):
            a, b = grams(t), grams(u)
            hits = {(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]}
            for x, y in hits:
                if (x - 1, y - 1) not in hits:
                    m = next(m for m in range(1, 99) if (x + m, y + m) not in hits)
                    want.add((i, k, x, x + m + 4, y, y + m + 4))
            if hits:
                near[i, k] = len(set(a)), len(set(a) & set(b))
    made = list(overlap.passages_of(pa.array(texts), *table, 5, most))
    rows = [r for x in made for r in zip(*(c.tolist() for c in x))]
    assert len(rows) == len(want) and set(rows) == want
    assert max(len(x[0]) for x in made) <= most + 2 * len(hashes)
    once = np.array(sorted(set(zip(hashes.tolist(), item.tolist()))))
    made = list(overlap.sets_of(pa.array(texts), once[:, 0], once[:, 1], 5, most))
    rows = [r for x in made for r in zip(*(c.tolist() for c in x))]
    assert len(rows) == len(near) and {(i, k): (size, shared) for i, size, k, shared in rows} == near
    assert max(len(x[0]) for x in made) <= max(most, len(items))
    assert len(made) >= (20 if most <= 7 else 1)


def test_batches_for_python_are_bounded(spark, monkeypatch):
    """However many rows a task has, Python gets about PORTION bytes of text at a time, in every step that reads texts."""
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 300) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    before = spark.conf.get(joins.BATCH_BYTES)
    found = joins.stored(docs.mapInArrow(sizes, "n long, bytes long"), "sizes", shingles.PORTION).collect()
    assert sum(r.n for r in found) == 3000 and max(r.bytes for r in found) < 1.2 * shingles.PORTION
    seen = []

    def spy(df, name, batch_bytes=None):
        seen.append((name, "MapInArrow" in df._jdf.queryExecution().executedPlan().toString(), batch_bytes))
        return joins.stored(df, name, batch_bytes)

    for module in (overlap, minhash, tfidf):
        monkeypatch.setattr(module, "stored", spy)
    some, items = docs.limit(40), docs.limit(9).withColumnRenamed("doc_id", "item_id")
    for most in (overlap.BROADCAST_NGRAMS, 0):
        overlap.jaccards(some, items, broadcast_ngrams=most)
        overlap.passages(some, items, broadcast_ngrams=most).count()
    minhash.near_copies(some)
    tfidf.neighbours(some)
    assert {"found", "sets", "ngrams", "item-ngrams", "sketches", "class-sets", "bags"} <= {name for name, python, _ in seen if python}
    assert all(b == shingles.PORTION for name, python, b in seen if python and name in ("found", "sets", "ngrams", "item-ngrams", "sketches", "class-sets", "bags"))
    assert spark.conf.get(joins.BATCH_BYTES) == before


@pytest.mark.parametrize(("most", "rare", "sublinear"), [(tfidf.BROADCAST_TERMS, 0, True), (tfidf.BROADCAST_TERMS, 8, True), (0, 8, True), (tfidf.BROADCAST_TERMS, 8, False), (0, 1000, False)])
def test_tfidf_neighbours(spark, texts, most, rare, sublinear):
    bags = [(i, Counter(re.findall(r"\w\w+", (t or "").lower()))) for i, t in texts]
    n, df = len(bags), Counter(w for _, b in bags for w in b)

    def vector(b):
        v = {w: (1 + math.log(c) if sublinear else c) * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    key = lambda b: frozenset(b.items())
    ids = defaultdict(list)
    for i, b in bags:
        ids[key(b)].append(i)
    known = {k: vector(dict(k)) for k in ids if k}
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    links = defaultdict(list)
    for a, v in known.items():
        for b, u in known.items():
            score = round(sum(x * u.get(w, 0) for w, x in v.items()), 9)
            if a != b and score >= 0.8:
                links[a].append((score, least[b]))
    want = Counter()
    for i, b in bags:
        k = key(b)
        # a null id is the least of equally near ones
        best = min(links[k], key=lambda x: (-x[0], -1 if x[1] is None else x[1]), default=(None, None))
        want[i, least[k] if k else i, len(links[k]), best[1], None if best[0] is None else round(best[0], 6)] += 1
    found = tfidf.neighbours(frame(spark, texts, "doc_id long, text string, terms string, n string"), rare=rare, sublinear=sublinear, broadcast_terms=most).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.nearest_id, None if r.cosine is None else round(r.cosine, 6)) for r in found) == want
    assert sum(r.n_links for r in found) > 50
    assert tfidf.neighbours(spark.createDataFrame([], "doc_id long, text string"), broadcast_terms=most).collect() == []


def test_prefixes_meet_in_blocks(spark):
    """Equal pairs from one block, and from many with tiny portions; no row is made for a shared term."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        terms = np.unique(rng.choice(40, 6)) if i % 2 else np.unique(np.append(rng.choice(40, 2), [1, 2, 3]))
        rows.append((i, [int(t) << 24 for t in terms], [float(x) for x in np.full(len(terms), 0.9 / len(terms) ** 0.5)], 1 << 31, 0.3))
    prefix = spark.createDataFrame(rows, tfidf.PREFIX)
    want = set()
    for a, b in itertools.combinations(rows, 2):
        total = sum(x * b[2][0] for p, x in zip(a[1], a[2]) if p in b[1])
        if total + 0.3 * 0.3 >= 0.8 - 1e-5:
            want.add((a[0], b[0]))
    assert len(want) > 10
    for block, blocks in ((1000, 1), (13, 3)):
        found = tfidf.candidates(prefix, block=block, blocks=blocks)
        assert Counter((r.a, r.b) for r in found.collect()) == Counter(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    whole = pa.Table.from_batches(prefix.coalesce(1).toArrow().to_batches())
    block = tfidf.Block(whole)
    assert {(min(p), max(p)) for p in zip(*tfidf.meet(block, block, 0.8, portion=3))} == want


def test_few_pairs_need_exact_norms(monkeypatch):
    """Of pairs with a term in common nearly all are ruled out by norms at whole levels; the others are those found by exact norms."""
    rng = np.random.default_rng(11)
    rows, n = [], 1500
    for i in range(n):
        if i % 50 == 1:
            rows.append((i, *rows[-1][1:]))
            continue
        place = np.unique(rng.integers(0, 40, 24) << 24 | rng.integers(0, 40, 24))
        weight = rng.random(len(place))
        weight = (weight / np.sqrt((weight**2).sum()) * 0.65).astype(np.float32)
        rows.append((i, place.astype(np.int32), weight, int(rng.integers(38, 44)) << 24, 0.75))
    made = pa.table({"class": [r[0] for r in rows], "places": [r[1] for r in rows], "weights": [r[2] for r in rows], "next": [r[3] for r in rows], "rest": [r[4] for r in rows]})
    whole = np.zeros((n, 40 * 40))
    for i, (_, place, weight, _, _) in enumerate(rows):
        whole[i, (place >> 24) * 40 + (place & 0xFFFFFF)] = weight
    total = whole @ whole.T
    want, met = set(), 0
    for i in range(n):
        others = np.flatnonzero(total[i, i + 1 :] > 0) + i + 1
        met += len(others)
        for j in others.tolist():
            x, y = (i, j) if rows[i][3] <= rows[j][3] else (j, i)
            norm = np.sqrt((rows[y][2].astype(float)[rows[y][1] >= rows[x][3]] ** 2).sum() + rows[y][4] ** 2)
            if total[i, j] + rows[x][4] * norm >= 0.8 - 1e-5:
                want.add((i, j))
    asked, norm = [], tfidf.Block.norm
    monkeypatch.setattr(tfidf.Block, "norm", lambda self, row, place: asked.append(len(row)) or norm(self, row, place))
    block = tfidf.Block(made)
    assert {(min(p), max(p)) for p in zip(*tfidf.meet(block, block, 0.8))} == want and len(want) >= n // 50
    assert sum(asked) < met / 10


def test_terms_of_any_text_are_those_of_the_pattern():
    texts = [None, "", "a", "Ab ab AB x", "ÄÖ ß ÿÿ µm ²³ ª1 ¼½ naïve_x", "one\x85two\xa0three\x1cfour", "İstanbul ΣΑΣ ʼn œuvre", "日本 語", "tail end", "\n\n", "x" * 70]
    for some in (texts, texts[:6], texts[6:8], [], [None]):
        hashed, row = tfidf.hashed_terms(some)
        found = [(i, w) for i, t in enumerate(some) for w in tfidf.TERM.findall((t or "").lower())]
        want = shingles.hash_words(pa.array([w for _, w in found], pa.string()))
        assert sorted(zip(row.tolist(), hashed.tolist())) == sorted(zip([i for i, _ in found], want.tolist()))


def made_vectors(n=500, d=12):
    rnd = np.random.default_rng(4)
    out = rnd.normal(size=(n, d))
    out[100:200] = out[7]
    out[200:260] = out[8] + 0.2 * rnd.normal(size=(60, d))
    out[260:300] = 3 * out[9:49]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


ODD_VECTORS = [(None, [1.0] * 12), (1000, None), (1020, [0.0] * 12), (1040, [1.0] * 5), (1060, [float("nan")] + [1.0] * 11), (1080, [None] + [1.0] * 11)]


def cosine(rows):
    m = np.array([v for _, v in rows])
    m = m / np.sqrt((m * m).sum(1))[:, None]
    return np.round(m @ m.T, 9)


@pytest.mark.parametrize(("per_cell", "block", "queries"), [(2000, 2048, 1024), (20, 7, 3)])
def test_exact_search(spark, per_cell, block, queries):
    rows = made_vectors()
    score = cosine(rows)
    want = sorted((i, j, p + 1) for i in range(0, len(rows), 20) for p, j in enumerate(sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[i, j], j))[:10]))
    df = spark.createDataFrame(rows + ODD_VECTORS, "vec_id long, embedding array<float>").repartition(4)
    found = vectors.search(df, per_cell=per_cell, block=block, queries=queries, draw=300).collect()
    assert sorted((r.id, r.neighbour, r.place) for r in found) == want
    assert vectors.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_of_probing(spark):
    """More probes find more; clustered vectors need few of the cells."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16))
    rows = [(int(i), [float(x) for x in centres[i % 40] + 0.25 * rnd.normal(size=16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    exact = {(r.id, r.neighbour) for r in vectors.search(df, per_cell=50).collect()}
    recall = [len(exact & {(r.id, r.neighbour) for r in vectors.search(df, per_cell=50, probes=p).collect()}) / len(exact) for p in (1, 4, 40)]
    assert recall[0] <= recall[1] <= recall[2] and recall[1] >= 0.9 and recall[2] >= 0.97, recall


@pytest.mark.parametrize(("per_cell", "block"), [(2000, 2048), (20, 7)])
def test_semantic_links(spark, per_cell, block):
    rows = made_vectors()
    score = cosine(rows)
    first = {}
    for i, v in rows:
        first.setdefault(tuple(v), i)
    want = [(i, first[tuple(v)], sum(1 for j in first.values() if first[tuple(v)] != j and score[i, j] >= 0.85)) for i, v in rows]
    df = spark.createDataFrame(rows + ODD_VECTORS, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, vectors.links(df, per_cell=per_cell, block=block, draw=300).collect())) == want
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("least", [1, 5])
def test_links_of_spread_vectors_meet_in_blocks(spark, monkeypatch, least):
    """Where cells rule out little, no vector is sent to its rims; pairs are the same."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 10))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base[:60] + rng.normal(size=(60, 10)) * 0.25]).astype(np.float32))]
    score = cosine(rows)
    monkeypatch.setattr(vectors, "LEAST_BLOCKS", least)
    monkeypatch.setattr(vectors, "_meet", None)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = [(i, i, sum(1 for j, _ in rows if j != i and score[i, j] >= 0.85)) for i, _ in rows]
    assert sorted(map(tuple, vectors.links(df, per_cell=10, draw=200, together=100).collect())) == want
    assert sum(w[2] for w in want) > 50


@pytest.mark.parametrize("held", [10, 10_000])
def test_top_k(spark, held):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, "a", "a", "a", "b", *map(str, range(30))]), rnd.choice([None, 1.0, 2.0, rnd.random()]), rnd.choice([None, *range(50)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, s double, t long").repartition(6)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = Counter((*r, p + 1) for v in by.values() for p, r in enumerate(sorted(v, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0))[:7]))
    assert Counter(map(tuple, topk.top_k(df, ["k"], "s", ["t"], 7, held, 2).collect())) == want


def made_spans(seed, n=300, top=900):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 2, 2, None]), a := rnd.randrange(top), a + rnd.choice([-3, 0, 1, 5, 40, 300])) for _ in range(n)] + [(1, None, 5), (9, 0, 3), (seed + 20, 2, 4)]


@pytest.mark.parametrize("width", [spans.BIN, 7])
def test_detection_measures(spark, width):
    found, truth = made_spans(1), made_spans(2)

    def measure(found, truth):
        def share(x, others):
            hit = [o for o in others if o[0] == x[0] and max(o[1], x[1]) < min(o[2], x[2])]
            return len({p for o in hit for p in range(max(o[1], x[1]), min(o[2], x[2]))}) / (x[2] - x[1]), len(hit)

        p, r = [share(x, truth)[0] for x in found], [share(x, found) for x in truth]
        hits = [h for _, h in r if h]
        p, r, g = (np.mean(p) if p else 0, np.mean([s for s, _ in r]) if r else 0, np.mean(hits) if hits else 1)
        return p, r, g, 2 * p * r / (p + r) / math.log2(1 + g) if p + r else 0

    good = lambda rows: [x for x in rows if x[1] is not None and x[1] < x[2]]
    dfs = [spark.createDataFrame(x, "doc long, start long, end long").repartition(3) for x in (found, truth)]
    got = spans.evaluate(*dfs, ["doc"], ["doc"], width).collect()
    assert {r.doc for r in got} == {x[0] for x in good(found) + good(truth)}
    for r in got:
        a, b = ([x for x in good(s) if x[0] == r.doc] for s in (found, truth))
        assert (r.n_found, r.n_true) == (len(a), len(b))
        assert np.allclose((r.precision, r.recall, r.granularity, r.plagdet), measure(a, b)), r
    (r,) = spans.evaluate(*dfs, ["doc"], width=width).collect()
    assert np.allclose((r.precision, r.recall, r.granularity, r.plagdet), measure(good(found), good(truth)))


def test_reports(spark):
    rnd = random.Random(7)
    docs = [(1, 'a <b> & "c" \' é 日本 ' * 5), (2, None), (3, ""), (4, "plain"), (5, "x&y" * 20)]
    marks = [(d, lab, a := rnd.randrange(60), a + rnd.choice([0, 1, 9, 30])) for d in (1, 2, 3, 5) for lab in ("p", "q<", "q<") for _ in range(3)]
    found = spans.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, label string, start long, end long")).collect()
    assert {r.doc_id for r in found} == {1, 3, 5}
    for r in found:
        text = dict(docs)[r.doc_id]
        own = [(a, min(z, len(text)), lab) for d, lab, a, z in marks if d == r.doc_id and a < z and a < len(text)]
        assert (r.n_spans, r.covered) == (len(own), len({p for a, z, _ in own for p in range(a, z)}))
        parts, at = re.split(r'(<mark data-of="[^"]*">|</mark>)', r.html), 0
        inside = None
        for part in parts:
            if part.startswith("<mark"):
                assert inside is None  # marks don't nest or cross
                inside = html.unescape(part[15:-2])
            elif part == "</mark>":
                inside = None
            else:
                for c in html.unescape(part):
                    names = sorted({html.escape(lab) for a, z, lab in own if a <= at < z})
                    assert c == text[at] and inside == (html.unescape(" ".join(names)) if names else None)
                    at += 1
        assert at == len(text)


def test_characters_of_passages(spark):
    docs = spark.createDataFrame([(1, "  Ab\tcd  é\n日本 x ")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 1), (1, 1, 4), (1, 4, 5), (1, 4, 6), (2, 0, 1)], "doc_id long, doc_start long, doc_end long")
    got = {(r.doc_start, r.doc_end): (r.start, r.end) for r in overlap.characters(found, docs).collect()}
    assert got == {(0, 1): (2, 4), (1, 4): (5, 13), (4, 5): (14, 15)}


def test_word_hashes_are_of_words():
    import pyarrow as pa

    rnd = random.Random(1)
    texts = ["".join(rnd.choice(" \t\n\x0b\r\x0cABcdé日 \x85") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, ""]
    all_, begins = shingles.words(pa.array(texts))
    got = [all_[a:b].to_pylist() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
    assert got == [WORD.findall(lower(t)) for t in texts]


def test_citation_context_marks_near_lines(spark):
    from papyrine.operators.context import citation_context

    md = "# T\n\na [1, 2] b\nnext\n\n\n\nfar\nlast [9]\nReferences\n[1] One.\n[2] Two. [5]"
    got = sorted((r.pos, r.marker_pos, r.distance, r.ref_id, r.raw) for r in citation_context(spark.createDataFrame([(1, md), (2, None), (3, "none")], "doc_id long, markdown string")).collect())
    assert got == [(0, 2, 2, "1", "[1] One."), (0, 2, 2, "2", "[2] Two. [5]"), (2, 2, 0, "1", "[1] One."), (2, 2, 0, "2", "[2] Two. [5]"), (3, 2, 1, "1", "[1] One."), (3, 2, 1, "2", "[2] Two. [5]"), (7, 8, 1, "9", None), (8, 8, 0, "9", None)]


def test_plans_have_no_cartesian_product(spark):
    from papyrine.plans.similarity import queries

    for name in ("ngram_overlap", "candidates_topk", "citation_context"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_equal_spans_are_covered_once(spark):
    """Many equal spans over a whole text are one part, however they are ordered."""
    spans_ = spark.createDataFrame([(1, 7 + k % 2, 0, 6) for k in range(14)], "doc_id long, label long, start long, end long").repartition(5)
    found = spans.report(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string"), spans_).first()
    assert (found.n_spans, found.covered) == (14, 6)
    assert '"parts":[{"start":0,"end":6}]' in found.report
