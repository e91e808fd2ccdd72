"""Stages on awkward rows and planted cases, each against brute force."""

import re

import corpus_pipeline
import pytest
from conftest import SF

from papyrine.llm import quality, secrets, simhash
from test_operators import counts, folders, rows, spans, tokens  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        w = tokens(t)
        sets.append({b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {b" ".join(w)} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_stages(spark, folders):  # noqa: F811
    docs = spark.read.parquet(f"{folders['edge']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders["edge"])
        assert out.schema == docs.schema, name
    kept = corpus_pipeline.keep_quality(spark, docs, folders["edge"]).collect()
    assert len(kept) > 0 and not any(counts(r.text)[-1] for r in kept) and {r.kept for r in kept} == {"k"}
    masked = corpus_pipeline.mask_secrets(spark, docs, folders["edge"]).collect()
    assert len(masked) == len(rows()) and not any(spans(r.text) for r in masked)
    assert all(r.n_chars == len(r.text) for r in masked if secrets.MARK in (r.text or ""))


@pytest.mark.parametrize("kind", ["edge", "empty"])
def test_near_copies(spark, folders, kind):  # noqa: F811
    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
    out = corpus_pipeline.drop_near_copies(spark, docs, folders[kind]).collect()
    texts = [r.text for r in out]
    for i, a in enumerate(texts):
        assert all(jaccard(a, b) < 0.8 for b in texts[:i])  # nothing that stays has a near copy that stays
    for r in rows() if kind == "edge" else []:
        assert any(jaccard(r["text"], t) >= 0.8 for t in texts)  # everything that went has one that stayed


def test_runs_whole(spark, folders):  # noqa: F811
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 100
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if not counts(r.text)[-1]}
    assert ids <= clean and len(ids) > 0.6 * len(clean)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "secrets", "packing"]
    assert re.fullmatch(r"[a-z_]+", "_".join(r for r, *_ in quality.THRESHOLDS))


def brute_components(texts, similarity=0.8):
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(a & sets[j]) >= similarity * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def test_near_copies_among_texts_of_one_template(spark):
    """Near copies are found among many texts that share a template but aren't near copies themselves."""
    import random

    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    template = [word() for _ in range(120)]
    texts = [" ".join(template + [word() for _ in range(28)]) for _ in range(300)]
    for i in range(0, 60):
        w = texts[i].split()
        w[-1 - i % 20] = word()
        texts.append(" ".join(w))
    out = simhash.near_unique(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == list(range(300)) and len(set(brute_components(texts))) == 300


def test_near_copies_at_the_threshold(spark):
    """All pairs just over the similarity are found, in a small table as in a large one, and none just under it."""
    import random

    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for i in range(150):
        w = [word() for _ in range(rnd.randint(8, 400))]
        v = list(w)
        for at in rnd.sample(range(len(w)), max(1, len(w) // rnd.choice([44, 48, 56]))):
            v[at] = word()
        texts += [" ".join(w), " ".join(v)]
    label = brute_components(texts)
    assert 230 > len(set(label)) > 160
    want = [i for i, x in enumerate(label) if x not in label[:i]]
    for more in (0, 3000):
        rows = list(enumerate(texts)) + [(10**6 + i, " ".join(word() for _ in range(12))) for i in range(more)]
        out = simhash.near_unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.doc_id for r in out) == want + [10**6 + i for i in range(more)]


def test_different_texts_with_one_fingerprint_stay(spark):
    import random

    rnd = random.Random(10)
    word = lambda: f"w{rnd.randrange(10**6)}"
    phrase = " ".join(word() for _ in range(11))
    texts = [" ".join([phrase] * 200 + [word() for _ in range(1100)]) for _ in range(12)]
    assert len({simhash.fingerprint(t.encode(), 5) for t in texts}) < 12
    out = simhash.near_unique(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == 12
