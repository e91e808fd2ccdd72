"""What the pipeline's Python workers hold: no vocabulary as Python strings, no freed memory, no Arrow batch of any length."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from papyrine.llm import common, toxicity

ROOT = Path(__file__).resolve().parents[2]
#: Each is run by a process of its own, as a worker is, so that nothing else is in its memory.
OWN_MB = """
import re, types
from pathlib import Path
import numpy as np, pyarrow as pa
from papyrine.llm import common, toxicity
def own_mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
"""
SCORING = """
n, words = 64, 300_000
entry, term = np.repeat(np.arange(n, dtype=np.int32), words // n), np.arange(words // n * n, dtype=np.int32)
half = (np.arange(n) % 2).astype(float)
examples = toxicity.Examples(entry, term, np.ones(len(term), np.float32), 1 - half, half)
model = toxicity.Model(pa.array([f"word{i:06}" for i in range(words)]), np.ones(words), examples, (1.0, 1.0), 0.5)
toxicity.append_columns = lambda df, fields, make, *rest: make
session = types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda m: types.SimpleNamespace(value=m)))
make = toxicity.score(types.SimpleNamespace(sparkSession=session), model)
model.index
common.give_back()
before = own_mb()
run = make()
common.give_back()
assert own_mb() < before + 20, own_mb() - before
assert run(pa.array(["word000001 word000003"]))[1][0].startswith("clean:")
"""
RETURNING = """
pins = []
class Frame:
    def mapInArrow(self, run, schema):
        return run
def make():
    def run(column):
        held = [bytes(2000) for _ in range(50_000)]
        pins.append(held[-1])  # the heap can't shrink from its end
        return [[len(held)] * len(column)]
    return run
from pyspark.sql.types import LongType, StructField, StructType
kind = StructType([StructField("text", __import__("pyspark").sql.types.StringType())])
df = Frame()
df.columns, df.schema = ["text"], kind
common.pick = lambda df, *names: df
run = common.append_columns(df, StructType([StructField("n", LongType())]), make)
before = own_mb()
assert [b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b"])], names=["text"])]))] == [2]
assert own_mb() < before + 30, own_mb() - before
"""


def alone(code):
    done = subprocess.run([sys.executable, "-c", OWN_MB + code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_scoring_holds_no_vocabulary_of_strings():
    alone(SCORING)


def test_a_task_returns_what_it_has_freed():
    alone(RETURNING)


def test_stages_get_small_batches(spark):
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 5000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["doc_id"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        stage = corpus_pipeline.guarded(docs, lambda d: d.mapInArrow(sizes, "doc_id long").withColumn("text", F.lit("")))
        found = [r.doc_id for r in stage.collect()]
        assert sum(found) > 30_000_000 and max(found) < 2 * common.BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_places_of_words(monkeypatch):
    vocabulary = pa.array(["a", "b", "été", "ab"])
    asked = pa.array(["ab", "no", "été", "", "a"])
    assert toxicity.Numbers(vocabulary).of(asked).tolist() == [3, -1, 2, -1, 0]
    assert toxicity.Numbers(pa.array([], pa.string())).of(asked).tolist() == [-1] * 5
    honest = toxicity.xxhash.xxh3_64_intdigest
    # words that share a hash: known ones get another seed, others aren't taken for them
    monkeypatch.setattr(toxicity.xxhash, "xxh3_64_intdigest", lambda w, seed=0: honest(w[:1], seed) if seed < 2 else len(w))
    assert toxicity.Numbers(pa.array(["a", "bb", "bcc"])).of(pa.array(["bcc", "xyz", "a", "b"])).tolist() == [2, -1, 0, -1]
