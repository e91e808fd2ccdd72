"""What the pipeline leaves in the driver: no freed memory is kept, no plan holds another's joins, no round is run in vain."""

import ctypes
import re
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from papyrine.llm import components


def held_mb():
    ctypes.CDLL(None).malloc_trim(0)
    return own_mb()


def own_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_learning_keeps_no_memory(spark, tmp_path):
    words = F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(250_000)).cast("string")))
    ids = spark.range(12_000).withColumnRenamed("id", "doc_id")
    ids.select("doc_id", F.array_join(words, " ").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    ids.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = held_mb()
    kept = corpus_pipeline.drop_toxic(spark, documents, str(tmp_path))
    assert own_mb() < before + 30
    assert kept.columns == documents.columns


def test_components_store_small_plans(spark, monkeypatch):
    stored = []

    def materialize(df, name):
        stored.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(components, "materialize", materialize)
    stars = [(10 * i, 10 * i + k) for i in range(20) for k in range(1, 10)]
    for more, roots, most in (([], 20, 1), ([(3, 25), (47, 92), (92, 3)], 17, 9)):
        del stored[:]
        out = components.components(spark.createDataFrame(stars + more, "a long, b long")).collect()
        assert len({r.root for r in out}) == roots
        assert len(stored) <= most  # stars need no round
        assert all(plan.count("Join ") <= 1 for plan in stored)
