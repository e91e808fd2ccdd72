"""A corpus pipeline of five stages; each works on all rows that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import packing, quality, secrets, simhash, toxicity
from papyrine.llm.common import checkpoint_dir, give_back, pick, read, small_batches


def guarded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs`` with all columns but doc_id and text under neutral names, so no name can clash with its own."""
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = [n if n in ("doc_id", "text") else f"x{i}" for i, n in enumerate(names)]
    return pick(stage(docs.toDF(*plain)), *plain).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold, unchanged."""
    small_batches(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    kept = guarded(docs, lambda d: toxicity.score(d, model).where(F.col("score") < toxicity.THRESHOLD))
    del model  # it has been sent
    give_back()
    return kept


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the threshold table, unchanged."""
    return guarded(docs, lambda d: quality.quality(d).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more), unchanged."""
    return guarded(docs, simhash.near_unique)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the spans of secrets replaced in text and n_chars set anew where that changed it."""
    length = f"x{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None
    return guarded(docs, lambda d: secrets.redact(d, length=length))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality", keep_quality), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("packing", pack_sequences),
]
#: Learnt scores, hashed fingerprints and a packing plan have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    import uuid

    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
