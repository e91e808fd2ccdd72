"""The crawlers' resumable batches as Structured Streaming: new files in, processed documents out, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from papyrine.plans.document import process_documents


def markdown_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id string, markdown) from Parquet files as they arrive."""
    return spark.readStream.schema("doc_id string, markdown string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def process_stream(documents: DataFrame, out: str, checkpoint: str, version: int = 2, once: bool = True) -> StreamingQuery:
    """Append processed documents to a Parquet table; the checkpoint remembers which files are done."""
    writer = process_documents(documents, version=version).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def resume_stream(candidates: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Metadata rows with a paper_name not seen in any earlier batch; the state store holds the known names."""
    fresh = candidates.where(F.col("paper_name").isNotNull()).dropDuplicates(["paper_name"])
    writer = fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
