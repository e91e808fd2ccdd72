"""PDF text blocks: cleaning, merging of neighbours, union with figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import clean_text, not_blank


def clean_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(not_blank(F.col("text"))).withColumn("text", clean_text(F.col("text")))


def merge_blocks(blocks: DataFrame, y_threshold: float = 10.0) -> DataFrame:
    """Join each block of a page to the one above it if it starts less than ``y_threshold`` from where that one ended.

    A merged block keeps the first block's x0 and y0, the largest x1 and the last block's y1; texts join with a blank.
    Pages are the unit of work, so a long document splits.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "block_idx")
    starts = F.coalesce(F.abs(F.col("y0") - F.lag("y1").over(order)) >= y_threshold, F.lit(True)).cast("int")
    marked = blocks.withColumn("place", F.row_number().over(order)).withColumn("start", starts)
    islands = marked.withColumn("island", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda b: b["text"]), " ")
    return islands.groupBy("doc_id", "page", "island").agg(
        F.min_by("x0", "place").alias("x0"), F.min_by("y0", "place").alias("y0"), F.max("x1").alias("x1"), F.max_by("y1", "place").alias("y1"), text.alias("text"))


def union_blocks(texts: DataFrame, figures: DataFrame) -> DataFrame:
    """One table of tagged rows; members that a kind lacks are null."""
    return texts.withColumn("type", F.lit("text")).unionByName(figures.withColumn("type", F.lit("figure")), allowMissingColumns=True)


def top_blocks(blocks: DataFrame, n: int = 10) -> DataFrame:
    return blocks.orderBy("doc_id", "page", "y0", "block_idx").limit(n)
