"""From Markdown to the processed document: independent expressions over one column, in one pass and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from papyrine.functions import metadata as M
from papyrine.functions.text import let
from papyrine.operators import segment as S


def process_documents(df: DataFrame, md: str = "markdown", doc_id: str | Column = "doc_id", version: int = 2, extra: bool = False, source: str | None = None, pages: str | None = None) -> DataFrame:
    """doc_id, title, abstract, sections, references of each row; ``extra`` adds organization, publish_date, extraction_date
    and, from columns of these names, source and total_pages."""
    text = F.col(md)
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    out = df.select(
        key.alias("doc_id"), M.paper_title(text).alias("title"), M.abstract(text, version).alias("abstract"),
        S.output_sections(S.parse_sections(text, version), version).alias("sections"), S.references(text, version).alias("references"), text.alias("__md"),
        (F.col(source) if source else F.lit(None)).cast("string").alias("source"), (F.col(pages) if pages else F.lit(None)).cast("int").alias("total_pages"),
    )
    more = [M.organization(F.col("__md")).alias("organization"), M.publish_date(F.col("__md")).alias("publish_date"), "source", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("extraction_date"), "total_pages"] if extra else []
    return out.select("doc_id", "title", "abstract", "sections", "references", *more)


def observed(documents: DataFrame, name: str = "documents") -> tuple[DataFrame, Observation]:
    """``documents`` with counts that an action on it fills in: documents, sections, references and documents without sections."""
    seen = Observation(name)
    none = F.count(F.when(F.size("sections") == 0, 1)).alias("without_sections")
    return documents.observe(seen, F.count("*").alias("documents"), F.sum(F.size("sections")).alias("sections"), F.sum(F.size("references")).alias("references"), none), seen


def corpus_stats(df: DataFrame, md: str = "markdown", version: int = 2) -> DataFrame:
    """Counts over the documents that ``process_documents`` would give, without their texts: one aggregation, one row."""
    text = F.col(md)
    kept = S.kept_sections(S.parse_sections(text, version), version)
    counts = df.select(let(kept, lambda k: F.struct(F.size(k).alias("n"), F.aggregate(k, F.lit(0), lambda a, s: a + S.cited(s)).alias("cited"))).alias("s"), F.size(S.references(text, version)).alias("r"), M.abstract(text, version).alias("abstract"))
    return counts.agg(
        F.count("*").alias("n_documents"), F.sum("s.n").alias("n_sections"), F.sum("r").alias("n_references"), F.sum("s.cited").alias("n_citations"),
        F.count(F.when(F.col("abstract") != "", 1)).alias("n_abstracts"))
