"""Incremental crawling as set operations: what is new, in which batch, in one schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import sanitize
from papyrine.operators import html as H

#: The one metadata model; sources that lack a column leave it null.
PAPER_COLUMNS = ["paper_name", "year", "conference_name", "workshop_or_main_conference", "paper_path"]


def new_by_title(candidates: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Candidates whose paper_name isn't known; of equal names the first by ``order``."""
    first = candidates.groupBy("paper_name").agg(F.min(F.struct(order, *(c for c in candidates.columns if c not in (order, "paper_name")))).alias("row"))
    rows = first.select(*(F.col("paper_name") if c == "paper_name" else F.col(f"row.{c}").alias(c) for c in candidates.columns))
    return rows.join(known.select("paper_name").distinct(), "paper_name", "left_anti")


def new_by_path(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose target file isn't there yet."""
    return candidates.join(existing.select("paper_path").distinct(), "paper_path", "left_anti")


def unite_papers(*sources: DataFrame) -> DataFrame:
    """All sources in the one metadata model, ``workshop_or_main`` under its common name."""
    named = [s.withColumnRenamed("workshop_or_main", "workshop_or_main_conference") for s in sources]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return whole.select(*(F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in PAPER_COLUMNS)).withColumn("year_int", F.col("year").try_cast("int"))


def listing_pages(rows: DataFrame, key: str, size: int, width: int = 1000) -> DataFrame:
    """``rows`` with the number of the listing page they are on, ``size`` a page in ``key`` order.

    Rows are ranked inside ranges of ``width`` keys and shifted by running totals of the ranges, which are summed inside
    stretches of ``width`` ranges first; only the stretches' sums, one for ``width`` squared keys, meet in one task.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(key) / width)).withColumn("__stretch", F.floor(F.col("__range") / width))
    totals = ranged.groupBy("__stretch", "__range").agg(F.count("*").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = totals.groupBy("__stretch").agg(F.sum("__n").alias("__n")).select("__stretch", before(Window.orderBy("__stretch")).alias("__outer"))
    inner = totals.withColumn("__inner", before(Window.partitionBy("__stretch").orderBy("__range"))).drop("__n")
    shift = inner.join(outer, "__stretch").select("__range", (F.col("__outer") + F.col("__inner")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("__at", inside).join(shift, "__range").withColumn("listing_page", F.floor((F.col("__before") + F.col("__at")) / size)).drop("__range", "__stretch", "__at", "__before")


def follow(frontier: DataFrame, links: DataFrame, level: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``frontier`` (.., url) one level down: ``url`` under the name ``level``, and each distinct target of its page as ``url``.

    ``links`` is (url, target); ``keep`` says which targets count.
    """
    down = links.where(keep(F.col("target"))) if keep else links
    return frontier.withColumnRenamed("url", level).join(down.select(F.col("url").alias(level), "target").distinct(), level).withColumnRenamed("target", "url").distinct()


#: Where a proceedings site has its volumes and papers.
VOLUME_LIST, VOLUME_LINK, PAPER_BLOCK, PAPER_TITLE, PAPER_DETAILS, PAPER_FILE = "field-item", "proceedings", "paper_wrapper", "title", "details", r"\.pdf$"


def volumes(index: DataFrame) -> DataFrame:
    """The distinct (url) of the volumes that ``index`` pages (url, html) list."""
    listed = H.section(F.col("html"), "div", "class", VOLUME_LIST)
    found = index.select("url", F.explode(H.links(listed)).alias("l")).where(F.col("l.href").contains(VOLUME_LINK))
    return found.select(H.resolve(F.col("url"), F.col("l.href")).alias("url")).distinct()


def volume_papers(pages: DataFrame, conference: str = "IJCAI") -> DataFrame:
    """``pages`` (url, html, ..) as papers: a row for each block with a title and a link to a file; columns but html are kept."""
    block = F.col("block")
    blocks = pages.withColumn("block", F.explode(H.sections(F.col("html"), "div", "class", PAPER_BLOCK))).drop("html")
    file = H.first_link(H.find_first(block, "div", "class", PAPER_DETAILS), PAPER_FILE)
    year = H.url_year(F.col("url"))
    rows = blocks.withColumns({"paper_name": H.joined_text(H.find_first(block, "div", "class", PAPER_TITLE)), "year": year, "conference_name": F.concat(F.lit(f"{conference} "), year), "workshop_or_main": F.lit("main"), "pdf_url": H.resolve(F.col("url"), file)})
    return rows.where("paper_name IS NOT NULL AND pdf_url IS NOT NULL").drop("block")


def proceedings(index: DataFrame, fetch: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, conference: str = "IJCAI") -> DataFrame:
    """The papers of all volumes that ``index`` lists, those whose paper_path is ``known`` left out; ``fetch`` gives (url, html) of a table of urls."""
    papers = volume_papers(fetch(volumes(index)), conference)
    name = F.concat(F.col("year"), F.lit("_"), F.left(sanitize(F.col("paper_name")), F.lit(120)), F.lit(".pdf"))
    papers = papers.withColumn("paper_path", name)
    return papers if known is None else new_by_path(papers, known)
