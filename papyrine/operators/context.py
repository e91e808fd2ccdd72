"""Which references stand behind a passage: every line of a paper's body with its nearest citation and what that one cites.

The citation of a line is the nearest line with a bracketed number, before or after it (before, if both are as near), up to
``WITHIN`` lines away. Lines and citations meet in one pass over a document's lines in order, not pair by pair.

Edge cases: blank lines are positions but have no context of their own; a number without a reference entry has a null raw; a
document without citations gives none; a null document has no line; a repeated number in one line counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions import text as T
from papyrine.operators import segment as S

WITHIN = 3
MARKER = rf"\[{P.D}+(?:,{P.WS}*{P.D}+)*\]"


def numbers(line: Column) -> Column:
    """The distinct numbers of all bracketed citations of a line, as text."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(line, F.lit(MARKER), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit(rf"{P.D}+"), F.lit(0)))))


def body(md: Column) -> Column:
    """What comes before the first mention of references or bibliography."""
    return F.split(md, "(?i)references|bibliography", 2)[0]


def citation_context(papers: DataFrame, within: int = WITHIN, version: int = 2) -> DataFrame:
    """(doc_id, pos, marker_pos, distance, ref_id, raw) of ``papers`` (doc_id, markdown): a row for each number of a line's citation."""
    rows = papers.select("doc_id", "markdown").withColumn("row", F.monotonically_increasing_id())
    found = rows.select("row", "doc_id", F.posexplode(T.lines(body(F.col("markdown")))).alias("pos", "line")).withColumn("numbers", numbers(F.col("line")))
    at = F.when(F.size("numbers") > 0, F.struct("pos", "numbers"))
    order = Window.partitionBy("row").orderBy("pos")
    back = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(at, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = found.withColumns({"back": back, "ahead": ahead}).where(T.not_blank(F.col("line")))
    behind, before = F.col("pos") - F.col("back.pos"), F.col("ahead.pos") - F.col("pos")
    chosen = F.when(F.col("ahead").isNull() | (behind <= before), F.col("back")).otherwise(F.col("ahead"))
    near = near.withColumn("marker", chosen).withColumn("distance", F.abs(F.col("pos") - F.col("marker.pos"))).where(F.col("distance") <= within)
    cited = near.select("row", "doc_id", "pos", F.col("marker.pos").alias("marker_pos"), "distance", F.explode("marker.numbers").alias("ref_id"))
    entries = rows.select("row", F.explode(S.references(F.col("markdown"), version)).alias("r")).select("row", "r.ref_id", "r.raw")
    return cited.join(entries, ["row", "ref_id"], "left").select("doc_id", "pos", "marker_pos", "distance", "ref_id", "raw")
