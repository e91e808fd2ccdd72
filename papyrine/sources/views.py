"""Views over the test tables that stand in for crawled papers; one SQL text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BODY = """'<!-- image -->' || chr(10) || chr(10) || 'This paper is the Open Access version, see proceedings' || chr(10) || chr(10)
 || '## ' || left(replace(text, chr(10), ' '), 80) || chr(10) || chr(10)
 || 'Example University, ' || lang || chr(10) || 'Published: ' || CAST(13 + doc_id % 15 AS STRING) || '/0' || CAST(1 + doc_id % 9 AS STRING) || '/2023' || chr(10) || chr(10)
 || '## Abstract' || chr(10) || chr(10) || left(replace(text, chr(10), ' '), 900) || chr(10) || chr(10)
 || '## 1. Introduction' || chr(10) || chr(10)
 || replace(text, chr(10), ' [' || CAST(1 + doc_id % 7 AS STRING) || ', ' || CAST(9 + doc_id % 3 AS STRING) || '] (Müller, 2020a)' || chr(10) || chr(10)) || chr(10)
 || CASE WHEN doc_id % 2 = 0 THEN 'II. Methods' || chr(10) || left(text, 400) || chr(10) ELSE '' END
 || '## Empty ##' || chr(10) || '#  ' || chr(10) || '## References' || chr(10) || chr(10)
 || '- [1] First author. Title one.' || chr(10) || 'continued line' || chr(10) || '- [2] Second (Doe et al., 2019).' || chr(10)
 || CASE WHEN doc_id % 3 = 0 THEN 'Appendix A' || chr(10) || '- [3] after the stop' || chr(10) ELSE '' END"""
#: Other shapes by doc_id: no heading long enough, the four date forms, no abstract end, early mention of references.
_DATES = "CASE doc_id % 5 WHEN 0 THEN 'Date 2023-02-31' WHEN 1 THEN 'March, 2021' WHEN 2 THEN 'in CVPR-2023' WHEN 3 THEN 'Published: 01/05/2024, ACM MM 2021' ELSE 'none' END"
_OTHER = f"""'# Short' || chr(10) || {_DATES} || chr(10) || '12. numbered line that is long enough to be a title candidate' || chr(10)
 || text || chr(10) || 'Abstract- open ended ' || left(replace(text, chr(10), ' '), 200) || ' with preferences' || chr(10) || 'A first entry' || chr(10)
 || '1. Second entry' || chr(10) || 'iv) lower roman' || chr(10) || '* [3] third' || chr(10) || 'more' || chr(10) || chr(9) || chr(10) || 'VI: x' || chr(10) || 'mix of things' || chr(10) || 'Abstract:'"""
MARKDOWN = f"CASE WHEN doc_id % 11 = 10 THEN {_OTHER} ELSE {_BODY} END"
MARKDOWN_SQL = f"SELECT doc_id, {MARKDOWN} AS markdown FROM documents"
BLOCKS_SQL = """SELECT doc_id, CAST(floor(i / 40) AS INT) AS page, CAST(i AS INT) AS block_idx, CAST(10 + i % 3 AS DOUBLE) AS x0,
 CAST(12 * (i % 40) + (7 * doc_id + 5 * i) % 9 AS DOUBLE) AS y0, CAST(10 + i % 3 + length(line) % 90 AS DOUBLE) AS x1,
 CAST(12 * (i % 40) + (7 * doc_id + 5 * i) % 9 + 1 + i % 4 AS DOUBLE) AS y1, line AS text"""
FILE_NAME = "'/in/' || source || '.v' || CAST(doc_id % 4 AS STRING) || '/' || lang || ' pápér (' || CAST(doc_id AS STRING) || ').final.pdf'"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MARKDOWN} AS markdown")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.selectExpr(*[x.strip() for x in _columns(BLOCKS_SQL)])


def _columns(sql: str) -> list[str]:
    """Top-level items of a SELECT list."""
    out, depth, item = [], 0, ""
    for c in sql.removeprefix("SELECT "):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]
