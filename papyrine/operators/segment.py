"""Markdown to sections, paragraphs and references.

Everything stays inside the document's row: lines, heading marks and slices are arrays, so segmentation needs no shuffle
and a corpus splits by documents only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions.metadata import citations
from papyrine.functions.text import let, lines, not_blank, strip


def markdown_heading(line: Column, version: int = 2) -> Column:
    """Title of a ``#`` heading or null; version 1 keeps trailing marks and takes an empty title, version 2 neither."""
    pattern = f"(?d){P.HEADER_V1 if version == 1 else P.HEADER_V2}"
    title = strip(F.regexp_extract(line, pattern, 1))
    return F.when(line.startswith("#") & line.rlike(pattern), title if version == 1 else F.nullif(title, F.lit("")))


def _roman(text: Column) -> Column:
    numeral = F.upper(F.regexp_extract(text, f"(?di){P.ROMAN}", 1))
    title = F.btrim(F.regexp_extract(text, f"(?di){P.ROMAN}", 2), F.lit(" .:-"))
    # cheap tests first: most lines are too long or start with another letter
    short = (F.char_length(text) <= P.ROMAN_LONGEST) & F.lower(F.left(text, F.lit(1))).isin(list("ivxlcdm"))
    return F.when(short, F.when((numeral != "") & (F.char_length(title) >= 2), F.concat(numeral, F.lit(". "), title)))


def _special(text: Column) -> Column:
    return F.when(F.lower(F.left(text, F.lit(8))) == "abstract", F.when(F.rtrim(F.lower(text), F.lit(":.-")) == "abstract", F.lit("Abstract")))


def roman_heading(line: Column) -> Column:
    """``"III. Title"`` of a line that starts with a Roman numeral, or null."""

    return let(strip(line), _roman)


def special_heading(line: Column) -> Column:
    return _special(strip(line))


def heading(line: Column, version: int = 2) -> Column:
    return F.coalesce(markdown_heading(line, version), let(strip(line), lambda text: F.coalesce(_roman(text), _special(text))))


def paragraphs(body: Column) -> Column:
    """Texts between blank lines."""
    return F.filter(F.transform(F.split(strip(body), P.PARAGRAPH_BREAK), strip), lambda p: p != "")


def parse_sections(md: Column, version: int = 2) -> Column:
    """Array of (title, paragraphs); text before the first heading is ``Preamble``, dropped if it has no text."""

    def cut(all_lines: Column) -> Column:
        marks = F.filter(F.transform(all_lines, lambda x, i: F.struct(i.alias("i"), heading(x, version).alias("title"))), lambda m: m["title"].isNotNull())

        def build(starts: Column) -> Column:
            def section(m: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1)["i"], F.size(all_lines))
                body = F.array_join(F.slice(all_lines, m["i"] + 2, F.greatest(end - m["i"] - 1, F.lit(0))), "\n")
                return F.struct(m["title"].alias("title"), paragraphs(body).alias("paragraphs"))

            return F.transform(starts, section)

        return let(F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("Preamble").alias("title"))), marks), build)

    def drop(found: Column) -> Column:
        first = F.get(found, 0)
        return F.when((first["title"] == "Preamble") & (F.size(first["paragraphs"]) == 0), F.slice(found, 2, 1_000_000_000)).otherwise(found)

    return let(let(lines(md), cut), drop)


def kept_sections(found: Column, version: int = 2) -> Column:
    return found if version == 1 else F.filter(found, lambda s: ~F.lower(strip(s["title"])).isin(P.EXCLUDED_SECTIONS))


def cited(section: Column) -> Column:
    """Citations in a section's paragraphs."""
    return F.aggregate(section["paragraphs"], F.lit(0), lambda a, p: a + F.size(citations(p)))


def output_sections(found: Column, version: int = 2) -> Column:
    """Sections as delivered: (section_id, title, summary, has_citation, citation_count), numbered from 1.

    Version 2 leaves out the reference list before numbering.
    """
    found = kept_sections(found, version)

    def out(s: Column, i: Column) -> Column:
        return let(cited(s), lambda n: F.struct((i + 1).cast("string").alias("section_id"), s["title"].alias("title"), F.array_join(s["paragraphs"], "\n\n").alias("summary"), (n > 0).alias("has_citation"), n.alias("citation_count")))

    return F.transform(found, out)


def empty_sections(found: Column) -> Column:
    """Titles of sections without text."""
    return F.transform(F.filter(found, lambda s: F.size(s["paragraphs"]) == 0), lambda s: s["title"])


def reference_block(md: Column) -> Column:
    """What follows the first mention of references or bibliography, trimmed; empty without one."""
    return strip(F.regexp_extract(md, rf"(?i){P.REFERENCE_BLOCK}\z", 1))


def _until_stop(entries: Column, key) -> Column:
    """Entries before the first whose key begins a later part of the paper."""
    stops = F.transform(entries, lambda e: key(e).rlike(f"(?i){P.REFERENCE_STOP}"))
    return let(F.array_position(stops, True), lambda at: F.when(at > 0, F.slice(entries, F.lit(1), (at - 1).cast("int"))).otherwise(entries))


def _numbered(entries: Column) -> Column:
    return F.transform(entries, lambda e, i: F.struct((i + 1).cast("string").alias("ref_id"), e.alias("raw")))


def references(md: Column, version: int = 2) -> Column:
    """Array of (ref_id, raw). Version 1: a line is an entry; version 2: an entry runs from its marker to the next."""
    found = F.filter(lines(reference_block(md)), not_blank)
    if version == 1:
        return _numbered(let(F.transform(found, strip), lambda x: _until_stop(x, lambda e: e)))
    pairs = F.transform(found, lambda x: F.struct(strip(F.regexp_replace(x, P.BULLET, "")).alias("text"), x.rlike(P.REFERENCE_START).alias("starts")))

    def join(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda r, i: F.when(r["starts"], i)), lambda i: i.isNotNull())

        def build(at: Column) -> Column:
            return F.transform(at, lambda i, k: F.array_join(F.transform(F.slice(rows, i + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - i), lambda r: r["text"]), " "))

        return let(starts, build)

    return _numbered(let(let(pairs, lambda x: _until_stop(x, lambda e: e["text"])), join))
