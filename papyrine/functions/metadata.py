"""Title, affiliation, date, abstract of a Markdown document, as expressions over one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions.text import strip


def is_watermark(title: Column) -> Column:
    return title.rlike(f"(?i){P.WATERMARK}")


def paper_title(md: Column) -> Column:
    """First first- or second-level heading that is no watermark, generic name or too short; else the first long plain line."""
    region = F.left(md, F.lit(P.TITLE_REGION))
    titles = F.transform(F.regexp_extract_all(region, F.lit(f"(?dm){P.TITLE}"), F.lit(1)), lambda t: strip(F.rtrim(strip(t), F.lit("#"))))
    good = F.filter(titles, lambda t: ~is_watermark(t) & ~F.lower(t).isin(P.SKIP_TITLES) & (F.char_length(t) >= P.TITLE_LEAST))
    plain = F.transform(F.split(region, P.LINE_ENDS), lambda x: strip(F.ltrim(strip(x), F.lit("#"))))
    long = F.filter(plain, lambda x: (F.char_length(x) > P.FALLBACK_LEAST) & ~is_watermark(x) & ~x.rlike(P.TITLE_REJECT))
    return F.left(F.coalesce(F.get(good, 0), F.get(long, 0), F.lit("Untitled")), F.lit(P.TITLE_CUT))


def organization(md: Column) -> Column:
    # a match starts where a line does, so only there it is tried: elsewhere each character of a line without one would cost the rest of the line
    return F.left(strip(F.regexp_extract(F.left(md, F.lit(P.ORGANIZATION_REGION)), f"(?idm)^{P.ORGANIZATION}", 1)), F.lit(P.ORGANIZATION_CUT))


def _day(year: Column, month: Column, day: Column, ok: Column) -> Column:
    valid = ok & month.between(1, 12) & day.between(1, 31)
    return F.when(valid, F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def publish_date(md: Column) -> Column:
    """``yyyy-MM-dd`` of the first form that holds: labelled, ISO, month and year, conference and year; else empty."""
    head = F.left(md, F.lit(P.DATE_REGION))
    part = lambda text, pattern, i: F.regexp_extract(text, f"(?i){pattern}", i).try_cast("int")
    a, b, year = (part(head, P.DATE_LABELLED, i) for i in (1, 2, 3))
    within = (year > 1900) & (year < 2100)
    labelled = F.when(a > 12, _day(year, b, a, within)).when(b > 12, _day(year, a, b, within))
    iso = _day(part(head, P.DATE_ISO, 1), part(head, P.DATE_ISO, 2), part(head, P.DATE_ISO, 3), F.lit(True))
    word_year = part(head, P.DATE_WORDS, 2)
    month = F.array_position(F.array(*map(F.lit, P.MONTHS)), F.lower(F.regexp_extract(head, f"(?i){P.DATE_WORDS}", 1)))
    words = _day(word_year, month, F.lit(1), (word_year > 1900) & (word_year < 2100))
    far, name = F.left(md, F.lit(P.CONFERENCE_REGION)), rf"(?<!{P.W}){P.CONFERENCE}(?!{P.W})"
    conference_year = part(far, name, 2)
    months = F.create_map(*(F.lit(x) for kv in P.CONFERENCE_MONTHS.items() for x in kv))
    meeting = _day(conference_year, F.coalesce(F.try_element_at(months, F.lower(F.regexp_extract(far, f"(?i){name}", 1))), F.lit(1)), F.lit(1), (conference_year > 1990) & (conference_year < 2100))
    return F.coalesce(labelled, iso, words, meeting, F.lit(""))


def abstract(md: Column, version: int = 2) -> Column:
    region, cut = P.ABSTRACT_SIZES[version]
    found = F.regexp_extract(F.left(md, F.lit(region)), rf"(?i){P.ABSTRACT_HEAD}((?s:.+?))(?={P.ABSTRACT_END})", 1)
    return F.left(strip(found), F.lit(cut))


def citations(text: Column) -> Column:
    """All citations, left to right; a bracketed group counts once."""
    return F.regexp_extract_all(text, F.lit(P.CITATION), F.lit(0))
