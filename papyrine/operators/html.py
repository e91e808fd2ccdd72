"""Look-ups in HTML pages by tag, class, id, attribute and link, as expressions over the page's text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import squeeze, strip, unescape

#: Parts that hold no elements: removed before tags are looked for.
OPAQUE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
LINK = rf"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*{_VALUE}[^>]*>(.*?)</a>"


def elements_only(html: Column) -> Column:
    return F.regexp_replace(html, OPAQUE, "")


def _start(tag: str, attribute: str | None, value: str | None) -> str:
    """Pattern of a start tag, with an attribute of this value if given; a class is one among others."""
    if not attribute:
        return rf"<{tag}(?:\s[^>]*)?>"
    word = re.escape(value)
    more = (lambda q: rf"(?:[^{q}]*\s)?{word}(?:\s[^{q}]*)?") if attribute == "class" else (lambda q: word)
    quoted = "|".join(f"{q}{more(q)}{q}" for q in "\"'")
    return rf"<{tag}\s(?:[^>]*?\s)?{attribute}\s*=\s*(?:{quoted}|{word})(?:\s[^>]*)?/?>"


def find_all(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    """Inner HTML of all ``tag`` elements (that don't hold their own kind), with an attribute of this value if given."""
    return F.regexp_extract_all(elements_only(html), F.lit(f"(?is){_start(tag, attribute, value)}(.*?)</{tag}>"), F.lit(1))


def find_first(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    return F.get(find_all(html, tag, attribute, value), 0)


def sections(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    """What follows each start tag of ``tag``, with an attribute of this value if given, up to the next such tag: elements that hold their own kind, one after another."""
    parts = F.split(elements_only(html), f"(?is){_start(tag, attribute, value)}")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def section(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    """The first of ``sections``; null if there is none."""
    return F.get(sections(html, tag, attribute, value), 0)


def text_of(fragment: Column) -> Column:
    """Text without tags, entities decoded."""
    return unescape(F.regexp_replace(fragment, "<[^>]*>", ""))


def stripped_text(fragment: Column) -> Column:
    return strip(text_of(fragment))


def joined_text(fragment: Column) -> Column:
    """The texts between tags, each without white space at its ends, joined by nothing."""
    return F.array_join(F.transform(F.split(fragment, "<[^>]*>"), lambda x: strip(unescape(x))), "")


def links(html: Column) -> Column:
    """Array of (href, anchor) in page order."""

    def one(match: Column) -> Column:
        href = F.concat(*(F.regexp_extract(match, LINK, i) for i in (1, 2, 3)))
        return F.struct(unescape(href).alias("href"), squeeze(text_of(F.regexp_extract(match, LINK, 4))).alias("anchor"))

    return F.transform(F.regexp_extract_all(elements_only(html), F.lit(LINK), F.lit(0)), one)


def explode_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, anchor), one row for each link."""
    return pages.select("page_id", "url", F.posexplode(links(F.col("html"))).alias("pos", "link")).select("page_id", "url", "pos", "link.href", "link.anchor")


def first_link(html: Column, pattern: str) -> Column:
    """First href that the pattern finds."""
    return F.get(F.filter(F.transform(links(html), lambda x: x["href"]), lambda h: h.rlike(pattern)), 0)


def zip_elements(html: Column, first: str, second: str) -> Column:
    """Pairs of the i-th elements of two tags; the longer list's rest is dropped."""

    a, b = find_all(html, first), find_all(html, second)
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("first"), F.slice(b, F.lit(1), n).alias("second"))


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"), step)
    folder = F.element_at(segments, -1).isin(".", "..")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``: absolute, scheme-relative, root-relative, fragment, query or relative to its folder."""
    scheme, site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(base, r"^([^?#]*?//[^/?#]*)", 1)
    plain, folder = F.regexp_extract(base, r"^([^?#]*)", 1), F.regexp_extract(base, r"^[^?#]*?//[^/?#]*((?:[^?#]*/)?)", 1)
    path, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    merged = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path), "/{2,}", "/")  # empty segments of a relative path go
    return (F.when(href == "", base).when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(site, without_dots(path), tail)).when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
            .when(href.startswith("?"), F.concat(plain, href)).otherwise(F.concat(site, without_dots(merged), tail)))


def url_year(url: Column) -> Column:
    """First year of the 20th or 21st century in a URL, or ``Unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(url, "((?:19|20)[0-9]{2})", 1), F.lit("")), F.lit("Unknown"))


def event_year(url: Column) -> Column:
    """What follows the last hyphen, without slashes."""
    return F.replace(F.element_at(F.split(url, "-"), -1), F.lit("/"), F.lit(""))


def venue_kind(url: Column) -> Column:
    return F.when(F.lower(url).contains("workshop"), F.lit("workshop")).otherwise(F.lit("main conference"))


def squeeze_title(title: Column) -> Column:
    return squeeze(F.replace(title, F.lit("Title:"), F.lit("")))
