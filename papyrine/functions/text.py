"""String helpers with code-point and Unicode white-space semantics."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.patterns import WS_CHARS, W, WS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{WS}+", " "))


def clean_text(text: Column) -> Column:
    return squeeze(text)


def not_blank(text: Column) -> Column:
    return text.rlike(rf"[^{WS[1:]}")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def sanitize(name: Column, cut: int = 150, trim: bool = True) -> Column:
    """Letters, digits, blank, ``_`` and ``-`` of a file name, cut after trimming (or, with ``trim`` off, untrimmed)."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "")
    return F.left(strip(kept) if trim else kept, F.lit(cut))


def stem(path: Column) -> Column:
    """Last part of a path without its last suffix; a name that only starts with a dot keeps it."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def document_id(path: Column, day: Column | None = None) -> Column:
    """``paper_<stem>_<yyyyMMdd>``, other characters than ASCII letters and digits as ``_``."""
    day = F.date_format(F.current_date(), "yyyyMMdd") if day is None else day
    return F.concat(F.lit("paper_"), F.regexp_replace(stem(path), "[^a-zA-Z0-9_]", "_"), F.lit("_"), day)


def to_roman(number: Column) -> Column:
    """Upper-case Roman numeral; numbers below one count as one."""
    n = F.greatest(number.cast("int"), F.lit(1))
    digit = lambda place, names: F.element_at(F.array(*map(F.lit, names)), (F.floor(n / place) % 10 + 1).cast("int"))
    tens = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, tens("C", "D", "M")), digit(10, tens("X", "L", "C")), digit(1, tens("I", "V", "X")))


def leading_roman(title: Column) -> Column:
    """Leading run of Roman letters before a word boundary, upper-cased; not checked to be a numeral."""
    return F.upper(F.regexp_extract(strip(title), rf"(?i)^([IVXLCDM]+)(?!{W})", 1))


def unescape(text: Column) -> Column:
    """Character references decoded: named ones of HTML 5 that end with a semicolon, and numbers; others stay."""
    reference = "&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def character(ref: Column) -> Column:
        hexadecimal = ref.rlike("^#[xX]")
        point = F.when(hexadecimal, F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2))).try_cast("long")
        good = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(F.when(good, point).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        named = F.coalesce(F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";")))
        return F.when(ref.startswith("#"), made).otherwise(named)

    decoded = F.transform(F.regexp_extract_all(text, F.lit(reference), F.lit(1)), character)
    pieces = F.zip_with(F.split(text, reference), decoded, lambda plain, made: F.concat(plain, F.coalesce(made, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def sentences(text: Column) -> Column:
    """Sentences by their end marks, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), squeeze), lambda s: s != "")
