"""Operator 7: quality rules from a threshold table, compiled into one projection of built-in functions.

Counts come from the words and lines of a text inside its own row: no explode, no shuffle, no user function. Windows of
three words are compared by their 64-bit XXH64 (two different windows of one text are taken as equal with a chance below
1e-10 for a text of 20,000 words); they are sorted only in texts that have a repeated one.

Edge cases: a null text counts as empty; a text without words has zero counts, fails the base rule and isn't kept; lines
without a word are never duplicates; null doc_ids, repeated rows and other columns pass through; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import pick

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3
MIN_WORDS, REPEAT_PERCENT = 50, 50

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "it", "for", "on", "was", "as", "this", "are", "by", "from"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "zu", "den", "von", "des", "für", "auf", "im"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "est", "pour", "dans", "sur", "avec", "qui"],
    "es": ["el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "para", "no", "se"],
}

#: (rule, ratio, comparison, threshold): a text that meets any of them isn't kept. The stop-word rule takes texts to be in one
#: of the languages above; for a corpus of others their words have to be added, or the rule left out of the table.
THRESHOLDS = [
    ("short_words", "mean_word_chars", "<", 2.0),
    ("long_words", "mean_word_chars", ">", 20.0),
    ("symbols", "symbol_ratio", ">", 0.2),
    ("stop_words", "stop_ratio", "<", 0.01),
    ("duplicate_lines", "dup_line_ratio", ">", 0.5),
    ("fragment_lines", "words_per_line", "<", 2.0),
    ("exclamations", "exclamation_ratio", ">", 0.3),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column) -> Column:
    """Words that lie in a window found at least twice."""

    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        gaps = F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.least(F.lit(WINDOW), F.get(at, k + 1) - F.get(at, k)))
        return F.when(F.size(at) > 1, F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0) + F.lit(WINDOW)

    def starts(s: Column) -> Column:
        h = lambda j: F.get(s, j)["h"]
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(h(j) == h(j - 1), F.lit(False)) | F.coalesce(h(j) == h(j + 1), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda j: F.get(s, j)["i"]))

    def search(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, starts), covered)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) >= WINDOW, let(windows, search)).otherwise(0)


def _counts(text: Column) -> Column:
    """A struct of everything that the rules divide."""

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeats(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.struct(
        let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )


def quality(df: DataFrame, text: str = "text", thresholds: list[tuple[str, str, str, float]] = THRESHOLDS) -> DataFrame:
    """``df`` with the counts, base_failed, failed_rules (names of the table's rules that a text meets) and kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_exclamations", "base_failed", "failed_rules", "kept"]
    keep = [c for c in df.columns if c not in made or c == text]
    df = pick(df, *keep)
    q = lambda name: F.col(f"`{name}`")
    # one expression for everything: a filter on ``kept`` that the optimizer moves down computes it once
    found = let(let(F.coalesce(q(text), F.lit("")), _counts), lambda x: _verdict(x, thresholds))
    judged = df.withColumn("__found", found)
    return judged.select(*(q(c) for c in keep if c not in made), *(F.col("__found")[m].alias(m) for m in made))


def _verdict(x: Column, thresholds: list[tuple[str, str, str, float]]) -> Column:
    """A struct of the counts and what the rules make of them."""
    n_words, n_lines, n_dup = x["w"]["n_words"], x["l"]["n"].cast("long"), x["l"]["dup"].cast("long")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    ratios = {
        "n_words": n_words, "mean_word_chars": per(x["w"]["word_chars"], n_words), "symbol_ratio": per(x["n_symbols"], n_words), "stop_ratio": per(x["w"]["n_stop_words"], n_words),
        "dup_line_ratio": per(n_dup, n_lines), "words_per_line": per(n_words, n_lines), "exclamation_ratio": per(x["n_exclamations"], n_words),
    }
    compare = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    failed = F.array_compact(F.array(*(F.when(compare[op](ratios[name], F.lit(limit)), F.lit(rule)) for rule, name, op, limit in thresholds)))
    base = (n_words < MIN_WORDS) | (100 * x["w"]["n_repeat_words"] > REPEAT_PERCENT * n_words)
    return F.struct(
        n_words.alias("n_words"), x["w"]["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), n_dup.alias("n_dup_lines"),
        x["w"]["n_repeat_words"].alias("n_repeat_words"), x["w"]["n_stop_words"].alias("n_stop_words"), n_lines.alias("n_lines"), x["n_exclamations"].alias("n_exclamations"),
        base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"),
    )


def _oracle() -> str:
    """The same counts and verdict for DuckDB, over documents."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    rules = " OR ".join(f"{ratio} {op} {limit}" for _, ratio, op, limit in THRESHOLDS)
    space, word, symbol = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", SYMBOL
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
g AS (SELECT r, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram,
             unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM f WHERE n > 1) GROUP BY r),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '{symbol}', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop,
             len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_exclamations FROM w LEFT JOIN c USING (r)),
s AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
             coalesce(n_stop / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_words / nullif(n_lines, 0), 0) AS words_per_line, coalesce(n_exclamations / nullif(n_words, 0), 0) AS exclamation_ratio,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({rules}) AS kept FROM s
"""


ORACLE_SQL = _oracle()
