"""Spans of text: the detection measures of found spans against true ones, and reports that highlight spans.

Spans are (key..., start, end) with positions from 0 and exclusive ends; empty and reversed ones, and those with a null
position, are left out. Equal spans count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.joins import stored

#: Positions of a bin: spans meet in the bins they touch.
BIN = 512


def _numbered(spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    good = spans.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("start < end")
    return stored(good.withColumn("id", F.monotonically_increasing_id()), name)


def overlaps(found: DataFrame, truth: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """(found_id, true_id, start, end) of the common part of each overlapping pair of the same keys; inputs with an ``id``.

    A span is in every bin it touches; a pair is met in the first bin that both are in, once.
    """
    def binned(spans: DataFrame, prefix: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return spans.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "start", "end")), F.explode(bins).alias("bin"))

    a, b = binned(found, "found"), binned(truth, "true")
    on = F.lit(True)
    for c in [*keys, "bin"]:
        on &= a[c].eqNullSafe(b[c])
    start, end = F.greatest("found_start", "true_start"), F.least("found_end", "true_end")
    return a.join(b, on).where((start < end) & (F.floor(start / width) == a["bin"])).select("found_id", "true_id", start.alias("start"), end.alias("end"))


def covered(parts: DataFrame, by: str) -> DataFrame:
    """(by, covered, n): how many positions the parts of each ``by`` cover together, and how many parts there are."""
    earlier = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(earlier), F.col("start"))
    new = F.greatest(F.col("end") - F.greatest("start", reach), F.lit(0))
    return parts.select(by, new.alias("new")).groupBy(by).agg(F.sum("new").alias("covered"), F.count("*").alias("n"))


def evaluate(found: DataFrame, truth: DataFrame, keys: list[str], by: list[str] | None = None, width: int = BIN) -> DataFrame:
    """Detection measures (Potthast et al., COLING 2010) for each value of ``by``, some of ``keys``: n_true, n_found, precision, recall, granularity and plagdet.

    Precision is the mean share of a found span that true ones cover, recall the mean share of a true span that found ones
    cover, granularity the mean number of found spans of a true span that has any; plagdet is their harmonic mean over
    log2(1 + granularity). Without spans precision and recall are 0, without a hit granularity is 1.
    """
    if not by:
        whole = evaluate(*(x.withColumn("__all", F.lit(1)) for x in (found, truth)), [*keys, "__all"], ["__all"], width)
        return whole.drop("__all")
    found, truth = _numbered(found, keys, "found"), _numbered(truth, keys, "truth")
    parts = stored(overlaps(found, truth, keys, width), "overlaps")

    def side(spans: DataFrame, own: str) -> DataFrame:
        met = covered(parts.withColumnRenamed(own, "id"), "id")
        share = F.coalesce(F.col("covered"), F.lit(0)) / (F.col("end") - F.col("start"))
        return spans.join(met, "id", "left").groupBy(*by).agg(F.count("*").alias("many"), F.avg(share).alias("share"), F.avg("n").alias("hits"))

    p = side(found, "found_id").select(*by, F.col("many").alias("n_found"), F.col("share").alias("precision"))
    r = side(truth, "true_id").select(*by, F.col("many").alias("n_true"), F.col("share").alias("recall"), F.col("hits").alias("granularity"))
    on = F.lit(True)
    for c in by:
        on &= p[c].eqNullSafe(r[c])
    both = p.join(r, on, "full").select(*(F.coalesce(p[c], r[c]).alias(c) for c in by), "n_found", "n_true", "precision", "recall", "granularity")
    both = both.select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_found")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall")), F.coalesce("granularity", F.lit(1.0)).alias("granularity"))
    mean = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("plagdet", mean / F.log2(1 + F.col("granularity")))


def escaped(text: Column) -> Column:
    """Text as it stands in HTML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def merged(spans: Column) -> Column:
    """An array of (start, end, ...) as the least array of disjoint (start, end) that covers the same, in order."""
    pairs = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.slice(pairs, 1, 0)

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(pairs, none, add)


def highlighted(text: Column, spans: Column, label: str = "label") -> Column:
    """HTML of ``text``: it is cut at every start and end, and each part within spans is one mark that names them all, so marks never cross."""
    edges = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.char_length(text).cast("long")), edges)))

    def part(i: Column) -> Column:
        a, b = F.get(cuts, i), F.get(cuts, i + 1)
        body = escaped(F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
        over = F.filter(spans, lambda s: (s["start"] <= a) & (s["end"] >= b))
        names = F.array_join(F.array_sort(F.array_distinct(F.transform(over, lambda s: escaped(s[label].cast("string"))))), " ")
        return F.when(F.size(over) > 0, F.concat(F.lit('<mark data-of="'), names, F.lit('">'), body, F.lit("</mark>"))).otherwise(body)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), part), "")


def report(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_spans, covered, report, html) of each document with spans (doc_id, label, start, end): JSON and highlighted text.

    Spans reach at most to the text's end; a null text has no report. A repeated doc_id has a report for each of its texts.
    """
    each = spans.where("start < end AND start >= 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label"))).alias("spans"))
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(each, "doc_id")
    n = F.char_length("text").cast("long")
    inside = F.transform(F.filter("spans", lambda s: s["start"] < n), lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], n).alias("end"), s["label"].alias("label")))
    rows = rows.withColumn("spans", inside).withColumn("parts", merged(F.col("spans")))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    body = F.to_json(F.struct("doc_id", F.size("spans").alias("n_spans"), total.alias("covered"), n.alias("length"), "parts", "spans"))
    return rows.select("doc_id", F.size("spans").cast("long").alias("n_spans"), total.alias("covered"), body.alias("report"), highlighted(F.col("text"), F.col("spans")).alias("html"))
