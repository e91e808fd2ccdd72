"""The search for reused text from end to end: a paper's candidates in the corpus, the passages they share, and a report."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators import overlap, spans
from papyrine.operators.joins import stored
from papyrine.operators.topk import top_k


@dataclass(frozen=True)
class Settings:
    """What counts: words of a passage at least, candidates of a paper at most, and the similarities that link texts and vectors."""

    words: int = 5
    candidates: int = 50
    near: float = 0.8
    cosine: float = 0.8
    semantic: float = 0.85

    @classmethod
    def load(cls, path: str | None = None, **given) -> Settings:
        """From a JSON file, the variables PAPYRINE_<NAME>, and what is given, each over the ones before."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        if path:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        found |= {n: os.environ[v] for n in kinds if (v := f"PAPYRINE_{n.upper()}") in os.environ}
        found |= {n: v for n, v in given.items() if v is not None}
        if unknown := set(found) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{n: kinds[n](v) for n, v in found.items()})


def detect(papers: DataFrame, corpus: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_candidates, n_spans, covered, report, html) of each of ``papers`` (doc_id, text) that shares a passage with another document of ``corpus``.

    Its candidates are the documents with the most words in shared passages; spans are named by the candidate they are in.
    Ids must be unique on both sides; a paper isn't its own candidate.
    """
    found = stored(overlap.passages(corpus, papers.select(F.col("doc_id").alias("item_id"), "text"), settings.words).where("NOT doc_id <=> item_id"), "shared")
    scores = found.groupBy("item_id", "doc_id").agg(F.sum(F.col("doc_end") - F.col("doc_start")).alias("score"))
    kept = top_k(scores, ["item_id"], "score", ["doc_id"], settings.candidates).select("item_id", "doc_id")
    named = found.join(kept, ["item_id", "doc_id"]).select(F.col("item_id").alias("doc_id"), F.col("item_start").alias("doc_start"), F.col("item_end").alias("doc_end"), F.col("doc_id").alias("label"))
    marked = overlap.characters(named, papers).select("doc_id", "label", "start", "end")
    many = kept.groupBy(F.col("item_id").alias("doc_id")).agg(F.count("*").alias("n_candidates"))
    return spans.report(papers, marked).join(many, "doc_id").select("doc_id", "n_candidates", "n_spans", "covered", "report", "html")


def write_reports(reports: DataFrame, folder: str) -> DataFrame:
    """Each report as <doc_id>.json and <doc_id>.html in a shared folder: (file, status, message) of each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, report, page in zip(batch["name"], batch["report"], batch["html"]):
                for suffix, text in (("json", report), ("html", f'<!DOCTYPE html><meta charset="utf-8"><pre>{page}</pre>')):
                    target = os.path.join(folder, f"{name}.{suffix}")
                    try:
                        os.makedirs(folder, exist_ok=True)
                        with open(f"{target}.part", "w", encoding="utf-8") as f:
                            f.write(text)
                        os.replace(f"{target}.part", target)
                        out.append((target, "ok", None))
                    except OSError as e:
                        out.append((target, "error", str(e)))
            yield pd.DataFrame(out, columns=["file", "status", "message"])

    name = F.regexp_replace(F.col("doc_id").cast("string"), r"[^\p{L}\p{N}_.-]", "_")
    return reports.select(name.alias("name"), "report", "html").mapInPandas(run, "file string, status string, message string")
