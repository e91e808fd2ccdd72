"""Command line: PDFs to processed JSON files.

``python -m papyrine paper.pdf [out]`` for a file, ``python -m papyrine --batch folder [out]`` for a folder; without
arguments ``./pdf`` goes to ``./json_output``.

``python -m papyrine index build --input <json folder> --out <index>`` indexes processed documents for the search for near
copies; run again, it adds what is new.

``python -m papyrine detect --input <json folder> --corpus <json folder> --out <folder>`` reports the passages that processed
papers share with a corpus, as JSON and HTML. Thresholds come from PAPYRINE_<NAME> variables (``plans.detect.Settings``).
"""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import text as T
from papyrine.plans.document import observed, process_documents
from papyrine.sources import papers
from papyrine.sources.sinks import export_documents

logger = logging.getLogger("papyrine")
USAGE = "Usage:\n  python -m papyrine <pdf> [out]\n  python -m papyrine --batch <folder> [out]\n  python -m papyrine index build --input <json folder> --out <index>\n  python -m papyrine detect --input <json folder> --corpus <json folder> --out <folder>\n  python -m papyrine    (./pdf to ./json_output)"


def run(spark: SparkSession, files: DataFrame, out: str, make: Callable = papers.docling_converter, options: papers.ConvertOptions | None = None, version: int = 2) -> list[tuple[str, str, str | None]]:
    """Convert, process and export the PDFs of ``files``: (file or path, status, message) of each, one row a PDF."""
    # each PDF is converted once; what comes out is needed for the files and for the report
    converted = papers.pdf_to_markdown(files.repartition("path"), make, options or papers.ConvertOptions.from_environment()).cache()
    good = converted.where("status = 'ok'").withColumn("name", T.stem(F.col("path")))
    documents = process_documents(good, doc_id=T.document_id(F.col("path")), version=version, extra=True, source="path", pages="pages")
    counted, seen = observed(documents.withColumn("name", T.stem(F.col("source"))))
    written = export_documents(counted, out).collect()
    failed = converted.where("status <> 'ok'").select("path", "status", "message").collect()
    converted.unpersist()
    report = [tuple(r) for r in written + failed]
    for name, status, message in report:
        logger.log(logging.INFO if status == "ok" else logging.WARNING, "%s: %s %s", name, status, message or "")
    if written:
        logger.info("counts: %s", seen.get)
    return report


def build_index(spark: SparkSession, source: str, out: str) -> int:
    """Add the new processed documents of ``source`` to the index in ``out``: how many documents it has."""
    from papyrine.streaming.index import Index, index_stream, processed_changes

    index = Index(spark, out)
    index_stream(processed_changes(spark, source), index, f"{out.rstrip('/')}/checkpoint").awaitTermination()
    return index.read().count()


def report_reuse(spark: SparkSession, source: str, corpus: str, out: str) -> list[tuple[str, str, str | None]]:
    """Reports on the processed documents of ``source`` against those of ``corpus``: (file, status, message) of each."""
    from papyrine.plans.detect import Settings, detect, write_reports
    from papyrine.streaming.index import processed_text

    mine, known = (spark.read.schema(papers.PROCESSED).option("multiLine", True).json(x).select("doc_id", processed_text().alias("text")) for x in (source, corpus))
    return [tuple(r) for r in write_reports(detect(mine, known, Settings.load()), os.path.abspath(out)).collect()]


def main(args: list[str], make: Callable = papers.docling_converter) -> int:
    if args[:2] == ["index", "build"] and args[2::2] == ["--input", "--out"] and len(args) == 6:
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
        logger.info("%d documents indexed", build_index(SparkSession.builder.appName("papyrine").getOrCreate(), args[3], args[5]))
        return 0
    if args[:1] == ["detect"] and args[1::2] == ["--input", "--corpus", "--out"] and len(args) == 7:
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
        for file, status, message in report_reuse(SparkSession.builder.appName("papyrine").getOrCreate(), args[2], args[4], args[6]):
            logger.log(logging.INFO if status == "ok" else logging.WARNING, "%s: %s %s", file, status, message or "")
        return 0
    batch = args[:1] == ["--batch"]
    if args[:1] in (["index"], ["detect"]) or batch and len(args) < 2 or not args and not os.path.isdir("./pdf"):
        print(USAGE)
        return 1
    source, out = (args[1:] if batch else args)[0] if args else "./pdf", ((args[2:] if batch else args[1:]) or ["./json_output"])[0]
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("papyrine").getOrCreate()
    files = papers.pdf_files(spark, source) if batch or not args else spark.read.format("binaryFile").load(source).select("path", "length", "content")
    report = run(spark, files, os.path.abspath(out), make)
    good = sum(status == "ok" for _, status, _ in report)
    logger.info("%d of %d files processed", good, len(report))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
