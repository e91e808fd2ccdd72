"""Readers: PDF folders, page tables, JSON state, HTTP listings."""

from __future__ import annotations

import os
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

PAPERS = StructType([StructField(c, StringType()) for c in ("paper_name", "year", "conference_name", "workshop_or_main_conference", "paper_path")])
SECTION = StructType([StructField("section_id", StringType()), StructField("title", StringType()), StructField("summary", StringType()), StructField("has_citation", BooleanType()), StructField("citation_count", IntegerType())])
REFERENCE = StructType([StructField("ref_id", StringType()), StructField("raw", StringType())])
PROCESSED = StructType([StructField("doc_id", StringType()), StructField("title", StringType()), StructField("abstract", StringType()), StructField("sections", ArrayType(SECTION)), StructField("references", ArrayType(REFERENCE))])


@dataclass(frozen=True)
class ConvertOptions:
    """What a PDF converter is told, and how long it may take for a file."""

    device: str = "cpu"
    ocr: bool = True
    timeout_s: float = 600.0

    @classmethod
    def from_environment(cls, **given) -> ConvertOptions:
        """Device and OCR as the variables DOCLING_DEVICE and DOCLING_OCR say, where they are set."""
        device, ocr = os.environ.get("DOCLING_DEVICE"), os.environ.get("DOCLING_OCR")
        found = ({"device": device} if device else {}) | ({"ocr": ocr.lower() in ("1", "true", "yes", "on")} if ocr else {})
        return cls(**(found | given))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the ``*.pdf`` directly in a folder; order by path where order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length", "content")


def docling_converter(options: ConvertOptions) -> Callable[[bytes], tuple[str, int]]:
    """A converter by Docling, imported where it runs."""
    from io import BytesIO

    from docling.datamodel.base_models import DocumentStream, InputFormat
    from docling.datamodel.pipeline_options import AcceleratorOptions, PdfPipelineOptions
    from docling.document_converter import DocumentConverter, PdfFormatOption

    pipeline = PdfPipelineOptions(do_ocr=options.ocr, accelerator_options=AcceleratorOptions(device=options.device))
    converter = DocumentConverter(format_options={InputFormat.PDF: PdfFormatOption(pipeline_options=pipeline)})

    def run(content: bytes) -> tuple[str, int]:
        document = converter.convert(DocumentStream(name="paper.pdf", stream=BytesIO(content))).document
        return document.export_to_markdown(), len(document.pages)

    return run


def _bounded(call: Callable[[bytes], str], content: bytes, seconds: float) -> str:
    """``call`` in a process of its own, ended when its time is up."""
    import multiprocessing as mp

    context = mp.get_context("fork")
    ours, theirs = context.Pipe(False)

    def work() -> None:
        try:
            theirs.send((True, call(content)))
        except Exception as e:  # noqa: BLE001  it becomes the row's error
            theirs.send((False, f"{type(e).__name__}: {e}"))

    process = context.Process(target=work)
    process.start()
    try:
        if not ours.poll(seconds):
            raise TimeoutError
        good, value = ours.recv()
    finally:
        process.kill()
        process.join()
    if not good:
        raise RuntimeError(value)
    return value


def pdf_to_markdown(files: DataFrame, make: Callable[[ConvertOptions], Callable[[bytes], str]] = docling_converter, options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """(path, markdown, pages, status, message): the converter is built once a task; a failure or timeout is a row, not an
    abort. A converter may give the text alone or with the number of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = make(options)
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    value = _bounded(convert, content, options.timeout_s)
                    rows.append((path, *(value if isinstance(value, tuple) else (value, None)), "ok", None))
                except TimeoutError:
                    rows.append((path, None, None, "timeout", f"over {options.timeout_s} s"))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, "error", str(e)))
            out = pd.DataFrame(rows, columns=["path", "markdown", "pages", "status", "message"])
            yield out.assign(pages=out["pages"].astype("Int32"))

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, pages int, status string, message string")


def _pages_of(content: bytes):
    """The open PDF; PyMuPDF is imported where it runs."""
    import fitz

    return fitz.open(stream=content, filetype="pdf")


def _isolated(files: DataFrame, schema: str, rows_of: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """``rows_of`` each file under ``schema`` (path first), with status and message; a file that fails is one row without more."""
    whole = f"{schema}, status string, message string"
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(*row, "ok", None) for row in rows_of(path, content)]
                except Exception as e:  # noqa: BLE001  it becomes the row's message
                    rows = [(path, *[None] * (len(names) - 1), "error", f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=[*names, "status", "message"])
                yield out.astype({c: "Int32" for c in ("page", "block_idx", "image") if c in out})

    return files.select("path", "content").mapInPandas(run, whole)


def pdf_blocks(files: DataFrame, open_pdf: Callable[[bytes], object] = _pages_of) -> DataFrame:
    """Text blocks of each page; blank blocks are left out, a file that can't be read is a row with its error."""

    def rows_of(path: str, content: bytes) -> list[tuple]:
        with open_pdf(content) as pdf:
            return [(path, p, i, b[4], *map(float, b[:4])) for p, page in enumerate(pdf) for i, b in enumerate(page.get_text("blocks")) if b[4].strip()]

    return _isolated(files, "path string, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double", rows_of)


def paddle_recogniser(language: str = "en", make: Callable[..., object] | None = None) -> Callable[[bytes], list[tuple[str, float]]]:
    """A recogniser of text in an image by PaddleOCR, which is imported where it runs: (text, confidence) of each line.

    Both shapes of its answers are read: a list of lines for each page (older releases), and one mapping for each page.
    """
    if make is None:
        from paddleocr import PaddleOCR as make  # noqa: N813
    engine = make(use_angle_cls=True, lang=language)

    def run(image: bytes) -> list[tuple[str, float]]:
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".png") as file:  # this task's own, gone with it
            file.write(image)
            file.flush()
            pages = engine.ocr(file.name) or []
        found = []
        for page in pages:
            if isinstance(page, dict):
                found += zip(page["rec_texts"], map(float, page["rec_scores"]))
            else:
                found += [(text, float(score)) for _, (text, score) in page or []]
        return found

    return run


def pdf_images(files: DataFrame, recognise: Callable[[], Callable[[bytes], list[tuple[str, float]]]] | None = None, open_pdf: Callable[[bytes], object] = _pages_of) -> DataFrame:
    """Embedded images keyed by (path, page, image), with recognised text and confidence if a maker of a recogniser is given,
    like ``paddle_recogniser``; a file that can't be read is a row with its error."""
    made: list = []

    def rows_of(path: str, content: bytes) -> list[tuple]:
        if not made:  # once a worker
            made.append(recognise() if recognise else lambda image: [])
        rows = []
        with open_pdf(content) as pdf:
            for p, page in enumerate(pdf):
                for i, image in enumerate(page.get_images(full=True)):
                    data = pdf.extract_image(image[0])["image"]
                    rows.append((path, p, i, data, [{"text": t, "confidence": c} for t, c in made[0](data) or []]))
        return rows

    return _isolated(files, "path string, page int, image int, content binary, ocr_text array<struct<text string, confidence double>>", rows_of)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """Paper metadata written so far; none if there is no file yet. Both keys for the venue kind are read."""
    schema = StructType([*PAPERS, StructField("workshop_or_main", StringType())])
    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], PAPERS)
    return rows.withColumn("workshop_or_main_conference", F.coalesce("workshop_or_main_conference", "workshop_or_main")).select(*PAPERS.names)


class Listing(DataSource):
    """``spark.read.format("listing")``: one row for each offset of a paged listing, or for each given URL.

    Options: ``url`` (with ``{skip}`` for paged listings), ``pages``, ``size``, ``urls`` (comma-joined), ``retries``,
    ``timeout``, ``delay`` (seconds, or a range like ``1.5-3.5`` from which each is drawn), ``pause`` (seconds after a
    failure), ``agent``. A page that can't be had is a row with its status and no body. A listing with ``{skip}`` and
    without ``pages`` is read until a page lacks ``until``, a pattern that every page with entries has (ENTRIES, unless
    given): ``readers`` tasks take turns of pages.

    ``rate`` is a number of requests a second for each host, however many tasks there are: requests are numbered by host,
    and each waits for its number's time (``Schedule``).

    ``spark.readStream.format("listing")`` reads a paged listing as it grows. Its offset is the number of pages read; how
    many there are now is found by doubling and halving, and ``readers`` tasks read the new ones. A restart goes on at the
    stored offset, so no page is given twice or left out.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ListingStream(dict(self.options))


#: What a listing's page with entries has.
ENTRIES = r"<(?:entry|li|article)\b"


#: Seconds until the first request of a schedule is due: tasks that begin later than that make up for it at once.
LEAD = 3.0


class Schedule:
    """Times of requests: the n-th of a host is due n / rate seconds after the start, whichever task makes it."""

    def __init__(self, rate: float | None, start: float | None = None):
        self.rate, self.start, self.seen = rate, time.time() + LEAD if start is None else start, {}

    def next(self, url: str) -> float:
        """The time of the next request of the url's host."""
        host = re.sub(r"^[a-z]+://([^/?#]*).*$", r"\1", url, flags=re.S)
        n = self.seen[host] = self.seen.get(host, -1) + 1
        return self.at(n)

    def at(self, n: int) -> float:
        return self.start + n / self.rate if self.rate else 0.0


def wait_until(due: float) -> None:
    time.sleep(max(0.0, due - time.time()))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.rate = options, float(options["rate"]) if options.get("rate") else None
        paged = not options.get("urls") and "{skip}" in options["url"] and not options.get("pages")
        self.until = options.get("until") or (ENTRIES if paged else None)
        self.readers, self.size = int(options.get("readers", 4)), int(options.get("size", 2000))
        self.urls = [] if self.until else options["urls"].split(",") if options.get("urls") else [self.page(k) for k in range(int(options.get("pages", 1)))]

    def page(self, number: int) -> str:
        return self.options["url"].format(skip=number * self.size)

    def partitions(self) -> list[InputPartition]:
        schedule = Schedule(self.rate)
        if self.until:
            return [InputPartition((k, schedule.start)) for k in range(self.readers)]
        return [InputPartition((u, schedule.next(u))) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str | None]]:
        number, when = partition.value
        if not self.until:
            wait_until(when)
            yield self.fetch(number)
            return
        schedule = Schedule(self.rate, when)
        while True:
            wait_until(schedule.at(number))
            row = self.fetch(self.page(number))
            if not self.has_entries(row):
                if row[2] is None and row[1] not in (200, 404):
                    yield row  # a failure isn't the listing's end: it is told
                return
            yield row
            number += self.readers

    def has_entries(self, row: tuple[str, int, str | None]) -> bool:
        return row[2] is not None and re.search(self.until or ENTRIES, row[2]) is not None

    def fetch(self, url: str) -> tuple[str, int, str | None]:
        import urllib.error
        import urllib.request

        o, status, body = self.options, 0, None
        for k in range(int(o.get("retries", 5)) + 1):
            if k:
                time.sleep(min(60.0, float(o.get("backoff", 2)) * 2 ** (k - 1)))
            try:
                request = urllib.request.Request(url, headers={"User-Agent": o.get("agent", "papyrine")})
                with urllib.request.urlopen(request, timeout=float(o.get("timeout", 30))) as answer:
                    status, body = answer.status or 200, answer.read().decode("utf-8", "replace")
                break
            except urllib.error.HTTPError as e:
                status = e.code
                if status not in (429, 500, 502, 503, 504):  # fixed values: answers worth another try
                    break
            except OSError:
                status = 0
        low, _, high = str(o.get("delay", 0)).partition("-")
        time.sleep(random.uniform(float(low), float(high or low)) + (float(o.get("pause", 0)) if body is None else 0))
        return url, status, body


class ListingStream(DataSourceStreamReader, ListingReader):
    """Offsets are numbers of pages; pages once read aren't asked for again."""

    def __init__(self, options: dict[str, str]):
        ListingReader.__init__(self, options)
        self.until, self.known = self.until or ENTRIES, 0
        self.schedule = Schedule(self.rate)

    def initialOffset(self) -> dict:
        return {"pages": int(self.options.get("first", 0))}

    def latestOffset(self) -> dict:
        """How many pages there are, all of those before with entries: doubling steps from the last number on, then halving."""
        low, high, step = max(self.known, self.initialOffset()["pages"]), None, 1
        while high is None or low < high:
            probe = low + step if high is None else (low + high + 1) // 2
            if self._there(probe - 1):
                low, step = probe, step * 2
            else:
                high = probe - 1
        return {"pages": low}

    def _there(self, page: int) -> bool:
        url = self.page(page)
        wait_until(self.schedule.next(url))
        row = self.fetch(url)
        return self.has_entries(row)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = end["pages"]
        pages = range(start["pages"], end["pages"])
        due = [self.schedule.next(self.page(p)) for p in pages]
        if due and self.rate:  # the schedule goes on from now, not from turns that went by without a request
            late = max(0.0, time.time() + LEAD - due[0])
            due = [d + late for d in due]
            self.schedule.start += late
        return [InputPartition(list(zip(pages, due))[k :: self.readers]) for k in range(min(self.readers, len(pages)))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str | None]]:
        for page, when in partition.value:
            wait_until(when)
            yield self.fetch(self.page(page))

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["pages"])
