"""Writers: tables, one JSON file for each document, downloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """The canonical form: Parquet, appended by batch."""
    df.write.mode(mode).parquet(path)


def save_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def export_documents(df: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """One pretty UTF-8 JSON file ``<name>_processed.json`` for each row, in a folder that all executors share.

    Returns (file, status, message); run an action on it. A file is written beside its place and renamed into it, so a
    task that runs twice leaves one whole file.
    """
    columns = [c for c in df.columns if c != name]
    rows = df.select(F.col(name).alias("name"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for stem, text in zip(batch["name"], batch["json"]):
                path = os.path.join(folder, f"{stem}_processed.json")
                try:
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with open(part, "w", encoding="utf-8") as f:
                        json.dump(json.loads(text), f, ensure_ascii=False, indent=2)
                    os.replace(part, path)
                    out.append((path, "ok", None))
                except OSError as e:
                    out.append((path, "error", str(e)))
            yield pd.DataFrame(out, columns=["file", "status", "message"])

    return rows.mapInPandas(run, "file string, status string, message string")


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """One file ``<stem>/page<p>_img<i>.png`` for each row of (path, page, image, content), in a shared folder, renamed when whole.

    Other formats become PNG where Pillow is there, else they are kept as they are. Returns (file, status, message).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import os
        import uuid

        try:
            from PIL import Image
        except ImportError:
            Image = None
        for batch in batches:
            out = []
            for source, page, image, content in zip(batch["path"], batch["page"], batch["image"], batch["content"]):
                target = os.path.join(folder, os.path.splitext(os.path.basename(source))[0], f"page{page}_img{image}.png")
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    if Image and not content.startswith(b"\x89PNG"):
                        made = io.BytesIO()
                        Image.open(io.BytesIO(content)).save(made, "PNG")
                        content = made.getvalue()
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with open(part, "wb") as f:
                        f.write(content)
                    os.replace(part, target)
                    out.append((target, "ok", None))
                except (OSError, ValueError) as e:
                    out.append((target, "error", str(e)))
            yield pd.DataFrame(out, columns=["file", "status", "message"])

    return images.where("content IS NOT NULL").select("path", "page", "image", "content").mapInPandas(run, "file string, status string, message string")


def download(rows: DataFrame, url: str = "pdf_url", path: str = "paper_path", delay: float = 0.3, timeout: float = 30.0, chunk: int = 8192, rate: float | None = None, tasks: int = 4) -> DataFrame:
    """Fetch each URL to its path in a shared folder, in chunks, and rename when whole; returns (path, status, message).

    With ``rate``, requests a second over all tasks, the rows are dealt to ``tasks`` tasks and each waits ``tasks / rate``
    seconds from one request to the next; else each waits ``delay`` seconds after a request.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import time
        import urllib.request
        import uuid

        for batch in batches:
            out = []
            for source, target in zip(batch["url"], batch["path"]):
                began = time.monotonic()
                part = f"{target}.{uuid.uuid4().hex}.part"
                try:
                    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                    with urllib.request.urlopen(source, timeout=timeout) as answer, open(part, "wb") as f:
                        while data := answer.read(chunk):
                            f.write(data)
                    os.replace(part, target)
                    out.append((target, "ok", None))
                except (OSError, ValueError) as e:
                    if os.path.exists(part):
                        os.remove(part)
                    out.append((target, "error", str(e)))
                time.sleep(max(0.0, began + tasks / rate - time.monotonic()) if rate else delay)
            yield pd.DataFrame(out, columns=["path", "status", "message"])

    rows = rows.repartition(tasks) if rate else rows
    return rows.select(F.col(url).alias("url"), F.col(path).alias("path")).mapInPandas(run, "path string, status string, message string")
