"""Writers of report documents."""

from __future__ import annotations

import json
import os
import sys
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OutputError(RuntimeError):
    """A document could not be written."""


def write_json(documents: DataFrame, path: str, column: str = "document") -> str:
    """Write documents as text, one a line, over what was there; returns the path."""
    try:
        documents.select(column).write.mode("overwrite").text(path)
    except Exception as e:
        raise OutputError(f"Failed to write output file: {e}") from e
    return path


def laid_out(document: str, spacing: int = 0) -> str:
    """A JSON document with an indent of so many blanks, or in its shortest form."""
    value = json.loads(document)
    return json.dumps(value, ensure_ascii=False, indent=spacing) if spacing else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def write_file(document: DataFrame, path: str, spacing: int = 0, column: str = "document") -> str:
    """Write a one-row report as one file of the driver's, with its folders; returns the absolute path."""
    target = os.path.abspath(path)
    try:
        text = laid_out(document.select(column).first()[column], spacing)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(text)
    except Exception as e:
        raise OutputError(f"Failed to write output file: {e}") from e
    return target


def write_json_later(documents: DataFrame, path: str, column: str = "document") -> Future[str]:
    """As ``write_json``, without waiting for it."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(write_json, documents, path, column)
    finally:
        pool.shutdown(wait=False)


def print_document(document: DataFrame, frame: bool = False, column: str = "document", spacing: int = 2) -> bool:
    """Print a one-row report, laid out, if its summary has results or it has failures; whether it was printed."""
    shown = F.get_json_object(column, "$.failures[0]").isNotNull() | (F.get_json_object(column, "$.summary.total").cast("long") > 0)
    row = document.select(column, shown.alias("shown")).first()
    if row is None or not row["shown"]:
        return False
    line = "=" * 80 + "\n"
    sys.stdout.write(f"{line if frame else ''}{laid_out(row[column], spacing)}\n{line if frame else ''}")
    return True


class OnceOnly:
    """For ``foreachBatch``: a batch that was written already is not written again. Its number is its folder's name."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{self.path}/batch={number}")
