"""Conversion of files to Markdown by a service: submit, poll until done or too late, download."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Converter(Protocol):
    def submit(self, name: str, content: bytes) -> tuple[str, str]:
        """A task's id and its status."""

    def poll(self, task: str) -> tuple[str, str]:
        """Status (processing, finished, failed) and, once finished, where the result is."""

    def download(self, at: str) -> bytes: ...


def converted(converter: Converter, name: str, content: bytes, interval: float, deadline: float, sleep: Callable[[float], None] = time.sleep) -> str:
    """The Markdown of a file; an error if the service refuses it, fails or takes longer than ``deadline`` seconds."""
    task, status = converter.submit(name, content)
    if status not in ("finished", "processing"):
        raise RuntimeError(f"unexpected status {status}")
    waited = 0.0
    while True:
        status, at = converter.poll(task)
        if status == "finished":
            return converter.download(at).decode("utf-8")
        if status == "failed":
            raise RuntimeError("conversion failed")
        if waited + interval > deadline:
            raise TimeoutError(f"not converted within {deadline} seconds")
        sleep(interval)
        waited += interval


def to_markdown(files: DataFrame, make: Callable[[], Converter], interval: float = 2.0, deadline: float = 300.0) -> DataFrame:
    """``source_id, text, error`` of files (source_id, file_name, content); a file that fails doesn't stop the others.

    Each task makes a converter of its own with ``make``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = make()
        for rows in batches:
            out = []
            for source_id, name, content in rows[["source_id", "file_name", "content"]].itertuples(index=False):
                try:
                    out.append((source_id, converted(converter, name, bytes(content or b""), interval, deadline), None))
                except Exception as e:  # the error is the row's result
                    out.append((source_id, None, str(e)))
            yield pd.DataFrame(out, columns=["source_id", "text", "error"])

    return files.select("source_id", "file_name", "content").mapInPandas(run, "source_id bigint, text string, error string")
