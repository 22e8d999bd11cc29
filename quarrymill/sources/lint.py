"""Findings of a lint tool that the executors have: optional, since metrics count long lines and trailing blanks themselves."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COMMAND = ("pycodestyle", "--max-line-length=79")
#: Lines of findings that are read of a file, and seconds that the tool has for it.
LINES, SECONDS = 500, 5


def lint_tool(files: DataFrame, command: tuple[str, ...] = COMMAND, lines: int = LINES, seconds: float = SECONDS) -> DataFrame:
    """(file_id, content) -> file_id, findings array<string>, failed. The tool reads a copy that goes at once; a tool that
    is missing or takes too long makes no findings, and failed is true."""

    def one(content: str | None) -> tuple[list[str], bool]:
        with tempfile.NamedTemporaryFile("w", suffix=".py", encoding="utf-8") as copy:
            copy.write(content or "")
            copy.flush()
            try:
                done = subprocess.run([*command, copy.name], capture_output=True, text=True, timeout=seconds, check=False)
            except (OSError, subprocess.TimeoutExpired):
                return [], True
        return [x.removeprefix(copy.name + ":") for x in done.stdout.splitlines()[:lines]], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file_id").cast(pa.int64()), pa.array([f for f, _ in found], pa.list_(pa.string())), pa.array([b for _, b in found], pa.bool_())], names=["file_id", "findings", "failed"])

    return files.select("file_id", "content").mapInArrow(run, "file_id long, findings array<string>, failed boolean")
