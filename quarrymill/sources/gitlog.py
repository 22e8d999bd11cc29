"""Commit history as a data source: one git call for each repository, not two for each file."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, hash string, author string, ts timestamp, subject string, path string, added bigint, deleted bigint"
_UNIT, _RECORD = "\x1f", "\x1e"


def parse_log(text: str) -> Iterator[tuple]:
    """hash, author, ts, subject, path, added, deleted for each file of each commit; '-' counts as 0. A commit without
    files is one row with null path."""
    for record in text.split(_RECORD)[1:]:
        head, _, rest = record.partition("\n")
        parts = head.split(_UNIT)
        if len(parts) < 4:
            continue
        try:
            ts = datetime.fromisoformat(parts[2].strip()).astimezone(UTC).replace(tzinfo=None)
        except ValueError:
            ts = None
        files = [x.split("\t") for x in rest.splitlines() if x.strip()]
        files = [x for x in files if len(x) >= 3]
        number = lambda x: int(x) if x.isdigit() else 0
        for a, d, path, *_ in files or [("0", "0", None)]:
            yield parts[0], parts[1], ts, parts[3], path, number(a), number(d)


class _Repo(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.timeout = options["path"], float(options.get("timeout", "600"))

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(os.path.join(self.root, ".git")):
            return [_Repo(self.root)]
        return [_Repo(os.path.join(self.root, d)) for d in sorted(os.listdir(self.root)) if os.path.isdir(os.path.join(self.root, d, ".git"))] or [_Repo("")]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        if not partition.path:
            return
        call = ["git", "-C", partition.path, "log", f"--pretty=format:{_RECORD}%H{_UNIT}%an{_UNIT}%aI{_UNIT}%s", "--numstat"]
        done = subprocess.run(call, capture_output=True, text=True, errors="replace", timeout=self.timeout)
        if done.returncode == 0:  # a repository without commits has no rows
            for row in parse_log(done.stdout):
                yield (os.path.basename(partition.path.rstrip("/")), *row)


class GitLog(DataSource):
    """format("git_log"): options path (a repository, or a folder of them), timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits (repo, hash, author, ts, subject) and changes (repo, hash, path, added, deleted)."""
    spark.dataSource.register(GitLog)
    rows = spark.read.format("git_log").option("path", path).load()
    return rows.select("repo", "hash", "author", "ts", "subject").distinct(), rows.where("path IS NOT NULL").select("repo", "hash", "path", "added", "deleted")
