"""A Python data source that walks a folder of source files.

Spark's own file sources skip names that begin with _ or ., and empty files; here every file is a row, one that cannot
be decoded too (status decode_error)."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_id bigint, repo string, path string, dir string, name string, ext string, size bigint, content string, status string, error string"


class _Part(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


class _Reader(DataSourceReader):
    """Folders are listed on the driver; files are read on the executors, some hundred a partition."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.exts = {e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip()}
        self.repo = options.get("repo")
        self.each = int(options.get("filesPerPartition", "256"))

    def partitions(self) -> list[InputPartition]:
        found = []
        for top, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d != ".git")
            found += [os.path.relpath(os.path.join(top, n), self.root) for n in sorted(names)]
        if self.exts:
            found = [f for f in found if os.path.splitext(f)[1].lower() in self.exts]
        if self.repo:
            found = [f for f in found if f.split("/")[0] == self.repo]
        return [_Part(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import xxhash

        for rel in partition.names:
            with open(os.path.join(self.root, rel), "rb") as f:
                raw = f.read()
            content, status, error = None, "ok", None
            try:
                content = raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
            except UnicodeDecodeError as e:
                status, error = "decode_error", str(e)
            parts = rel.split("/")
            file_id = xxhash.xxh3_64_intdigest(rel.encode()) >> 1
            yield (file_id, parts[0] if len(parts) > 1 else "", rel, "/".join(parts[:-1]), parts[-1], os.path.splitext(parts[-1])[1].lower(), len(raw), content, status, error)


class SourceFiles(DataSource):
    """format("source_files"): options path, extensions (comma-separated), repo, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def read_files(spark: SparkSession, path: str, extensions: str = ".py", repo: str | None = None) -> DataFrame:
    spark.dataSource.register(SourceFiles)
    reader = spark.read.format("source_files").option("path", path).option("extensions", extensions)
    return (reader.option("repo", repo) if repo else reader).load()
