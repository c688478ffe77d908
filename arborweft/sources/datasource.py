"""Source trees as a Spark data source: ``spark.read.format("source_tree").load(path)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arborweft.sources.files import decode, read_bytes, walk
from arborweft.sources.registry import detect_path

SCHEMA = "path string, rel_path string, language string, size long, text string, encoding string, read_error string"


class Part(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]) -> None:
        self.paths = paths


class SourceTreeReader(DataSourceReader):
    """Names are listed once; a task reads files of about even total size."""

    def __init__(self, root: str, target: int, known_only: bool) -> None:
        self.root, self.target, self.known_only = root, target, known_only

    def partitions(self) -> list[Part]:
        parts, size = [[]], 0
        for path, rel, n in walk(self.root):
            if self.known_only and detect_path(path) is None:
                continue
            if size > self.target:
                parts.append([])
                size = 0
            parts[-1].append((path, rel))
            size += n
        return [Part(p) for p in parts]

    def read(self, partition: Part):
        for path, rel in partition.paths:
            try:
                raw = read_bytes(path)
                yield path, rel, detect_path(path), len(raw), *decode(raw), None
            except OSError as e:
                yield path, rel, detect_path(path), None, None, None, str(e)


class SourceTree(DataSource):
    """Options: path, local or a URI; targetBytes (8 MB) for a task; knownOnly (true) to leave out files of no known language."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options["path"], int(self.options.get("targetBytes", 8 << 20)), self.options.get("knownOnly", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
