"""Source trees as tables: listing, decoding, projects."""

from __future__ import annotations

import os
import pathlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.schema import FILES
from arborweft.sources.registry import LANGUAGES, detect_path, get_language


def _file_system(uri: str) -> tuple[FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, abfs) and the path in it; names may hold any character."""
    return FileSystem.from_uri(quote(uri, safe=":/@"))


def walk(root: str) -> Iterator[tuple[str, str, int]]:
    """(path, path below root, bytes) of all files below a folder or URI but those of a name, or in a folder of a name, that begins with
    a dot. Folders that cannot be read are passed over. Spark's own listing would also leave out names that begin with '_'."""
    if "://" in root:
        system, base = _file_system(root)
        found = system.get_file_info(FileSelector(base, recursive=True, allow_not_found=True))
        for f in sorted((f for f in found if f.type == FileType.File), key=lambda f: f.path):
            rel = f.path[len(base.rstrip("/")) :].lstrip("/")
            if not any(x.startswith(".") for x in rel.split("/")):
                yield f"{root.rstrip('/')}/{rel}", rel, f.size or 0
        return
    base = pathlib.Path(root).resolve()
    for folder, dirs, names in os.walk(base):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        for name in sorted(n for n in names if not n.startswith(".")):
            path = os.path.join(folder, name)
            size = os.path.getsize(path) if os.path.exists(path) else 0  # a link may lead nowhere
            yield path.replace("\\", "/"), os.path.relpath(path, base).replace("\\", "/"), size


def read_bytes(path: str) -> bytes:
    """The content of a local path or URI, as walk gives them."""
    if "://" not in path:
        return pathlib.Path(path).read_bytes()
    system, own = _file_system(path)
    with system.open_input_stream(own, compression=None) as f:
        return f.read()


def list_files(spark: SparkSession, root: str, project_path: str = "") -> DataFrame:
    """The files of a tree, local or of a URI: names only, contents are read by tasks."""
    rows = []
    for path, rel, size in walk(root):
        name = rel.rsplit("/", 1)[-1]
        language = detect_path(path)
        spec = get_language(language) if language else None
        ext = name.rsplit(".", 1)[1] if "." in name[1:] else None
        rows.append((project_path, path, rel, name, ext, language, spec.extractor if spec else None, spec is not None, ext in ("jsp", "jspx", "jspf"), size))
    return spark.createDataFrame(rows, FILES)


def decode(raw: bytes) -> tuple[str, str]:
    """Text and the name of its encoding: UTF-8 where it is valid, else the best guess, never failing."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(raw).best()
        if best is not None:
            return str(best), best.encoding
    except ImportError:
        pass
    return raw.decode("cp1252", "replace"), "cp1252"


def read_texts(files: DataFrame, target_bytes: int = 8 << 20) -> DataFrame:
    """files with text, encoding and read_error. Tasks get files of about even size together, so many small ones make few tasks."""
    total = files.agg(F.sum("size")).collect()[0][0] or 0
    schema = files.select("*", F.lit("").alias("text"), F.lit("").alias("encoding"), F.lit("").alias("read_error")).schema

    def run(batches):
        for b in batches:
            got = []
            for path in b.column("path").to_pylist():
                try:
                    got.append((*decode(read_bytes(path)), None))
                except OSError as e:
                    got.append((None, None, str(e)))
            columns = [pa.array([g[i] for g in got], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "text", "encoding", "read_error"])

    for f in schema.fields:
        f.nullable = True
    return files.repartition(max(1, -(-total // target_bytes)), "path").mapInArrow(run, schema)


def from_texts(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Sources in memory as the table that read_texts gives."""
    rows = []
    for path, text in sources.items():
        language = detect_path(path)
        spec = next((x for x in LANGUAGES if x.name == language), None) or (get_language(language) if language else None)
        name = path.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[1] if "." in name[1:] else None
        rows.append(("", path, path, name, ext, language, spec.extractor if spec else None, spec is not None, ext in ("jsp", "jspx", "jspf"), len(text), text, "utf-8", None))
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FILES) + ", text string, encoding string, read_error string")


def list_projects(spark: SparkSession, code_path: str | None = None) -> DataFrame:
    """The folders of the code path, by name; hidden ones are listed too."""
    base = code_path or os.environ.get("CODE_PATH", "/app/data")
    names = sorted(x.name for x in os.scandir(base) if x.is_dir()) if os.path.isdir(base) else []
    return spark.createDataFrame([(n,) for n in names], "name string")
