"""The language catalogue, detection by name and extension, and the order in which sources count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborweft.functions.names import ancestors, extension, file_name


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    file_names: tuple[str, ...]
    extractor: str
    function_kind: str | None


#: The languages, their extensions and special file names, and the extractor of each.
LANGUAGES = [
    Language("python", ("py",), (), "TreeSitter", "function_definition"),
    Language("javascript", ("js", "jsx", "ts", "tsx"), (), "JavaScript", "function_declaration"),
    Language("html", ("html", "htm"), (), "None", None),
    Language("xml", ("xml",), ("portlet.xml", "web.xml"), "Xml", None),
    Language("jsp", ("jsp",), (), "Jsp", None),
    Language("jspx", ("jspx",), (), "Jsp", None),
    Language("jspf", ("jspf",), (), "Jsp", None),
    Language("java", ("java",), (), "Java", "method_declaration"),
    Language("rust", ("rs",), (), "Rust", "function_item"),
]
_EXTRA: dict[str, Language] = {}
#: Python extractors by language: (path, text) -> records.
EXTRACTORS: dict[str, Callable] = {}


def register_extractor(language: str, extensions: list[str], file_names: list[str], fn: Callable) -> None:
    """Add a language of one's own; fn(path, text) gives extraction records."""
    _EXTRA[language] = Language(language, tuple(extensions), tuple(file_names), "Custom", None)
    EXTRACTORS[language] = fn


def all_languages() -> list[Language]:
    return [*LANGUAGES, *_EXTRA.values()]


def supported_languages() -> list[str]:
    return [x.name for x in all_languages()]


def get_language(name: str) -> Language | None:
    return next((x for x in all_languages() if x.name == name), None)


def has_specialized_extractor(name: str) -> bool:
    found = get_language(name)
    return found is not None and found.extractor not in ("TreeSitter", "None")


def detect_path(path: str) -> str | None:
    """The language of one path; file names count before extensions, and neither minds case."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    for x in all_languages():
        if name.lower() in x.file_names:
            return x.name
    ext = name.rsplit(".", 1)[1].lower() if "." in name[1:] else None
    return next((x.name for x in all_languages() if ext in x.extensions), None)


def language_table(spark: SparkSession) -> DataFrame:
    """match ('name' or 'ext'), key, language, extractor: a few rows, bounded by the catalogue."""
    rows = [("ext", e, x.name, x.extractor) for x in all_languages() for e in x.extensions]
    rows += [("name", n, x.name, x.extractor) for x in all_languages() for n in x.file_names]
    return spark.createDataFrame(rows, "match string, key string, language string, extractor string")


def detect_language(files: DataFrame) -> DataFrame:
    """files (path) with language and extractor; null where nothing fits."""
    known = language_table(files.sparkSession)
    side = lambda m, c: F.broadcast(known.where(F.col("match") == m).select(F.col("key").alias(c), F.struct("language", "extractor").alias(f"{c}_x")))
    out = files.withColumn("_n", F.lower(file_name(F.col("path")))).withColumn("_e", F.lower(extension(F.col("path"))))
    out = out.join(side("name", "_n"), "_n", "left").join(side("ext", "_e"), "_e", "left").withColumn("_x", F.coalesce("_n_x", "_e_x"))
    return out.select(*files.columns, F.col("_x.language").alias("language"), F.col("_x.extractor").alias("extractor"))


def is_jsp(path) -> F.Column:
    return F.coalesce(extension(path).isin("jsp", "jspx", "jspf"), F.lit(False))


def source_rank(path) -> F.Column:
    """A string that sorts as sources count: pages after all other sources, then by path. Later nodes are merged into earlier
    ones, and for that a sort key does; no task has to see all files."""
    return F.concat(F.when(is_jsp(path), "1").otherwise("0"), path)


def in_source_order(files: DataFrame, tie: str | None = None) -> DataFrame:
    """files with seq from 1, for lists that show numbers: one task sorts all rows."""
    keys = [is_jsp(F.col("path")), F.col("path"), *([F.col(tie)] if tie else [])]
    return files.withColumn("seq", F.row_number().over(W.orderBy(*keys)))


def nearest_ancestor(paths: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """paths (key, path) with the longest of its folders that is in known (dir)."""
    up = paths.select(key, F.explode(ancestors(F.col("path"))).alias("dir"))
    return up.join(known.select("dir").distinct(), "dir").groupBy(key).agg(F.max_by("dir", F.length("dir")).alias("dir"))
