"""Texts to graph rows: the language readers as one Arrow stage, pages and descriptors as expressions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.functions.names import file_name
from arborweft.operators import markup, merge
from arborweft.operators.parsers.java import read_java
from arborweft.operators.parsers.javascript import read_javascript
from arborweft.operators.parsers.rust import read_rust
from arborweft.schema import LOCATION, METADATA
from arborweft.sources import registry

READERS = {"Java": read_java, "JavaScript": read_javascript, "Rust": read_rust}
_PLACE = [f.name for f in LOCATION.fields]


def extract_source(language: str, path: str, text: str) -> list[dict]:
    """Records of one text. Languages without a reader give none; an unknown language is an error."""
    spec = registry.get_language(language)
    if spec is None:
        raise ValueError(f"unsupported language: {language}")
    reader = registry.EXTRACTORS.get(language) or READERS.get(spec.extractor)
    return list(reader(path, text)) if reader else []


def read_records(files: DataFrame, extra: dict | None = None) -> DataFrame:
    """file, seq, ord and the record as columns, for files (path, language, extractor, text, seq) with a reader of their own. A text that
    cannot be read gives an error record, never a failed task."""
    readers = {x.name: registry.EXTRACTORS.get(x.name) or READERS.get(x.extractor) for x in registry.all_languages()} | (extra or {})  # extra: readers such as read_renders, which no normal run has
    own = [n for n, f in readers.items() if f]
    columns = ["rec", "id", "kind", "name", "file_path", "src", "dst", "relation", "error"]
    schema = "file string, seq string, ord int, rec string, id string, kind string, name string, file_path string, src string, dst string, relation string, error string, place string, meta string"

    def run(batches):
        for b in batches:
            out = []
            for path, seq, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "seq", "language", "text")), strict=True):
                try:
                    rows = list(readers[language](path, text))
                except Exception as e:  # the dead-letter record of this file
                    rows = [{"rec": "error", "error": f"{type(e).__name__}: {e}"}]
                for k, r in enumerate(rows):
                    place = json.dumps(dict(zip(_PLACE, r["location"], strict=True))) if r.get("location") else None
                    out.append((path, seq, k, *(r.get(c) for c in columns), place, json.dumps(r.get("metadata") or {})))
            if out:
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * (len(columns) + 2)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "seq", "ord", *columns, "place", "meta"])

    texts = files.where(F.col("language").isin(own) & F.col("text").isNotNull()).select("path", F.col("seq").cast("string").alias("seq"), "language", "text")
    rows = texts.mapInArrow(run, schema)
    return rows.select("*", F.from_json("place", LOCATION).alias("location"), F.from_json("meta", METADATA).alias("metadata")).drop("place", "meta")


def extract(files: DataFrame, inventory: DataFrame | None = None, records: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes (merged by id in source order), edges (a bag), calls (src, method_name, object_type, file) and errors of files (path,
    language, extractor, text, seq). inventory lists all files there are; the files themselves unless given. records are what
    ``read_records`` gives of the files, where that is known already."""
    records = read_records(files) if records is None else records
    inventory = files.select("path") if inventory is None else inventory.select("path")
    of = lambda kind: records.where(F.col("rec") == kind)
    columns = ["seq", "ord", "id", "kind", "name", "file_path", "location", "metadata"]
    nodes, edges = of("node").select(*columns), of("edge").select("seq", "src", "dst", "relation", "metadata")
    pages = files.where("extractor = 'Jsp' AND text IS NOT NULL")
    descriptors = files.where("extractor = 'Xml' AND text IS NOT NULL").withColumn("_n", F.lower(file_name(F.col("path"))))
    parts = [markup.extract_jsp(pages, inventory), markup.extract_web_xml(descriptors.where("_n = 'web.xml'")), markup.extract_portlet_xml(descriptors.where("_n = 'portlet.xml'"))]
    for n, e in parts:
        nodes = nodes.withColumn("ord", F.col("ord").cast("long")).unionByName(n.select(*columns))
        edges = merge.bag_union(edges, e)
    calls = of("call").select("src", F.col("metadata")["method_name"].alias("method_name"), F.col("metadata")["object_type"].alias("object_type"), F.col("file"))
    return {"nodes": merge.merge_nodes(nodes, ["seq", "ord"]), "edges": edges.select("src", "dst", "relation", "metadata"), "calls": calls, "errors": of("error").select("file", "error")}
