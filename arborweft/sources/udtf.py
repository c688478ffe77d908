"""The language readers as a table function of SQL: ``SELECT ... FROM files, LATERAL extract_source(language, path, text)``."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

COLUMNS = ["rec", "id", "kind", "name", "file_path", "src", "dst", "relation", "error"]


@udtf(returnType=", ".join(f"{c} string" for c in COLUMNS) + ", metadata string")
class ExtractSource:
    """Records of one text, metadata as JSON; one that cannot be read gives an error record."""

    def eval(self, language: str, path: str, text: str):
        from arborweft.operators.extract import extract_source

        try:
            rows = extract_source(language, path or "", text or "")
        except Exception as e:  # the dead-letter record of this text
            rows = [{"rec": "error", "error": f"{type(e).__name__}: {e}"}]
        for r in rows:
            yield (*(r.get(c) for c in COLUMNS), json.dumps(r.get("metadata") or {}))


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_source", ExtractSource)
