"""Source files as a stream: each micro-batch replaces the rows of the files it brings, then names are resolved again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.operators.analysis import analyze_texts
from arborweft.operators.extract import read_records
from arborweft.operators.store import GraphStore
from arborweft.sources.registry import detect_language, source_rank

SOURCES = "path string, text string, at timestamp"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of source rows (path, text, at) that arrive as JSON lines in a folder."""
    return spark.readStream.schema(SOURCES).json(folder)


def latest(rows: DataFrame) -> DataFrame:
    """One row for each path: the newest text; ties go to the smallest."""
    best = rows.groupBy("path").agg(F.max(F.struct("at", "text")).alias("m"))
    return best.select("path", "m.text", "m.at")


def _versions(spark: SparkSession, path: str) -> dict[int, object]:
    """Numbers of the versions under a path, with their folders."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(p)] if system.exists(p) else []
    return {int(x.getName()[1:]): x for x in found if x.getName()[:1] == "v" and x.getName()[1:].isdecimal()}


def ingest(stream: DataFrame, sources_path: str, store: GraphStore, checkpoint: str, project: str = "stream"):
    """Start a query that keeps the sources (newest text for each path), what was read from them and the project's graph up to date. The
    unit of change is the file: only texts that a batch brings are parsed, the records of all others are kept. Names are resolved over the
    records of the whole project, as a new definition may catch calls from anywhere. A batch writes a version from the one before; the two
    stay, so a batch that is run again after a failure gives the same tables, and older ones go."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, sources_path)
        last = max((n for n in versions if n < number), default=None)
        of = lambda n, table: f"{sources_path}/v{n}/{table}"
        rows = latest(batch).withColumn("fresh", F.lit(True))
        if last is not None:
            rows = rows.unionByName(spark.read.parquet(of(last, "sources")).withColumn("fresh", F.lit(False)))
        newest = rows.groupBy("path").agg(F.max(F.struct("at", "text", "fresh")).alias("m")).select("path", "m.*")
        newest.write.mode("overwrite").parquet(of(number, "sources"))
        texts = detect_language(spark.read.parquet(of(number, "sources"))).withColumn("supported", F.col("language").isNotNull())
        texts = texts.withColumn("seq", source_rank(F.col("path")))
        fresh = texts.where("fresh")
        records = read_records(fresh)
        if last is not None:
            kept = spark.read.parquet(of(last, "records")).join(fresh.select(F.col("path").alias("file")), "file", "left_anti")
            records = records.unionByName(kept)
        records.write.mode("overwrite").parquet(of(number, "records"))
        graph = analyze_texts(texts.withColumn("read_error", F.lit(None).cast("string")), records=spark.read.parquet(of(number, "records")))
        store.export(graph.nodes, graph.edges, project, project, clear=True)
        for n, folder in versions.items():
            if n not in (last, number):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
