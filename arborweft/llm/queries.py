"""The operators as driver queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.llm import chat, decontam, jaccard, lines, mixing, quality, sharding, suffix, tokens, warc
from arborweft.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("whole")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), length=200).drop("kept")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


#: The vocabulary that op5 counts with.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), MODEL)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lines.line_digests(docs, lines.keep_bitmaps(docs, min_docs=10, min_chars=1, keep="none")).drop("keep_bitmap")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.pages_to_arc(_table(spark, sf_dir, "pages"))
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(warc.parse_arc(archives), min_bytes=0), path)
    read = warc.read_warc(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", warc.page_number(F.col("refers_to_id")).alias("refers_to"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.parse(chat.render(chat.fold(chat.to_events(rows.unionByName(extra))))))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_table(spark, sf_dir, "documents")).drop("failed_rule")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_mix_sources": op2_mix_sources,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_token_counts": op5_token_counts,
        "op6_line_dedup": op6_line_dedup,
        "op7_warc": op7_warc,
        "op8_chat_format": op8_chat_format,
        "op9_sharding": op9_sharding,
        "op10_quality_rules": op10_quality_rules,
    }
