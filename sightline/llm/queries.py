"""The operators' queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    conversation_repair,
    decontaminate,
    imatch,
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_tree,
    toxicity,
    warc,
)
from sightline.llm.common import crc_of_id, table
from sightline.llm.sql import ORACLES  # noqa: F401  (read by the entry)
from sightline.plans.lineage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return sharding.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs, row=F.lit(None).cast("string")).select(
        "doc_id", "n_shingles", "component_id"
    )


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read(index, payloads=False).select(
        F.col("page_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint"),
    )


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "row.doc_id", (crc_of_id("row.doc_id") % 5 == 0).alias("held_out"), "score", "predicted"
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, F.struct("doc_id")).select(
        "row.doc_id", "severity", "grade", "p_toxic", "toxic"
    )


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), over=line_dedup.PASSAGE)
    return found.select(
        "row.doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.col("cleaned").alias("text")
    )


@query
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.checked(table(spark, sf_dir, "conversations"))


@query
def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.checked(docs)
