"""The registered query of each text operator, with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import decontam, hard_negatives, html_text, line_dedup, manifest, mixing, near_dup, quality, sharding, simhash, token_output, url_filter, warc
from .common import read, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


SHARES = {"good": 0.85, "poor": 0.15, "toxic": 0.0}


@query
def op1_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix(read(spark, folder, "documents"), read(spark, folder, "labels"), shares=SHARES)
    posteriors = [F.col("posteriors")[i].alias(d) for i, d in enumerate(mixing.DOMAINS)]
    return mix.select("doc_id", "n_tokens", *posteriors, "rate", "copies")


@query
def op2_suffix_automaton(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op2_suffix_automaton"] = decontam.ORACLE


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives-{uuid4().hex}"
    warc.write_archives(read(spark, folder, "pages"), path)
    told = F.regexp_extract(F.col("payload").cast("string"), r"page-id: (-?[0-9]+)", 1)
    facts = F.when(F.col("type") == "metadata", told).alias("page_id")
    records = stored(warc.read_archives(spark, path).select("*", facts).drop("payload", "head"), "records")
    captures = stored(
        warc.assemble(records).select(
            "capture",
            "type",
            F.col("response.refers_to").alias("first"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_sha256").alias("payload_digest"),
            F.col("metadata")[0]["page_id"].try_cast("bigint").alias("page_id"),
        ),
        "captures",
    )
    held = captures.select(
        F.col("capture").alias("first"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("held_bytes"),
        F.col("payload_digest").alias("held_digest"),
    )
    return captures.join(held, "first", "left").select(
        "page_id",
        F.coalesce("held_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("held_digest", "payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


ORACLES["op3_warc"] = warc.ORACLE


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.clusters(read(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op5_url_models(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op6_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.judge(read(spark, folder, "documents"))


@query
def op7_rans(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    token_output.write_tokens(read(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_tokens(spark, path)


@query
def op8_boosted_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents")).select(
        "doc_id", *quality.COUNTS, "left_words", "base_failed", "kept"
    )


ORACLES["op9_quality_rules"] = quality.ORACLE


@query
def op10_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.external_shuffle(read(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query
def op11_bayes_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.duplicates(read(spark, folder, "documents"))


ORACLES["op11_bayes_minhash"] = near_dup.ORACLE


@query
def op12_merkle_butterfly(spark: SparkSession, folder: str) -> DataFrame:
    found = manifest.manifest(read(spark, folder, "documents"), manifest.lowered())
    return found.withColumnRenamed("key", "doc_id").drop("path")


ORACLES["op12_merkle_butterfly"] = manifest.oracle()


@query
def op13_hilbert_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(read(spark, folder, "embeddings"))


ORACLES["op13_hilbert_negatives"] = hard_negatives.ORACLE
