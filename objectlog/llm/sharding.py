"""Sharding by a two-pass external shuffle, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, without

SHARDS = 16
BUCKET_BYTES = 8 << 20
SEED = 20_240_601
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_bucket", "_pile", "_first", "_place", "_row")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest seeded hash of (key, shard number).

    A shard's hash does not depend on how many there are, so with one more shard a key stays or goes to the new one.
    """
    drawn = [F.xxhash64(key, F.lit(seed), F.lit(s)) for s in range(shards)]
    if shards == 1:
        return F.lit(0)
    return (F.array_position(F.array(*drawn), F.greatest(*drawn)) - 1).cast("int")


def external_shuffle(
    docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED
) -> DataFrame:
    """All rows of `docs` with size, text_crc32, law, shard, slot and grown_shard.

    Pass one scatters the rows of every shard uniformly over buckets by a seeded hash of id and text. The number of
    buckets follows from the measured bytes, so that a bucket holds about `bucket_bytes`; there are as many tasks as
    buckets. Pass two puts each bucket into a seeded Fisher-Yates order (`shuffle`). A row's slot is its place there
    after all rows of the shard's earlier buckets: gapless from 0 in every shard.

    Law `key`: doc_id and the number of shards decide the shard; `grown_shard` is the shard if there were one more.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32: of those bytes (null: of none). A null id is a key
    like any other. Repeated rows each get a slot. An empty table gives an empty one. Input columns named like a
    result column are replaced by it.
    """
    kept = without(docs, OWN)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = kept.select(
        "*",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    scattered = keyed.withColumn(
        "_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size"), F.lit(buckets))
    )
    in_order = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        scattered.groupBy("shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_first"))
    )
    record = F.struct(*[col(c) for c in (*kept.columns, "size", "text_crc32", "grown_shard")])
    piles = (
        scattered.repartition(shards * buckets, "shard", "_bucket")
        .sortWithinPartitions("shard", "_bucket", "doc_id", "text_crc32", "size")
        .groupBy("shard", "_bucket")
        .agg(F.collect_list(record).alias("_pile"))
        .select("shard", "_bucket", F.shuffle("_pile", seed).alias("_pile"))
    )
    rows = piles.join(first, ["shard", "_bucket"]).select(
        "shard", "_first", F.posexplode("_pile").alias("_place", "_row")
    )
    return rows.select(
        *[F.col("_row").getField(c).alias(c) for c in (*kept.columns, "size", "text_crc32")],
        F.lit("key").alias("law"),
        "shard",
        (F.col("_first") + F.col("_place")).cast("long").alias("slot"),
        F.col("_row").getField("grown_shard").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write the shards of `docs` below `path`, a folder for each, files in slot order."""
    external_shuffle(docs, **how).write.partitionBy("shard").parquet(path)
