"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from .common import same, stored, utf8

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3
SEED = 42


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(codes), 4096):
        part = codes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(codes))
    return int.from_bytes(bits.tobytes(), signed=True)


def fingerprints(texts: pa.Array) -> pa.Array:
    """`fingerprint` of each text; null is like the empty text."""
    return pa.array([fingerprint(t or b"") for t in texts.to_pylist()], pa.int64())


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of `count` segments of a 64-bit fingerprint."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` ones."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << b for m in masks for b in range(width)}
    return sorted(masks)


def close_pairs(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(u, v), u > v: distinct fingerprints `_fp` that differ in at most `distance` bits.

    Two such fingerprints differ in at most `distance // segments` bits within one segment at least. Each fingerprint
    asks the table of (segment, value) for all values in that small ball; the complete distance is checked in the
    join itself, so only links leave it. Fewer segments mean more questions for each fingerprint and fewer chance
    meetings: three suit up to some hundred million fingerprints, two (of radius 2) more.
    """
    value: list[Column] = []
    asked: list[Column] = []
    for at, width in _segments(segments):
        own = F.shiftrightunsigned("_fp", at).bitwiseAND(F.lit((1 << width) - 1))
        value.append(own)
        ball = F.array(*[F.lit(m).cast("long") for m in _ball(width, distance // segments)])
        asked.append(F.transform(ball, own.bitwiseXOR))
    table = prints.select(F.col("_fp").alias("v"), F.posexplode(F.array(*value)).alias("segment", "value"))
    questions = prints.select(F.col("_fp").alias("u"), F.posexplode(F.array(*asked)).alias("segment", "values")).select(
        "u", "segment", F.explode("values").alias("value")
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    return (
        questions.join(table, ["segment", "value"])
        .where((F.col("u") > F.col("v")) & near)
        .select("u", "v")
        .distinct()
    )


def clusters(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """One row per row of `docs`: doc_id, _key (of the text), fingerprint, group, component_id.

    Shingles of four words, A-Z lower-cased; a bit of the fingerprint is set if it is set in over half of the
    shingles' XXH64. Fingerprints link at `distance` or fewer differing bits. component_id: smallest doc_id of the
    fingerprints that links reach; null where all their ids are null. group: their smallest fingerprint.

    Null and empty texts have the fingerprint zero, linked like any other. Repeated rows share a component. Work on
    links is on distinct fingerprints, so a large group of copies costs one node. An empty table gives an empty one.
    """
    made = F.arrow_udf(fingerprints, "bigint")
    rows = stored(
        docs.select(
            "doc_id", F.md5(F.coalesce(utf8("text"), F.lit(b""))).alias("_key"), made(utf8("text")).alias("_fp")
        ),
        "simhash",
    )
    prints = stored(rows.groupBy("_fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    reached = stars(close_pairs(prints.select("_fp"), distance, segments)).select(
        F.col("object_id").alias("_fp"), F.col("component").alias("to")
    )
    placed = prints.join(reached, "_fp", "left").withColumn("group", F.coalesce("to", "_fp"))
    least = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    ends = stored(placed.select("_fp", "group").join(least, "group"), "simhash-ends")
    return rows.join(ends, "_fp").select(
        "doc_id", "_key", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "group", "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component (one row, also where rows repeat), in the columns of `docs`."""
    first = clusters(docs).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("x"))
    chosen = first.select(F.col("group").alias("_group"), F.col("x.doc_id").alias("_id"), F.col("x._key").alias("_text"))
    rows = docs.withColumn("_key", F.md5(F.coalesce(utf8("text"), F.lit(b""))))
    match = F.col("_key").eqNullSafe(F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(chosen, match).dropDuplicates(["_group"]).select(*same(docs))
