"""Quality rules: counts of words and repetitions in a text, and lines that many documents of a host share."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import same, stored, utf8, without
from .near_dup import text_key

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
LINE_DOCS = 10
LEFT_SHARE = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OWN = (*COUNTS, "base_failed", "kept", "left_words", "clean_text", "_host", "_key", "_at", "_lines", "_cut")
_FACTS = ", ".join(f"{c}:bigint" for c in COUNTS) + ", lines:array<bigint>, words:array<int>"
_ARROW = pa.struct(
    [(c, pa.int64()) for c in COUNTS] + [("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))]
)
_CONTINUATION = bytes(range(0x80, 0xC0))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found more than once in the list, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * _ODD + codes[k : k + n]
    _, which, often = np.unique(rolled, return_inverse=True, return_counts=True)
    again = np.flatnonzero(often[which] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[again] += 1
    edges[again + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def line_key(words: list[bytes]) -> int:
    """Hash of a normalised line: its words joined by one space, A-Z lower-cased. Orders as the digest's first bytes do."""
    return int.from_bytes(hashlib.md5(b" ".join(words).lower()).digest()[:8]) - 2**63


def text_facts(text: bytes) -> dict:
    """The counts of a text, and for each of its lines the key and the words (null key: no word)."""
    words = text.split()
    seen: set[bytes] = set()
    repeats, keys, sizes = 0, [], []
    for line in text.split(b"\n"):
        parts = line.split()
        if parts:
            repeats += line in seen
            seen.add(line)
        keys.append(line_key(parts) if parts else None)
        sizes.append(len(parts))
    return {
        "n_words": len(words),
        "word_chars": len(b"".join(words).translate(None, _CONTINUATION)),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": repeats,
        "n_repeat_words": repeated_words(words),
        "lines": keys,
        "words": sizes,
    }


def _facts(texts: pa.Array) -> pa.Array:
    return pa.array([text_facts(t or b"") for t in texts.to_pylist()], _ARROW)


def judge(
    docs: DataFrame,
    line_docs: int = LINE_DOCS,
    left_share: float = LEFT_SHARE,
    copies: DataFrame | None = None,
) -> DataFrame:
    """All rows of `docs` with the base counts, base_failed, left_words, clean_text and kept.

    Base: under MIN_WORDS words, or over MAX_REPEATED_PERCENT % of the words in 8-word windows that occur twice.

    Cross-document line frequency: lines are normalised (words joined by one space, A-Z lower-cased) and hashed. Per
    host (`source`) the distinct documents with a line are counted; equal texts are one document. A line in more than
    `line_docs` of them leaves clean_text, whatever the size of the host; left_words counts the words that stay, and a
    document with less than `left_share` of its words left is rejected.

    With `copies` (key, component, as `near_copies.components` has them) the documents of a component count once for
    each line, so a large group of near-copies does not make its own lines look shared.

    A null text has no words (base_failed) and a null clean_text; null sources form one host. Repeated rows get equal
    verdicts. An empty table gives an empty one. Input columns named like a result column are replaced by it.
    """
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    key = text_key()
    rows = without(docs, OWN).select("*", host.alias("_host"), key.alias("_key"))
    facts = F.arrow_udf(_facts, f"struct<{_FACTS}>")
    texts = stored(
        docs.select(host.alias("_host"), key.alias("_key"), facts(utf8("text")).alias("f"))
        .groupBy("_host", "_key")
        .agg(F.first("f").alias("f"))
        .select("_host", "_key", "f.*"),
        "quality",
    )
    ours = F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))
    lines = texts.select("_host", "_key", F.explode(ours).alias("line"))
    counted = lines
    if copies is not None:
        # As text, a key and a component never meet.
        document = F.coalesce(F.concat(F.lit("c"), F.col("component")), F.hex("_key")).alias("document")
        placed = texts.select("_host", "_key", "lines").join(copies.withColumnRenamed("key", "_key"), "_key", "left")
        counted = placed.select("_host", document, F.explode(ours).alias("line")).distinct()
    often = (
        counted.groupBy("_host", "line")
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") > line_docs)
        .select("_host", "line")
    )
    cuts = (
        lines.select("_host", "_key", "line")
        .join(often, ["_host", "line"])
        .groupBy("_host", "_key")
        .agg(F.collect_set("line").alias("_cut"))
    )
    stays = lambda k: ~F.coalesce(F.array_contains("_cut", k), F.lit(False))
    left = F.aggregate(
        F.arrays_zip("lines", "words"),
        F.lit(0).cast("long"),
        lambda n, x: n + F.when(stays(x["lines"]), x["words"]).otherwise(0),
    )
    verdicts = (
        texts.join(cuts, ["_host", "_key"], "left")
        .withColumn("left_words", left)
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
        )
        .select(
            "_host", "_key", *COUNTS, "base_failed", "left_words", "_cut",
            (~F.col("base_failed") & (F.col("left_words") >= left_share * F.col("n_words"))).alias("kept"),
            F.when(F.col("_cut").isNotNull(), F.col("lines")).alias("_lines"),
        )
    )
    clean = F.when(
        F.col("_cut").isNotNull(),
        F.array_join(
            F.filter(F.split("text", "\n", -1), lambda _, i: stays(F.get("_lines", i))), "\n"
        ),
    ).otherwise(F.col("text"))
    # Under a struct, both sides have an exchange of their own, so that Spark can split the rows of one repeated text.
    at = F.struct("_host", "_key")
    return (
        rows.withColumn("_at", at).join(verdicts.select(at.alias("_at"), "*").drop("_host", "_key"), "_at").drop("_at")
        .withColumn("clean_text", clean)
        .drop("_host", "_key", "_cut", "_lines")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their lines above the limit, in the columns of `docs`.

    A component of near-copies (five-word shingles, exact Jaccard similarity of 0.8 or more) counts once for each line.
    """
    judged = judge(docs, copies=stored(near_copies.components(docs), "quality-copies")).where("kept")
    text = F.col("clean_text")
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return judged.withColumns(new).select(*same(docs))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
again AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM twice) GROUP BY 1),
raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM words),
lines AS (
  SELECT doc_id, source, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS w FROM raw_lines
  WHERE len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY 1),
keyed AS (
  SELECT doc_id, coalesce(source, '') AS host, len(w) AS n, substr(md5(translate(
    array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 16) AS line FROM lines),
texts AS (SELECT min(doc_id) AS doc_id, coalesce(source, '') AS host FROM words GROUP BY text, coalesce(source, '')),
uniq AS (SELECT DISTINCT k.doc_id, k.host, k.line FROM keyed k JOIN texts t ON t.doc_id = k.doc_id),
often AS (SELECT host, line FROM uniq GROUP BY 1, 2 HAVING count(*) > 10),
lost AS (SELECT k.doc_id, sum(k.n) AS n FROM keyed k JOIN often o ON o.host = k.host AND o.line = k.line GROUP BY 1),
counts AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
         (len(w) - coalesce(lost.n, 0))::BIGINT AS left_words
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, left_words, base_failed,
       NOT base_failed AND left_words >= 0.3::DOUBLE * n_words AS kept
FROM failed
"""
